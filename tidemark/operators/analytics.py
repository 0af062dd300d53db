"""Window analytics over the fact and the monthly mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_of, ratio, rounded
from . import ranking

#: Classes of a z-score, from the highest bound, and bands of spending.
ANOMALIES = ((3.0, "ANOMALIA_ALTA"), (2.0, "ATENCAO"), (1.5, "LEVE"))
TOP, BOTTOM, MIDDLE = "TOP_20_PCT", "BOTTOM_20_PCT", "MEIO"

#: The order of each result; a minus stands for descending.
ORDERS = {
    "largest_of_month": ("ano_mes", "-maior_valor_liquido_do_mes"),
    "month_over_month": ("id_cliente", "ano_mes"),
    "first_and_last": ("id_cliente",),
    "spending_bands": ("-valor_liquido_total",),
    "anomalies": ("-z_score",),
    "ticket_comparison": ("id_cliente", "ano_mes"),
}


def in_order(result: DataFrame, name: str) -> DataFrame:
    """A result in its order, by a range shuffle; for those who read it as a report."""
    return result.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[name]))


def largest_of_month(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Each customer's largest transaction of a month that wasn't refunded; the lowest id of equal ones."""
    rows = fact.filter(~F.col("flag_estornada")).select("id_transacao", F.col("id_cliente_na_data").alias("id_cliente"), month_of("dt_transacao").alias("ano_mes"), "valor_liquido")
    place = F.row_number().over(Window.partitionBy("id_cliente", "ano_mes").orderBy(F.desc("valor_liquido"), "id_transacao"))
    top = rows.withColumn("__place", place).filter("__place = 1")
    return top.join(customers.select("id_cliente", "segmento", "cidade"), "id_cliente").select(
        "id_cliente", "ano_mes", F.col("id_transacao").alias("id_transacao_maior_valor"), F.col("valor_liquido").alias("maior_valor_liquido_do_mes"), "segmento", "cidade"
    )


def month_over_month(months: DataFrame) -> DataFrame:
    order = Window.partitionBy("id_cliente").orderBy("ano_mes")
    before = F.lag("valor_liquido").over(order)
    return months.select(
        "id_cliente",
        "ano_mes",
        "valor_liquido",
        before.alias("valor_liquido_mes_anterior"),
        F.lead("valor_liquido").over(order).alias("valor_liquido_mes_seguinte"),
        "qtd_transacoes",
        F.lag("qtd_transacoes").over(order).alias("qtd_transacoes_mes_anterior"),
        ratio(F.col("valor_liquido") - before, before, 2, 100).alias("variacao_valor_pct"),
    )


def first_and_last(fact: DataFrame) -> DataFrame:
    """Each customer's first and last transaction, as aggregates: no window has to hold a customer's rows."""
    row = F.struct("dt_transacao", "id_transacao", "valor")
    ends = fact.groupBy(F.col("id_cliente_na_data").alias("id_cliente")).agg(F.min(row).alias("a"), F.max(row).alias("z"))
    named = ((end, side, column, name) for end, side in (("a", "primeira"), ("z", "ultima")) for column, name in (("id_transacao", "id"), ("dt_transacao", "data"), ("valor", "valor")))
    return ends.select("id_cliente", *(F.col(f"{end}.{column}").alias(f"{side}_transacao_{name}") for end, side, column, name in named))


def spending_bands(months: DataFrame) -> DataFrame:
    """Deciles and percentiles of all customers by net spending; equal spending goes by id."""
    spent = months.groupBy("id_cliente").agg(F.sum("valor_liquido").alias("valor_liquido_total"))
    placed = ranking.with_ntile_and_percent(spent, "valor_liquido_total", "id_cliente", 10, "decil_gasto", "percentil_gasto")
    band = F.when(F.col("decil_gasto") >= 9, TOP).when(F.col("decil_gasto") <= 2, BOTTOM).otherwise(MIDDLE)
    return placed.select("id_cliente", "valor_liquido_total", "decil_gasto", rounded(F.col("percentil_gasto"), 4).alias("percentil_gasto"), band.alias("faixa_gasto"))


def anomalies(fact: DataFrame, least_rows: int = 3) -> DataFrame:
    """Transactions far above their customer's mean, by z-score."""
    stats = fact.groupBy(F.col("id_cliente_na_data").alias("id_cliente")).agg(F.avg("valor").alias("media_valor"), F.stddev_pop("valor").alias("desvio_valor"), F.count(F.lit(1)).alias("__n"))
    stats = stats.filter((F.col("__n") >= least_rows) & (F.col("desvio_valor") > 0)).drop("__n")
    rows = fact.select("id_transacao", F.col("id_cliente_na_data").alias("id_cliente"), "dt_transacao", "valor").join(stats, "id_cliente")
    score = F.try_divide(F.col("valor") - F.col("media_valor"), F.col("desvio_valor"))
    kind = F.lit("NORMAL")
    for bound, name in reversed(ANOMALIES):
        kind = F.when(score >= bound, name).otherwise(kind)
    found = rows.filter(score >= ANOMALIES[-1][0])
    return found.select("id_transacao", "id_cliente", "dt_transacao", "valor", "media_valor", "desvio_valor", rounded(score, 2).alias("z_score"), kind.alias("classificacao_anomalia"))


def ticket_comparison(months: DataFrame, customers: DataFrame) -> DataFrame:
    """Each month's mean ticket against the customer's own history (a window over its months) and against city, segment and month (an aggregate, as such a group may be large)."""
    rows = months.select("id_cliente", "ano_mes", "ticket_medio").join(customers.select("id_cliente", "cidade", "segmento"), "id_cliente")
    peers = rows.groupBy("cidade", "segmento", "ano_mes").agg(F.avg("ticket_medio").alias("ticket_medio_cidade_segmento"))
    rows = rows.withColumn("ticket_medio_historico_proprio", F.avg("ticket_medio").over(Window.partitionBy("id_cliente")))
    rows = rows.join(peers, ["cidade", "segmento", "ano_mes"])
    return rows.select(
        "id_cliente",
        "ano_mes",
        "cidade",
        "segmento",
        F.col("ticket_medio").alias("ticket_medio_do_mes"),
        "ticket_medio_historico_proprio",
        rounded(F.col("ticket_medio") - F.col("ticket_medio_historico_proprio"), 2).alias("diff_vs_proprio_historico"),
        "ticket_medio_cidade_segmento",
        rounded(F.col("ticket_medio") - F.col("ticket_medio_cidade_segmento"), 2).alias("diff_vs_cidade_segmento"),
    )
