"""The card-payments pipeline: sources, entities and layers as declarations."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LAYERS, Settings, load_settings
from ..functions import add_missing, not_blank
from ..log import get_logger
from ..operators import history, marts, merge, quality
from ..session import get_session
from ..sources import SourceSpec, ingest
from ..tables import VersionedTable

# The sources' names, files and columns.
SOURCES = {
    s.name: s
    for s in (
        SourceSpec("clientes", "clientes_cdc.csv", "bronze_clientes_cdc", {"id_cliente": "string", "cpf": "string", "nome": "string", "cidade": "string", "estado": "string", "renda": "int", "segmento": "string", "data_atualizacao": "timestamp", "operacao": "string"}),
        SourceSpec("contas", "contas_cdc.csv", "bronze_contas_cdc", {"id_conta": "string", "id_cliente": "string", "tipo_conta": "string", "status_conta": "string", "data_abertura": "date", "data_atualizacao": "timestamp", "operacao": "string"}),
        SourceSpec("cartoes", "cartoes_cdc.csv", "bronze_cartoes_cdc", {"id_cartao": "string", "id_conta": "string", "tipo_cartao": "string", "limite": "int", "status_cartao": "string", "data_atualizacao": "timestamp", "operacao": "string"}),
        SourceSpec("transacoes", "transacoes_*.csv", "bronze_transacoes", {"id_transacao": "string", "id_cartao": "string", "data_transacao": "timestamp", "valor": "double", "mcc": "string", "estabelecimento": "string", "canal": "string", "pais": "string", "moeda": "string"}, {"device_id": "string", "ip_origem": "string"}),
        SourceSpec("eventos_risco", "eventos_risco.csv", "bronze_eventos_risco", {"id_evento": "string", "id_transacao": "string", "tipo_evento": "string", "severidade": "string", "data_evento": "timestamp"}),
        SourceSpec("estornos", "estornos.csv", "bronze_estornos", {"id_estorno": "string", "id_transacao": "string", "data_estorno": "timestamp", "motivo": "string"}),
    )
}

# The domains of the quality rules.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
CPF = r"^\d{3}\.\d{3}\.\d{3}-\d{2}$"
ACCOUNT_STATUS = ("ATIVA", "ENCERRADA")
CARD_STATUS = ("ATIVO", "CANCELADO")
CHANNELS = ("POS", "ECOMMERCE", "APP", "ATM")
EVENT_TYPES = ("FRAUDE", "CHARGEBACK", "SUSPEITA")
REFUND_REASONS = ("CONTESTACAO_CLIENTE", "DUPLICIDADE", "ERRO_PROCESSAMENTO", "ESTORNO_PARCIAL_COMPLEMENTAR", "FRAUDE_CONFIRMADA", "REFERENCIA_INVALIDA")


@dataclass(frozen=True)
class Parent:
    """The table a key must occur in, and the reason given if it doesn't."""

    key: str
    entity: str
    reason: str


@dataclass(frozen=True)
class Entity:
    """A silver table. With attributes it is a history of its key, else one row for each key.

    rules are functions, as columns need a session. extra are columns that older
    files lack; derived ones are added to valid rows.
    """

    name: str
    source: str
    key: str
    rules: Callable[[], Sequence[quality.Rule]]
    columns: Sequence[str]
    attributes: Sequence[str] = ()
    parent: Parent | None = None
    identity: tuple[str, str] | None = None
    extra: dict[str, str] = field(default_factory=dict)
    derived: Callable[[], dict[str, Column]] = dict

    @property
    def table(self) -> str:
        return f"silver_{self.name}"


def _rule(reason: str, condition: Column) -> quality.Rule:
    return quality.Rule(reason, condition)


GOLD = ("gold_fato_transacao", "gold_dim_cliente", "gold_dim_conta", "gold_dim_cartao", "gold_dim_estabelecimento", "gold_cliente_mes", "gold_indicadores_risco", "gold_features_cliente")
LINEAGE = ("source_file", "batch_id", "ingested_at")

# Entities in the order of their keys' dependence, reasons in the order of their rules.
ENTITIES = (
    Entity(
        "clientes", "clientes", "id_cliente",
        lambda: [
            _rule("estado_invalido", F.col("estado").isin(*STATES)),
            _rule("renda_negativa", F.col("renda") >= 0),
            _rule("cpf_formato_invalido", F.col("cpf").rlike(CPF)),
            _rule("nome_vazio", not_blank("nome")),
            _rule("id_cliente_vazio", F.col("id_cliente").isNotNull()),
        ],
        (), ("cpf", "nome", "cidade", "estado", "renda", "segmento"), identity=("cpf", "cpf_duplicado_entre_clientes_distintos"),
    ),
    Entity(
        "contas", "contas", "id_conta",
        lambda: [_rule("id_conta_vazio", F.col("id_conta").isNotNull()), _rule("status_invalido", F.col("status_conta").isin(*ACCOUNT_STATUS))],
        (), ("id_cliente", "tipo_conta", "status_conta", "data_abertura"), Parent("id_cliente", "clientes", "cliente_inexistente"),
    ),
    Entity(
        "cartoes", "cartoes", "id_cartao",
        lambda: [
            _rule("id_cartao_vazio", F.col("id_cartao").isNotNull()),
            _rule("status_invalido", F.col("status_cartao").isin(*CARD_STATUS)),
            _rule("limite_negativo", F.col("limite") >= 0),
        ],
        (), ("id_conta", "tipo_cartao", "limite", "status_cartao"), Parent("id_conta", "contas", "conta_inexistente"),
    ),
    Entity(
        "transacoes", "transacoes", "id_transacao",
        lambda: [
            _rule("id_transacao_vazio", F.col("id_transacao").isNotNull()),
            _rule("valor_invalido", F.col("valor") > 0),
            _rule("cartao_inexistente", F.col("known").isNotNull()),
            _rule("canal_invalido", F.col("canal").isin(*CHANNELS)),
        ],
        ("id_transacao", "id_cartao", "data_transacao", "dt_transacao", "valor", "mcc", "estabelecimento", "canal", "pais", "moeda", "device_id", "ip_origem", "schema_version"),
        parent=Parent("id_cartao", "cartoes", ""), extra={"device_id": "string", "ip_origem": "string"}, derived=lambda: {"dt_transacao": F.to_date("data_transacao")},
    ),
    Entity(
        "eventos_risco", "eventos_risco", "id_evento",
        lambda: [
            _rule("id_evento_vazio", F.col("id_evento").isNotNull()),
            _rule("tipo_evento_invalido", F.col("tipo_evento").isin(*EVENT_TYPES)),
            _rule("severidade_invalida", F.col("severidade").isin(*marts.SEVERITY)),
        ],
        ("id_evento", "id_transacao", "tipo_evento", "severidade", "data_evento"), parent=Parent("id_transacao", "transacoes", "transacao_inexistente"),
    ),
    Entity(
        "estornos", "estornos", "id_estorno",
        lambda: [_rule("id_estorno_vazio", F.col("id_estorno").isNotNull()), _rule("motivo_invalido", F.col("motivo").isin(*REFUND_REASONS))],
        ("id_estorno", "id_transacao", "data_estorno", "motivo"), parent=Parent("id_transacao", "transacoes", "transacao_inexistente"),
    ),
)


def silver(spark: SparkSession, settings: Settings, name: str) -> VersionedTable:
    return VersionedTable(spark, settings.table_path("silver", name))


def gold(spark: SparkSession, settings: Settings, name: str) -> VersionedTable:
    return VersionedTable(spark, settings.table_path("gold", name))


def accepted(spark: SparkSession, settings: Settings, entity: Entity, rows: DataFrame) -> quality.Gated:
    """Rows through the entity's rules, its referential check and its identity check."""
    rows = add_missing(rows, entity.extra)
    rules = list(entity.rules())
    if entity.parent:
        owner = silver(spark, settings, f"silver_{entity.parent.entity}")
        rows = quality.mark_known(rows, owner.read() if owner.exists() else None, entity.parent.key)
        if entity.parent.reason:
            rules.append(quality.Rule(entity.parent.reason, F.col("known").isNotNull()))
    gated = quality.gate(rows, rules)
    valid, rejected = gated.valid.drop("known"), gated.rejected.drop("known")
    if entity.identity:
        column, reason = entity.identity
        valid, shared = quality.shared_identity(valid, column, entity.key)
        rejected = rejected.unionByName(shared.withColumn(quality.REASONS, F.lit(reason)), allowMissingColumns=True)
    return quality.Gated(valid, rejected)


def quarantine(spark: SparkSession, settings: Settings, entity: Entity, rejected: DataFrame) -> int:
    """Keeps rejected rows, once for each row's content and file: {entity, batch, time and reasons}. Returns how many there are now."""
    table = VersionedTable(spark, settings.quarantine_path(entity.name))
    rows = rejected.withColumns({"entity": F.lit(entity.name), "quarantined_at": F.current_timestamp()}).dropDuplicates(["row_hash", "source_file"])
    if rows.isEmpty():
        return table.read().count() if table.exists() else 0
    if table.exists():
        table.replace_keys(rows, ["row_hash", "source_file"])
    else:
        table.overwrite(rows)
    return table.read().count()


def process(spark: SparkSession, settings: Settings, entity: Entity) -> dict:
    """Brings an entity's silver table up to date with its bronze table's new batches.

    A batch stays pending until silver has it, so a run that broke off is made
    good by the next. A history is recomputed from all accepted changes of the
    keys that the batches touch.
    """
    bronze = VersionedTable(spark, settings.table_path("bronze", SOURCES[entity.source].table))
    target = silver(spark, settings, entity.table)
    done = silver(spark, settings, f"_consumed/{entity.name}")
    if not bronze.exists():
        return {"entity": entity.name, "valid": 0, "rejected": 0}
    rows = bronze.read()
    batches = rows.select("batch_id").distinct()
    if done.exists() and not settings.full:
        batches = batches.join(done.read(), "batch_id", "left_anti")
    names = [r[0] for r in batches.collect()]  # one for each run
    if not names:
        return {"entity": entity.name, "valid": 0, "rejected": 0}
    gated = accepted(spark, settings, entity, rows.filter(F.col("batch_id").isin(names)))
    valid = gated.valid.withColumns(entity.derived()) if entity.derived() else gated.valid
    valid, rejected = valid.persist(), gated.rejected.persist()  # each is read several times, and evicted blocks are made again
    try:
        n_valid, n_rejected = valid.count(), rejected.count()
        quarantine(spark, settings, entity, rejected)
        now = {"processed_at": F.current_timestamp()}
        if entity.attributes:
            columns = [entity.key, *entity.attributes, "data_atualizacao", "row_hash", *LINEAGE]
            log = silver(spark, settings, f"_changes/{entity.name}")
            fresh = quality.dedupe_on(valid.select(*columns), [entity.key], "data_atualizacao", ["row_hash"])
            before = log.read_or_empty(fresh.schema) if not settings.full else spark.createDataFrame([], fresh.schema)
            held = before.join(fresh.select(entity.key).distinct(), entity.key, "left_semi")
            touched = quality.dedupe_on(held.unionByName(fresh), [entity.key], "data_atualizacao", ["row_hash"])
            versions = history.build_timeline(touched, entity.key, entity.attributes, "data_atualizacao", ["row_hash"]).drop("row_hash").withColumns(now)
            if target.exists() and not settings.full:
                target.replace_keys(versions, [entity.key])
            else:
                target.overwrite(versions)
            if settings.full or not log.exists():
                log.overwrite(fresh)
            else:
                log.append(fresh)  # a change that comes again is dropped where the log is read
        else:
            latest = quality.latest_by(valid, [entity.key], "ingested_at", ["row_hash"]).select(*entity.columns, *LINEAGE).withColumns(now)
            if target.exists() and not settings.full:
                target.upsert(latest, [entity.key])
            else:
                target.overwrite(latest)
        done.append(spark.createDataFrame([(n,) for n in names], "batch_id string"))
    finally:
        valid.unpersist()
        rejected.unpersist()
    return {"entity": entity.name, "valid": n_valid, "rejected": n_rejected}


def build_gold(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """The fact, dimensions and marts, in that order. Incremental runs rebuild what their batch touches: late refunds and events reach their transaction, and a changed month the one after it."""
    read = lambda name: silver(spark, settings, name).read()
    empty = {"silver_eventos_risco": "id_evento string, id_transacao string, tipo_evento string, severidade string, data_evento timestamp, batch_id string", "silver_estornos": "id_estorno string, id_transacao string, data_estorno timestamp, motivo string, batch_id string"}
    transactions, cards, accounts, customers = (read(f"silver_{n}") for n in ("transacoes", "cartoes", "contas", "clientes"))
    events, refunds = (silver(spark, settings, n).read_or_empty(schema) for n, schema in empty.items())
    stamp = {"batch_id": F.lit(settings.batch_id), "processed_at": F.current_timestamp()}
    store = gold(spark, settings, "gold_fato_transacao")
    touched = None
    if store.exists() and not settings.full:
        mine = F.col("batch_id") == settings.batch_id
        touched = marts.facts_touched(transactions.filter(mine), refunds.filter(mine), events.filter(mine))
    scope = transactions if touched is None else transactions.join(touched, "id_transacao", "left_semi")
    fact = marts.build_fact(scope, cards, accounts, customers, refunds, events).withColumns(stamp)
    counts = {}
    if touched is None:
        store.overwrite(fact)
    else:
        store.upsert(fact, ["id_transacao"])
    current = history.current
    first_seen = silver(spark, settings, "_changes/clientes").read().groupBy("id_cliente").agg(F.min("data_atualizacao").alias("cliente_desde"))
    dims = {
        "gold_dim_cliente": current(customers).join(first_seen, "id_cliente", "left").select("id_cliente", "cpf", "nome", "cidade", "estado", "renda", "segmento", "cliente_desde"),
        "gold_dim_conta": current(accounts).select("id_conta", "id_cliente", "tipo_conta", "status_conta", "data_abertura"),
        "gold_dim_cartao": current(cards).select("id_cartao", "id_conta", "tipo_cartao", "limite", "status_cartao"),
        "gold_dim_estabelecimento": marts.merchants(transactions),
    }
    for name, dim in dims.items():
        gold(spark, settings, name).overwrite(dim)
    fact = store.read()
    groups = None if touched is None else marts.affected_months(fact, touched)
    for name, mart in (("gold_cliente_mes", marts.customer_months(fact, groups)), ("gold_indicadores_risco", marts.risk_months(fact, events, groups))):
        table = gold(spark, settings, name)
        if groups is None or not table.exists():
            table.overwrite(mart.withColumns(stamp))
        else:
            table.replace_keys(mart.withColumns(stamp), ["id_cliente", "ano_mes"])
    features = marts.customer_features(
        gold(spark, settings, "gold_dim_cliente").read(), fact, gold(spark, settings, "gold_cliente_mes").read(), gold(spark, settings, "gold_indicadores_risco").read(), settings.as_of or dt.date.today()
    )
    gold(spark, settings, "gold_features_cliente").overwrite(features.withColumns(stamp))
    for name in GOLD:
        counts[name] = gold(spark, settings, name).read().count()
    return counts


def run(spark: SparkSession, settings: Settings, layers: Sequence[str] = LAYERS) -> dict:
    """Runs the layers in order; returns what each did."""
    unknown = set(layers) - set(LAYERS)
    if unknown:
        raise ValueError(f"no such layer: {', '.join(sorted(unknown))}")
    log = get_logger("tidemark.cards", batch_id=settings.batch_id)
    out: dict = {}
    if "bronze" in layers:
        out["bronze"] = [ingest(spark, settings, spec) for spec in SOURCES.values()]
        log.info("bronze is up to date", sources=out["bronze"])
    if "silver" in layers:
        out["silver"] = [process(spark, settings, entity) for entity in ENTITIES]
        log.info("silver is up to date", entities=out["silver"])
    if "gold" in layers:
        out["gold"] = build_gold(spark, settings)
        log.info("gold is up to date", tables=out["gold"])
    return out


def all_tables(spark: SparkSession, settings: Settings) -> list[tuple[str, str, VersionedTable]]:
    """(layer, name, table) of the tables that are there."""
    names = {"bronze": [s.table for s in SOURCES.values()], "silver": [e.table for e in ENTITIES], "gold": list(GOLD)}
    found = ((layer, name, VersionedTable(spark, settings.table_path(layer, name))) for layer, listed in names.items() for name in listed)
    return [entry for entry in found if entry[2].exists()]


def register_views(spark: SparkSession, settings: Settings) -> list[str]:
    """Temp views of all tables there are, under their own names."""
    for _, name, table in (found := all_tables(spark, settings)):
        table.register(name)
    return [name for _, name, _ in found]


def publish(spark: SparkSession, settings: Settings) -> list[str]:
    """Views of all tables there are in the catalogue, a database for each layer."""
    return [table.publish(settings.schema_of(layer), name) for layer, name, table in all_tables(spark, settings)]


def main(argv: Sequence[str] | None = None) -> int:
    """python -m tidemark.plans.cards --base-path ... Options that aren't given leave the environment and the defaults in force."""
    parser = argparse.ArgumentParser(prog="tidemark")
    for name in ("base_path", "input_path", "catalog", "bronze_schema", "silver_schema", "gold_schema", "environment", "run_mode", "batch_id", "as_of"):
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name)
    parser.add_argument("--layers", default=",".join(LAYERS))
    given = vars(parser.parse_args(argv))
    layers = [layer.strip() for layer in given.pop("layers").split(",") if layer.strip()]
    settings = load_settings(**given)
    log = get_logger("tidemark.cards", batch_id=settings.batch_id)
    try:
        run(get_session(), settings, layers)
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
