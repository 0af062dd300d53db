"""Ranks over many rows without a single-task sort.

A window without a partition, or over a group that may be large, puts all its
rows in one task. Here rows are dealt to ranges, ranked within a range, and
offset by the sizes of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle

#: Rows of a range, on average. What the driver holds is a row for each range.
ROWS_PER_RANGE = 50_000
#: Ranges at most that a group's values are dealt to.
RANGES = 1000
#: A value with more than one in so many rows is common.
COMMON = 1000


def global_positions(df: DataFrame, value: str, tie: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """(rows with __position from 1 by value then tie, and __below, the rows with a smaller value; number of rows). Nulls come first.

    Ranges are of value and tie together, so rows that share a value are spread
    as well. The dealt rows are settled, so that a range stays what it was when
    it was counted.
    """
    df = settle(df)
    rows = df.count()
    order = [F.col(value).asc_nulls_first(), F.col(tie).asc_nulls_first()]
    dealt = settle(df.repartitionByRange(max(1, -(-rows // rows_per_range)), *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range")
    ranked = dealt.withColumns({"__row": F.row_number().over(within.orderBy(*order)), "__rank": F.rank().over(within.orderBy(order[0])) - 1})
    last = F.max(F.struct(F.col(value).isNotNull(), F.col(value).alias("v"), F.col("__rank").alias("r")))
    ranges = ranked.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min_by(value, "__row").alias("first"), last["v"].alias("last"), last["r"].alias("before_last"))
    starts, seen, previous = [], 0, None  # previous: the last value so far, and the rows below it
    for row in sorted(ranges.collect(), key=lambda r: r["__range"]):
        below_first = previous[1] if previous and previous[0] == row["first"] else seen
        starts.append((row["__range"], seen, row["first"], below_first))
        previous = row["last"], below_first if row["first"] == row["last"] else seen + row["before_last"]
        seen += row["n"]
    kind = df.schema[value].dataType.simpleString()
    known = F.broadcast(df.sparkSession.createDataFrame(starts, f"__range int, __seen long, __first {kind}, __below_first long"))  # a row for each range
    below = F.when(F.col(value).eqNullSafe(F.col("__first")), F.col("__below_first")).otherwise(F.col("__rank") + F.col("__seen"))
    placed = ranked.join(known, "__range").withColumns({"__position": (F.col("__row") + F.col("__seen")).cast("long"), "__below": below.cast("long")})
    return placed.select(*df.columns, "__position", "__below"), rows


def ntile_of(position: Column, rows: int, tiles: int) -> Column:
    """The tile of a position from 1: the first rows % tiles tiles have one row more."""
    small, more = divmod(rows, tiles)
    edge = more * (small + 1)
    late = F.lit(more + 1) if small == 0 else F.floor((position - edge - 1) / small) + more + 1
    return F.when(position <= edge, F.floor((position - 1) / (small + 1)) + 1).otherwise(late).cast("int")


def with_ntile(df: DataFrame, value: str, tie: str, tiles: int, name: str) -> DataFrame:
    placed, rows = global_positions(df, value, tie)
    return placed.withColumn(name, ntile_of(F.col("__position"), rows, tiles)).drop("__position", "__below")


def with_ntile_and_percent(df: DataFrame, value: str, tie: str, tiles: int, tile_name: str, percent_name: str) -> DataFrame:
    placed, rows = global_positions(df, value, tie)
    percent = F.lit(0.0) if rows < 2 else F.col("__below") / F.lit(float(rows - 1))
    return placed.withColumns({tile_name: ntile_of(F.col("__position"), rows, tiles), percent_name: percent.cast("double")}).drop("__position", "__below")


def _bucket(value: Column, bounds: list[float], low: int, high: int) -> Column:
    """The number of bounds below a value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value > bounds[middle], _bucket(value, bounds, middle + 1, high)).otherwise(_bucket(value, bounds, low, middle))


def with_percent_rank(df: DataFrame, group: str, value: str, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds percent_rank of a number within a group of any size; nulls come first, and a null group is a group.

    Different values are ranked, with their counts, in ranges of a group; so rows
    that share a value are one row there, and the ranks come back by a join, for
    common values a broadcast of fewer than COMMON rows.
    """
    df = settle(df)
    rows = df.count()
    counts = settle(df.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("n")))
    ranges = max(1, min(RANGES, rows // rows_per_range))
    bounds = sorted(set(counts.stat.approxQuantile("__v", [k / ranges for k in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    ranged = counts.withColumn("__range", F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(_bucket(F.col("__v"), bounds, 0, len(bounds))))
    whole = Window.partitionBy("__g")  # of at most RANGES + 1 rows
    sizes = ranged.groupBy("__g", "__range").agg(F.sum("n").alias("size"))
    sizes = sizes.select(F.col("__g").alias("__h"), F.col("__range").alias("__k"), F.sum("size").over(whole.orderBy("__range")).alias("upto"), "size", F.sum("size").over(whole).alias("total"))
    own = Window.partitionBy("__g", "__range").orderBy(F.col("__v").asc_nulls_first())
    ranked = ranged.withColumn("below", F.sum("n").over(own) - F.col("n")).join(sizes, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__range") == F.col("__k")))
    percent = F.when(F.col("total") > 1, (F.col("upto") - F.col("size") + F.col("below")) / (F.col("total") - 1)).otherwise(F.lit(0.0))
    ranked = settle(ranked.select("__g", "__v", "n", percent.alias(name)))
    common = F.col("n") * COMMON > rows
    same = F.col(group).eqNullSafe(F.col("__g")) & F.col(value).eqNullSafe(F.col("__v"))
    few = F.broadcast(ranked.filter(common).drop("n"))
    rest = df.join(few.drop(name), same, "left_anti").join(ranked.filter(~common).drop("n"), same)
    return df.join(few, same).unionByName(rest).drop("__g", "__v")
