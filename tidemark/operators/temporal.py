"""Point-in-time joins: each fact with the version that was valid at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "valid_from", "valid_to"


def _renamed(versions: DataFrame, key: str, prefix: str, start: str, end: str) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in versions.columns if c not in (key, start, end)]


def pit_join(facts: DataFrame, versions: DataFrame, key: str, time: str, prefix: str = "", how: str = "left", start: str = START, end: str = END) -> DataFrame:
    """Joins on the key and start <= time < end, a null end being open.

    Columns of versions get the prefix, without its key and interval. With how
    "left" facts without a version keep nulls; "inner" drops them. The key is an
    equi-join condition and the interval a residual one: the planner broadcasts
    a small dimension, and skewed keys are split by adaptive execution.
    """
    dim = versions.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), *_renamed(versions, key, prefix, start, end))
    valid = (F.col(key) == F.col("__key")) & (F.col(time) >= F.col("__start")) & (F.col("__end").isNull() | (F.col(time) < F.col("__end")))
    return facts.join(dim, valid, how).drop("__key", "__start", "__end")


def pit_join_sweep(facts: DataFrame, versions: DataFrame, key: str, time: str, prefix: str = "", start: str = START, end: str = END) -> DataFrame:
    """The left pit_join as one sorted sweep over both sides, for keys with many versions.

    Facts and versions are put in one order by key and time, versions first, and
    the last version before a fact is carried to it. The work for a key is linear
    in its rows, where the range condition would try each fact with each version.
    Intervals of one key mustn't overlap.
    """
    columns = [c for c in versions.columns if c not in (key, start, end)]
    carried = F.struct(F.col(end).alias("__end"), *(F.col(c) for c in columns))
    left = facts.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(1).alias("__fact"), F.struct(*facts.columns).alias("__row"), F.lit(None).cast(_type(versions, carried)).alias("__version"))
    right = versions.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(start).alias("__time"), F.lit(0).alias("__fact"), F.lit(None).cast(_type(facts, F.struct(*facts.columns))).alias("__row"), carried.alias("__version"))
    order = Window.partitionBy("__key").orderBy(F.col("__time").asc_nulls_first(), "__fact").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("__last", F.last("__version", ignorenulls=True).over(order)).filter("__fact = 1")
    valid = F.col("__key").isNotNull() & F.col("__time").isNotNull() & (F.col("__last.__end").isNull() | (F.col("__time") < F.col("__last.__end")))
    return seen.select("__row.*", *(F.when(valid, F.col(f"__last.{c}")).alias(f"{prefix}{c}") for c in columns))


def _type(df: DataFrame, column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def pit_chain(facts: DataFrame, hops: Sequence[tuple[DataFrame, str, str]], time: str) -> DataFrame:
    """Several point-in-time joins, each by a key that the one before resolved: (versions, key in versions, key in facts), keys renamed as needed."""
    for versions, key, fact_key in hops:
        renamed = versions.withColumnRenamed(key, fact_key) if key != fact_key else versions
        facts = pit_join(facts, renamed, fact_key, time)
    return facts
