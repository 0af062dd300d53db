"""The quality gate, referential checks and deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = "reasons"
REASON_SEPARATOR = "; "


@dataclass(frozen=True)
class Rule:
    """A condition that rows must meet, and the reason given if they don't."""

    reason: str
    condition: Column


@dataclass(frozen=True)
class Gated:
    """Rows that passed; and rows that didn't, with their reasons."""

    valid: DataFrame
    rejected: DataFrame


def failed_reasons(rules: Sequence[Rule], strict: bool = False) -> Column:
    """The reasons of all rules a row fails, in the order of the rules. A condition that is null passes, unless strict."""
    failed = [F.when(~(F.coalesce(r.condition, F.lit(False)) if strict else r.condition), F.lit(r.reason)) for r in rules]
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def with_reasons(df: DataFrame, rules: Sequence[Rule], strict: bool = False, name: str = REASONS) -> DataFrame:
    """Adds the reasons as one string, null for a row that passes. One pass over the rows, for callers that split later."""
    found = failed_reasons(rules, strict)
    return df.withColumn(name, F.when(F.size(found) > 0, F.concat_ws(REASON_SEPARATOR, found)))


def gate(df: DataFrame, rules: Sequence[Rule], strict: bool = False) -> Gated:
    marked = with_reasons(df, rules, strict)
    return Gated(marked.filter(F.col(REASONS).isNull()).drop(REASONS), marked.filter(F.col(REASONS).isNotNull()))


def mark_known(df: DataFrame, parent: DataFrame | None, key: str, parent_key: str | None = None, name: str = "known") -> DataFrame:
    """Adds true where the key occurs in the parent, in any version, else null; without a parent it is null everywhere.

    Whether to broadcast the distinct keys is left to the planner, which knows
    their size when it has them.
    """
    if parent is None:
        return df.withColumn(name, F.lit(None).cast("boolean"))
    keys = parent.select(F.col(parent_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(keys, key, "left").select(*df.columns, name)


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key isn't in the parent, null keys included."""
    return df.join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti").select(*df.columns)


def shared_identity(df: DataFrame, identity: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(rest, shared): rows whose identity belongs to several owners apart from the others. Rows without an identity are in the rest."""
    several = df.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.count_distinct(owner).alias("__owners")).filter("__owners > 1").select(identity)
    return df.join(several, identity, "left_anti").select(*df.columns), df.join(several, identity, "left_semi").select(*df.columns)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by order; give a total order for a result that repeats."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def dedupe_on(df: DataFrame, keys: Sequence[str], date: str, tie: Sequence[str]) -> DataFrame:
    """One row for each key and effective date: the lowest by tie, usually the row's hash."""
    return first_of(df, [*keys, date], [F.col(c).asc_nulls_first() for c in tie])


def latest_by(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str]) -> DataFrame:
    """One row for each key: the latest, then the lowest by tie."""
    return first_of(df, keys, [F.col(time).desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in tie)])
