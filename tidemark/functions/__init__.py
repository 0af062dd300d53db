"""Column functions: fingerprints, ordinals, guarded arithmetic, calendar buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null in a fingerprint; no value holds it, as it has a control character.
NULL_MARK = "\x00"
SEPARATOR = "\x1f"


def fingerprint(columns: Sequence[str], skip_nulls: bool = False) -> Column:
    """SHA-256 of the columns' strings in the given order.

    With skip_nulls nulls are left out, so that a column that appears later
    doesn't change the hash of rows without it, but (a, null, b) and (a, b, null)
    are the same; without it each null has its place.
    """
    parts = [F.col(c).cast("string") for c in columns]
    if not skip_nulls:
        parts = [F.coalesce(p, F.lit(NULL_MARK)) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def not_blank(column: str) -> Column:
    return F.col(column).isNotNull() & (F.length(F.trim(column)) > 0)


def month_of(column: str) -> Column:
    """yyyy-MM of a date or timestamp."""
    return F.date_format(column, "yyyy-MM")


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half up, as a decimal of six digits, so that what sums and quotients leave in the last bits doesn't decide."""
    return F.round(value.cast("decimal(38,6)"), digits).cast("double")


def ratio(over: Column, under: Column, digits: int | None = None, scale: int = 1) -> Column:
    """over * scale / under, null where under is null or 0; rounded, as a double, if digits are given."""
    value = F.try_divide(over * scale if scale != 1 else over, under)
    return value if digits is None else rounded(value, digits)


def rank_of(column: Column | str, order: Mapping[str, int]) -> Column:
    """The rank of an ordinal label; null for a label without one."""
    pairs = [F.lit(x) for pair in order.items() for x in pair]
    return F.create_map(*pairs)[F.col(column) if isinstance(column, str) else column]


def label_of(rank: Column | str, order: Mapping[str, int]) -> Column:
    return rank_of(rank, {v: k for k, v in order.items()})


def max_label(column: str, order: Mapping[str, int]) -> Column:
    """Aggregate: the label of the highest rank."""
    return label_of(F.max(rank_of(column, order)), order)


def add_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds columns that df lacks as typed nulls."""
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projects to a contract's columns, in its order."""
    return df.select(*columns)
