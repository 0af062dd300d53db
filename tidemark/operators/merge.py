"""Upsert and replacement as plans: an anti-join and a union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """Staged rows share a key, so that an update would be ambiguous."""


def _matching(staged: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The staged keys, and the condition that a row has one; nulls are equal to nulls."""
    marked = staged.select(*(F.col(k).alias(f"__staged_{k}") for k in keys)).distinct()
    return marked, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__staged_{k}")) for k in keys))


def with_keys(current: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of current whose key is staged."""
    return current.join(*_matching(staged, keys), "left_semi")


def without_keys(current: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of current whose key isn't staged."""
    return current.join(*_matching(staged, keys), "left_anti")


def replace_keys(current: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the staged keys are replaced by the staged rows."""
    return without_keys(current, staged, keys).unionByName(staged, allowMissingColumns=True)


def upsert(current: DataFrame, staged: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Staged rows update the rows with their key, or are inserted. With check, staged keys must be unique."""
    if check and not staged.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise DuplicateKeys(f"several staged rows share {', '.join(keys)}")
    return replace_keys(current, staged, keys)
