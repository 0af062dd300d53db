"""Slowly changing dimensions of type 2: timelines from change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint

#: The first version of a key is valid from here, so that facts older than its first change have one.
SENTINEL = "1970-01-02 00:00:00"
HISTORY = ("valid_from", "valid_to", "is_current", "version", "attribute_hash")


def build_timeline(changes: DataFrame, key: str, attributes: Sequence[str], date: str, tie: Sequence[str] = (), skip_nulls: bool = False) -> DataFrame:
    """Versions from a key's changes, whatever their order of arrival.

    Changes are ordered by date, then by the hash of their attributes, then by
    tie. A change that equals the one before it makes no version. Validity is
    half open; the last version has no end and is current. All windows share one
    partitioning and order, so the rows of a key are shuffled and sorted once.
    """
    hashed = changes.withColumn("attribute_hash", fingerprint(attributes, skip_nulls))
    order = Window.partitionBy(key).orderBy(date, "attribute_hash", *tie)
    before = F.lag("attribute_hash").over(order)
    turned = hashed.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("attribute_hash"))).drop("__before")
    kind = changes.schema[date].dataType
    version = F.row_number().over(order).cast("int")
    following = F.lead(date).over(order)
    return turned.withColumns(
        {
            "version": version,
            "valid_from": F.when(version == 1, F.lit(SENTINEL).cast(kind)).otherwise(F.col(date)),
            "valid_to": following,
            "is_current": following.isNull(),
        }
    )


def affected_timelines(history: DataFrame, incoming: DataFrame, key: str, attributes: Sequence[str], date: str, tie: Sequence[str] = (), skip_nulls: bool = False) -> DataFrame:
    """New timelines of the keys that occur in incoming, from all their changes.

    history is the change log so far, not the versions: versions leave out
    repeated states, and a late change between two equal ones would lose the
    return to the old state.
    """
    keys = incoming.select(key).distinct()
    known = history.join(keys, key, "left_semi").select(*history.columns)
    return build_timeline(known.unionByName(incoming, allowMissingColumns=True), key, attributes, date, tie, skip_nulls)


def current(versions: DataFrame) -> DataFrame:
    return versions.filter("is_current")
