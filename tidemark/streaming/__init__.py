"""Streams: file sources that are upserted into versioned tables, and deduplicated within a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import quality
from ..tables import VersionedTable


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under a path, or of one file. The schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{folder}/{name}*")


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def upsert_batch(batch: DataFrame, store: VersionedTable, keys: Sequence[str], time: str, tie: Sequence[str]) -> None:
    """Upserts the latest row of each key, unless the table has a later one: a batch that is tried again, or comes late, changes nothing."""
    latest = quality.latest_by(batch, keys, time, tie)
    if store.exists():
        held = store.read().join(latest.select(*keys), list(keys), "left_semi").select(*batch.columns)
        latest = quality.latest_by(held.unionByName(latest), keys, time, tie)
        store.upsert(latest, keys)
    else:
        store.overwrite(latest)


def upsert_stream(spark: SparkSession, path: str, store: VersionedTable, keys: Sequence[str], time: str, tie: Sequence[str], columns: Sequence[str], checkpoint: str, files_per_batch: int | None = None) -> None:
    """Takes in the files that are there now, in micro-batches, and stops; the checkpoint remembers them."""
    stream = parquet_stream(spark, path, files_per_batch).select(*columns)
    running = stream.writeStream.foreachBatch(lambda batch, _: upsert_batch(batch, store, keys, time, tie)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def first_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark, on a stream; its state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
