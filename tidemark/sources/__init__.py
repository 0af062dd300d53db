"""File sources: discovery by content hash, CSV scans, ingestion metadata and incremental ingestion."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import fingerprint
from ..tables import VersionedTable

METADATA = ("row_hash", "schema_version", "source_file", "ingested_on", "ingested_at", "batch_id")
CONTROL = "source string, file string, file_hash string, batch_id string, status string, processed_at timestamp"
SUCCESS = "SUCCESS"
#: The first line of a file has so many bytes at most.
HEADER_BYTES = 1 << 16
#: A longer file is hashed by its lines.
WHOLE_BYTES = 256 << 20


@dataclass(frozen=True)
class SourceSpec:
    """A source: its files, its table, and the columns that make up schema version 1, with their types. Further columns are read as strings unless named in extra."""

    name: str
    glob: str
    table: str
    columns: Mapping[str, str]
    extra: Mapping[str, str] | None = None


def discover(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, file, file_hash, header) of matching files under root, hashed by the executors. file is relative to root.

    A file of up to WHOLE_BYTES is hashed as it is; of a longer one, the number
    and the hashes of its lines are, in parts, as no row could hold it. A first
    line that doesn't end within HEADER_BYTES is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    begin = F.substring("content", 1, HEADER_BYTES)
    line = F.substring_index(F.decode(begin, "UTF-8"), "\n", 1)
    ended = F.when((F.col("length") > HEADER_BYTES) & ~F.contains(begin, F.lit(b"\n")), F.raise_error(F.concat(F.lit("the header is too long: "), "path"))).otherwise(line)
    named = F.regexp_extract("path", f".*?{base}/(.*)$", 1).alias("file")
    header = F.regexp_replace(ended, "[\r﻿]", "").alias("header")
    small = found.filter(F.col("length") <= WHOLE_BYTES).select("path", named, F.sha2("content", 256).alias("file_hash"), header)
    long_ = [row["path"] for row in found.filter(F.col("length") > WHOLE_BYTES).select("path").collect()]  # names of files
    if not long_:
        return small
    lines = spark.read.text(long_).select(F.col("_metadata.file_path").alias("path"), "value", (F.col("_metadata.file_block_start") == 0).alias("starts"), F.monotonically_increasing_id().alias("at"))
    mark = F.xxhash64("value").cast("decimal(20,0)")
    first = F.min_by("value", F.when(F.col("starts"), F.col("at")))
    each = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("s"), F.bit_xor(F.xxhash64("value", F.lit(1))).alias("x"), first.alias("head"))
    checked = F.when(F.octet_length("head") > HEADER_BYTES, F.raise_error(F.concat(F.lit("the header is too long: "), "path"))).otherwise(F.col("head"))
    return small.unionByName(each.select("path", named, F.sha2(F.concat_ws("/", "n", "s", "x"), 256).alias("file_hash"), F.regexp_replace(checked, "[\r﻿]", "").alias("header")))


def pending(found: DataFrame, control: DataFrame, source: str, full: bool = False) -> DataFrame:
    """Files that weren't processed with this content; all of them in full mode."""
    if full:
        return found
    done = control.filter((F.col("source") == source) & (F.col("status") == SUCCESS)).select("file", "file_hash").distinct()
    return found.join(done, ["file", "file_hash"], "left_anti")


def read_csv(spark: SparkSession, paths: Sequence[str], header: str, spec: SourceSpec) -> DataFrame:
    """Scans files of one header with declared types, each row with its file's path."""
    names = next(csv.reader([header]))
    kinds = {**(spec.extra or {}), **spec.columns}
    schema = ", ".join(f"`{name}` {kinds.get(name, 'string')}" for name in names)
    scan = spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").schema(schema).csv(list(paths))
    return scan.select("*", F.col("_metadata.file_path").alias("__path"), F.lit(2 if set(names) - set(spec.columns) else 1).alias("schema_version"))


def with_metadata(df: DataFrame, batch_id: str) -> DataFrame:
    """Adds the row's hash over its source columns by name, and when and in which batch it came. Null fields are left out of the hash, so that a column that appears later doesn't change it."""
    columns = sorted(c for c in df.columns if c not in ("schema_version", "source_file"))
    return df.withColumns({"row_hash": fingerprint(columns, skip_nulls=True), "ingested_on": F.current_date(), "ingested_at": F.current_timestamp(), "batch_id": F.lit(batch_id)})


def ingest(spark: SparkSession, settings: Settings, spec: SourceSpec) -> dict:
    """Appends pending files to the source's table and registers them: {source, files, rows}.

    Files of one header share a scan. Rows are counted as they are written. The
    table's commit notes its files, so those of a run that broke off before it
    registered them are registered by the next, and aren't read twice. In full
    mode the table is overwritten, since all files are read again.
    """
    control = VersionedTable(spark, settings.table_path("bronze", "_control"))
    table = VersionedTable(spark, settings.table_path("bronze", spec.table))

    def register(named: list, batch_id: str) -> None:
        done = spark.createDataFrame([(spec.name, file, file_hash, batch_id, SUCCESS) for file, file_hash in named], "source string, file string, file_hash string, batch_id string, status string")
        control.append(done.withColumn("processed_at", F.current_timestamp()))

    note = table.note()
    if note:
        known = {tuple(r) for r in control.read_or_empty(CONTROL).filter((F.col("source") == spec.name) & (F.col("batch_id") == note["batch_id"])).select("file", "file_hash").collect()}  # of one batch
        if missing := [pair for pair in note["files"] if tuple(pair) not in known]:
            register(missing, note["batch_id"])
    found = discover(spark, settings.input_path, spec.glob)
    files = pending(found, control.read_or_empty(CONTROL), spec.name, settings.full).collect()  # names and hashes only
    if not files:
        return {"source": spec.name, "files": 0, "rows": 0}
    by_header: dict[str, list[str]] = {}
    for row in files:
        by_header.setdefault(row["header"], []).append(row["path"])
    scans = [read_csv(spark, paths, header, spec) for header, paths in sorted(by_header.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    names = spark.createDataFrame([(r["path"], r["file"]) for r in files], "__named string, source_file string")
    decoded = rows.withColumn("__named", F.url_decode(F.replace("__path", F.lit("+"), F.lit("%2B")))).join(names.withColumn("__named", F.url_decode(F.replace("__named", F.lit("+"), F.lit("%2B")))), "__named").drop("__named", "__path")
    seen = Observation()
    batch = with_metadata(decoded, settings.batch_id).observe(seen, F.count(F.lit(1)).alias("rows"))
    named = [(r["file"], r["file_hash"]) for r in files]
    note = {"batch_id": settings.batch_id, "files": named}
    if settings.full:
        table.overwrite(batch, note=note)
    else:
        table.append(batch, note=note)
    register(named, settings.batch_id)
    return {"source": spec.name, "files": len(files), "rows": seen.get["rows"]}


def control_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """The files that were processed, with their hashes, batches and times; empty before the first run."""
    return VersionedTable(spark, settings.table_path("bronze", "_control")).read_or_empty(CONTROL)


def read_batch(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    """The current batch's rows of a bronze table; all of them in full mode. A table that isn't there is an error."""
    rows = VersionedTable(spark, settings.table_path("bronze", table)).read()
    return rows if settings.full else rows.filter(F.col("batch_id") == settings.batch_id)
