"""Versioned tables: immutable Parquet files and a manifest for each version.

An upsert or a replacement rewrites only the files that hold one of its keys;
the others go on to the next version as they are. Manifests keep the ranges of
keys of the files that merges write, so that a merge reads the keys of those
files only that may hold one of its own.

A commit writes data first, then the next manifest under another name, and
renames it, which fails if another writer has made that version meanwhile. So a
version is whole or isn't there, wherever a writer dies. Readers resolve one
version, so plans made before a commit still read what they planned. Paths are
opened through Hadoop's file systems; the rename must be atomic there, as it is
on HDFS (object stores need a committer that puts conditionally).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .checkpoints import settle
from .operators import merge


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"_versions/{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._numbers())

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        return max(self._numbers(), default=0)

    def history(self) -> list[dict]:
        return [{k: m[k] for k in ("version", "operation", "committed_at")} for m in map(self._manifest, self._numbers())]

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or a given one. Columns that older files lack are null."""
        number = self.version() if version is None else version
        if not number:
            raise FileNotFoundError(f"no table at {self.path}")
        manifest = self._manifest(number)
        schema = StructType.fromJson(manifest["schema"])
        return self._scan(manifest["files"], schema)

    def _scan(self, files: Sequence[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{file}" for file in files))

    def read_or_empty(self, schema: StructType | str) -> DataFrame:
        return self.read() if self.exists() else self.spark.createDataFrame([], schema)

    def note(self, version: int | None = None) -> dict:
        """What the writer of a version, the latest by default, noted with it."""
        number = self.version() if version is None else version
        return self._manifest(number).get("note", {}) if number else {}

    def overwrite(self, df: DataFrame, operation: str = "overwrite", base: int | None = None, note: dict | None = None) -> int:
        """The rows of df become the next version; if base is given, it must be the latest one still."""
        return self._commit(self.version() if base is None else base, df, operation, [], StructType(), note)

    def append(self, df: DataFrame, operation: str = "append", note: dict | None = None) -> int:
        """Adds files; older ones aren't rewritten. New columns are added to the schema; a column that changes its type is an error."""
        base = self.version()
        files, schema = self._state(base)
        return self._commit(base, df, operation, files, schema, note)

    def upsert(self, df: DataFrame, keys: Sequence[str]) -> int:
        """Rows update those with their key, or are added. Their keys must be unique."""
        return self._merge(df, keys, "upsert", merge.upsert)

    def replace_keys(self, df: DataFrame, keys: Sequence[str]) -> int:
        """All rows with the keys of df are replaced by the rows of df."""
        return self._merge(df, keys, "replace", merge.replace_keys)

    def _state(self, version: int) -> tuple[list[str], StructType]:
        if not version:
            return [], StructType()
        manifest = self._manifest(version)
        return manifest["files"], StructType.fromJson(manifest["schema"])

    def _merge(self, df: DataFrame, keys: Sequence[str], operation: str, combine) -> int:
        base = self.version()
        files, schema = self._state(base)
        df = settle(df)  # read three times below, and must be the same each time
        if not files:
            return self._commit(base, combine(df.limit(0), df, keys), operation, [], schema, keys=keys)
        touched: set[str] = set()
        if near := self._may_hold(base, files, df, keys):
            named = self._scan(near, schema).select(*keys, F.regexp_extract("_metadata.file_path", "(data/[^/]+/[^/]+)$", 1).alias("__file"))
            touched = {row["__file"] for row in merge.with_keys(named, df, keys).select("__file").distinct().collect()}  # names of files
        rewritten = combine(self._scan(sorted(touched), schema), df, keys)
        return self._commit(base, rewritten, operation, [f for f in files if f not in touched], schema, keys=keys)

    def _may_hold(self, base: int, files: Sequence[str], df: DataFrame, keys: Sequence[str]) -> list[str]:
        """The files whose ranges of keys, as far as the manifest has them, meet those of df."""
        ranges = self._manifest(base).get("ranges", {})
        known = [k for k in keys if any(k in ranges.get(f, {}) for f in files)]
        if not known:
            return list(files)
        staged = df.agg(*(F.min(k).cast(_held_as(df.schema[k].dataType)).alias(f"a_{k}") for k in known), *(F.max(k).cast(_held_as(df.schema[k].dataType)).alias(f"z_{k}") for k in known), *(F.count_if(F.col(k).isNull()).alias(f"n_{k}") for k in known)).first()

        def meets(file: str) -> bool:
            for k in known:
                low, high, nulls = ranges.get(file, {}).get(k, (None, None, True))
                if nulls and (staged[f"n_{k}"] or low is None):
                    continue
                if low is None or staged[f"a_{k}"] is None or staged[f"z_{k}"] < low or high < staged[f"a_{k}"]:
                    return False
            return True

        return [f for f in files if meets(f)]

    def _ranges(self, folder: str, schema: StructType, keys: Sequence[str]) -> dict[str, dict[str, list]]:
        """(lowest, highest, whether any is null) of keys of whole numbers, strings and dates in each file of a folder."""
        kinds = {k: _held_as(schema[k].dataType) for k in keys}
        named = [k for k, kind in kinds.items() if kind]
        if not named:
            return {}
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("__file"))
        found = rows.agg(*(F.struct(F.min(k).cast(kinds[k]).alias("a"), F.max(k).cast(kinds[k]).alias("z"), (F.count_if(F.col(k).isNull()) > 0).alias("n")).alias(k) for k in named))
        held = {f"{folder}/{s.getPath().getName()}": {k: [None, None, False] for k in named} for s in self._list(folder)}  # of files without rows
        return held | {f"{folder}/{row['__file']}": {k: list(row[k]) for k in named} for row in found.collect()}  # a row for each file

    def _commit(self, base: int, df: DataFrame, operation: str, kept: Sequence[str], schema: StructType, note: dict | None = None, keys: Sequence[str] = ()) -> int:
        known = {field.name: field.dataType for field in schema}
        schema = StructType(list(schema.fields))
        for field in df.schema:
            if field.name not in known:
                schema = schema.add(field.name, field.dataType, True)
            elif known[field.name] != field.dataType:
                raise TypeError(f"{field.name}: {known[field.name].simpleString()} can't become {field.dataType.simpleString()}")
        folder = f"data/{uuid.uuid4()}"
        df.write.parquet(f"{self.path}/{folder}")
        names = (status.getPath().getName() for status in self._fs.listStatus(self._path(folder)))
        manifest = {
            "version": base + 1,
            "operation": operation,
            "committed_at": datetime.now(timezone.utc).isoformat(),
            "files": [*kept, *(f"{folder}/{name}" for name in sorted(names) if name.endswith(".parquet"))],
            "schema": schema.jsonValue(),
            "note": note or {},
            "ranges": {f: r for f, r in (self._manifest(base).get("ranges", {}) if base and kept else {}).items() if f in set(kept)} | self._ranges(folder, schema, keys),
        }
        self._fs.mkdirs(self._path("_versions"))
        draft = self._path(f"_versions/.{uuid.uuid4()}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._publish(draft, self._path(f"_versions/{base + 1:08d}.json"))
        return base + 1

    def _publish(self, draft, final) -> None:
        """Renames a file, unless the new name is taken."""
        hadoop = self._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            files.rename(draft, final, options)
        except Exception as error:
            self._fs.delete(draft, False)
            if not self._fs.exists(final):
                raise
            raise ConcurrentCommit(f"{self.path} has {final.getName()} already") from error

    def compact(self, files: int = 1) -> int:
        """Rewrites the latest version into so many files, as a version of its own."""
        base = self.version()
        return self.overwrite(self.read(base).repartition(files), "compact", base)

    def vacuum(self, keep: int = 1, least_hours: float = 24.0) -> list[str]:
        """Deletes all versions but the last `keep`, and the files that none of these has, also those of writers that died; returns what went.

        Whatever is younger than least_hours stays, for writers that haven't
        committed and readers that began before.
        """
        numbers, before = self._numbers(), datetime.now(timezone.utc).timestamp() * 1000 - least_hours * 3_600_000
        old, kept = numbers[:-keep], numbers[-keep:]
        live = {file for number in kept for file in self._manifest(number)["files"]}
        drafts = [s for s in self._list("_versions") if s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".crc")]
        manifests = [s for s in self._list("_versions") if s.getPath().getName() in {f"{n:08d}.json" for n in old}]
        gone = [f"_versions/{s.getPath().getName()}" for s in (*manifests, *drafts) if s.getModificationTime() < before]
        for folder in (f"data/{s.getPath().getName()}" for s in self._list("data")):
            held = [s for s in self._list(folder) if s.getPath().getName().endswith(".parquet")]
            dead = [s for s in held if f"{folder}/{s.getPath().getName()}" not in live and s.getModificationTime() < before]
            if held and len(dead) == len(held):
                gone.append(folder)
            else:
                gone += [f"{folder}/{s.getPath().getName()}" for s in dead]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return gone

    def _list(self, folder: str) -> list:
        return list(self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def register(self, name: str) -> None:
        """Makes the latest version readable in SQL under a name."""
        self.read().createOrReplaceTempView(name)

    def publish(self, database: str, name: str) -> str:
        """Makes the version that is latest now a view in a database of the catalogue, which is made if it isn't there; returns the view's name."""
        if not self.exists():
            raise FileNotFoundError(f"no table at {self.path}")
        files, columns = self._state(self.version())
        folders = sorted({file.rpartition("/")[0] for file in files})
        live = sum(status.getPath().getName().endswith(".parquet") for folder in folders for status in self._fs.listStatus(self._path(folder)))
        if live != len(files):  # a view names whole folders
            self.overwrite(self.read(), "compact")
            return self.publish(database, name)
        parts = []
        for folder in folders:
            path = f"{self.path}/{folder}"
            held = set(self.spark.read.parquet(path).columns)
            listed = ", ".join(f"`{f.name}`" if f.name in held else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in columns)
            parts.append(f"SELECT {listed} FROM parquet.`{path}`")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS {' UNION ALL '.join(parts)}")
        return f"{database}.{name}"

    def publish_table(self, database: str, name: str) -> str:
        """Makes the latest version a table of the catalogue: over its folder if it is all of one, or else, or where the catalogue takes no paths, as a copy."""
        if not self.exists():
            raise FileNotFoundError(f"no table at {self.path}")
        files, _ = self._state(self.version())
        folders = {file.rpartition("/")[0] for file in files}
        whole = len(folders) == 1 and len(files) == sum(s.getPath().getName().endswith(".parquet") for s in self._list(*folders))
        target = f"`{database}`.`{name}`"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.spark.sql(f"DROP TABLE IF EXISTS {target}")
        if whole:
            try:
                self.spark.sql(f"CREATE TABLE {target} USING parquet LOCATION '{self.path}/{next(iter(folders))}'")
                return f"{database}.{name}"
            except AnalysisException:
                pass
        self.read().write.format("parquet").saveAsTable(f"{database}.{name}")
        return f"{database}.{name}"


def _held_as(kind: DataType) -> str | None:
    """How a manifest holds values of a type whose order it keeps, or null."""
    name = kind.typeName()
    return "long" if name in ("byte", "short", "integer", "long") else "string" if name in ("string", "date") else None
