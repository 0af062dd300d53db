"""Sharding by fixed virtual slots.

A record's slot is a hash of its id modulo SLOTS and never changes. Bytes are
summed for each slot, and a versioned map says which shard holds which slot:
records move only when an edit of the map moves their slot. The map has SLOTS
rows whatever the input, so the driver may edit it.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import ConcurrentCommit, VersionedTable
from ._common import read_table, shared_dir

SLOTS = 8192
SHARDS = 24
#: Bytes that a record has besides its text.
HEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """shards[slot] is the shard of a slot; sizes and rows are what the slots held when the version was made."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    sizes: tuple[int, ...]
    rows: tuple[int, ...]

    @classmethod
    def balanced(cls, sizes: list[int], rows: list[int], n_shards: int) -> SlotMap:
        """Version 1: the largest slots first, each to the shard with the fewest bytes; empty slots go round."""
        heap = [(0, shard) for shard in range(n_shards)]
        shards = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            load, shard = heap[0]
            if sizes[slot]:
                heapq.heapreplace(heap, (load + sizes[slot], shard))
                shards[slot] = shard
            else:
                shards[slot] = slot % n_shards
        return cls(1, n_shards, tuple(shards), tuple(sizes), tuple(rows))

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += self.sizes[slot]
        return out

    def grown(self, more: int = 1) -> SlotMap:
        """The next version, with more shards: each new one takes slots from those that hold most, and no slot moves between old ones."""
        n = self.n_shards + more
        target = sum(self.sizes) / n
        shards, loads = list(self.shards), [*self.loads(), *[0] * more]
        held: list[list[int]] = [[] for _ in range(n)]
        for slot in sorted(range(len(shards)), key=lambda s: (self.sizes[s], s)):
            if self.sizes[slot]:
                held[shards[slot]].append(slot)  # the largest last
        for new in range(self.n_shards, n):
            heap = [(-loads[s], s) for s in range(self.n_shards) if held[s]]
            heapq.heapify(heap)
            while heap and loads[new] < target:
                _, old = heapq.heappop(heap)
                fits = next((k for k in range(len(held[old]) - 1, -1, -1) if loads[new] + self.sizes[held[old][k]] <= target * 1.001), None)
                if fits is None:
                    continue
                slot = held[old].pop(fits)
                shards[slot] = new
                loads[old] -= self.sizes[slot]
                loads[new] += self.sizes[slot]
                if held[old]:
                    heapq.heappush(heap, (-loads[old], old))
        return SlotMap(self.version + 1, n, tuple(shards), self.sizes, self.rows)

    def starts(self) -> list[int]:
        """How many records of a slot's shard come before the slot."""
        seen, out = [0] * self.n_shards, []
        for slot, shard in enumerate(self.shards):
            out.append(seen[shard])
            seen[shard] += self.rows[slot]
        return out

    def rows_for_storage(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, slot, shard, bytes, records), one row for each slot."""
        text = json.dumps([*zip(range(len(self.shards)), self.shards, self.sizes, self.rows, strict=True)])
        parts = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<array<long>>")).alias("x"))
        return parts.select(
            F.lit(self.version).alias("version"),
            F.lit(self.n_shards).alias("n_shards"),
            F.col("x")[0].alias("slot"),
            F.col("x")[1].cast("int").alias("shard"),
            F.col("x")[2].alias("bytes"),
            F.col("x")[3].alias("records"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path, whose versions are those of the map; earlier ones stay. It must follow the latest one there, or ConcurrentCommit is raised."""
        table = VersionedTable(spark, path)
        if table.version() != self.version - 1:
            raise ConcurrentCommit(f"{path} is at version {table.version()}, and {self.version} doesn't follow it")
        table.overwrite(self.rows_for_storage(spark).coalesce(1), f"map for {self.n_shards} shards", self.version - 1)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, the latest by default."""
        found = sorted(VersionedTable(spark, path).read(version).collect(), key=lambda r: r["slot"])  # a row for each slot
        return cls(found[0]["version"], found[0]["n_shards"], *(tuple(r[k] for r in found) for k in ("shard", "bytes", "records")))


def slot_of(id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> Column:
    """The virtual slot; records without an id are dealt by their text, so that they don't share a slot."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))))), F.lit(slots)).cast("int")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, n_shards: int = SHARDS) -> SlotMap:
    """Sums bytes and records for each slot and makes version 1 of the map."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + HEAD
    found = docs.groupBy(slot_of(id_col, text_col, slots).alias("s")).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    sizes, rows = [0] * slots, [0] * slots
    for row in found:
        sizes[row["s"]], rows[row["s"]] = row["b"], row["n"]
    return SlotMap.balanced(sizes, rows, n_shards)


def look_up(values: list[int] | tuple[int, ...], index: Column, kind: str) -> Column:
    """An element of a constant array of bounded length."""
    return F.element_at(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), index + 1)


def assign(docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every record into its slot's shard: (id, size, text_crc32, virtual_slot, shard, slot).

    slot is the record's place in its shard, without gaps from 0: the records of
    the virtual slots before its own, and its place in its own by id. Equal rows
    get places of their own, and rows that tie otherwise are alike but for text. A
    null or empty text has no bytes, and its CRC is that of no bytes; a very long
    one is a record like others, and may make its shard larger than the mean; a
    null id is kept. Other columns of docs are left out, so that none
    can clash. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + HEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(id_col, text_col, len(slot_map.shards)).alias("virtual_slot"),
    )
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")) - 1
    return rows.withColumns(
        {
            "shard": look_up(slot_map.shards, F.col("virtual_slot"), "int"),
            "slot": look_up(slot_map.starts(), F.col("virtual_slot"), "long") + place,
        }
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the map's first version, edits it for one more shard and stores that, then reads both versions back and places records by them."""
    docs = read_table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4()}"
    measure(docs).save(spark, path)
    SlotMap.load(spark, path).grown().save(spark, path)
    slot_map, edited = SlotMap.load(spark, path, 1), SlotMap.load(spark, path)
    placed = assign(docs, slot_map)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
        look_up(edited.shards, F.col("virtual_slot"), "int").alias("rebalanced_shard"),
    )
