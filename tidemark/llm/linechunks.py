r"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last WINDOW non-blank lines chooses the
borders: a line's hash is rolled in, that of the line WINDOW before it is rolled
out, and a border follows where the rest modulo DIVISOR is zero. So an insertion
moves only the borders beside it. A line of LINE_WORDS words or LINE_BYTES bytes
is a chunk of its own, whatever is beside it. Blank lines are no lines to the
hash, and count only within a chunk.

A chunk of two non-blank lines or more, or of one long line, goes if it occurs
before, byte for byte: in a row with a smaller id, or earlier in its own text. A
match is carried on over borders: two lines that meet at a border, one of them
short, go if they occur together before.

Occurrences are brought together by a 64-bit key and by the bytes themselves:
chunks are grouped on their bytes, in each task before anything is exchanged, so
a chunk that a third of all rows hold is a row for each task. Rows of (id, key)
then learn which keys occur before; where chunks of different bytes share a key,
the bytes go along.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, settle, slices

#: Lines that the rolling hash covers; a border follows about every DIVISOR-th line.
WINDOW, DIVISOR, FACTOR = 2, 2, 31
#: A line is long from so many words, or bytes, on.
LINE_WORDS, LINE_BYTES = 10, 60
#: Bytes of a key, 8 at most. Keys needn't differ.
KEY_BYTES = 8
#: A key with more than one in so many of all rows is common.
COMMON = 1000
SLICE_BYTES = 1 << 20


def is_long(line: bytes) -> bool:
    return len(line) >= LINE_BYTES or len(line.split()) >= LINE_WORDS


def key_of(chunk: bytes, size: int = KEY_BYTES) -> int:
    return int.from_bytes(blake2b(chunk, digest_size=size).digest(), "little", signed=True)


def spans_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, last line) of each chunk that may go, and of each pair of lines that meet at a border, in order."""
    full = [k for k, line in enumerate(lines) if line.strip()]
    out, hashes, rolled, start, top = [], [], 0, 0, FACTOR**WINDOW
    long_ = [is_long(lines[k]) for k in full]
    for n, k in enumerate(full):
        hashes.append(int.from_bytes(md5(lines[k]).digest()[:4], "big"))
        rolled = rolled * FACTOR + hashes[n]
        if n >= WINDOW:
            rolled -= hashes[n - WINDOW] * top
        last = n + 1 == len(full)
        if last or long_[n] or long_[n + 1] or rolled % DIVISOR == 0:
            if n > start or long_[n]:
                out.append((full[start], k))
            if not last and not (long_[n] and long_[n + 1]):
                out.append((k, full[n + 1]))
            start = n + 1
    return out


def occurrences(text: bytes) -> list[bytes]:
    """The bytes of each span."""
    lines = text.split(b"\n")
    return [b"\n".join(lines[a : z + 1]) for a, z in spans_of(lines)]


def without(text: bytes, known: set[int], same: set[bytes], key_bytes: int = KEY_BYTES) -> tuple[bytes | None, int, int]:
    """(text, n_lines, n_removed) without the spans whose keys are known, whose bytes are in same, or that the text had before; the text is None if nothing goes.

    Blank lines go where the non-blank lines on both sides of them go.
    """
    lines = text.split(b"\n")
    gone, ends = set(), {}
    for a, z in spans_of(lines):
        span = b"\n".join(lines[a : z + 1])
        if ends.setdefault(span, z) < a or span in same or key_of(span, key_bytes) in known:
            gone.update(range(a, z + 1))
    if not gone:
        return None, len(lines), 0
    left, blank, drops = [], [], True
    for k, line in enumerate(lines):
        if not line.strip():
            blank.append(line)
            continue
        if not (drops and k in gone):
            left += blank
        blank, drops = [], k in gone
        if not drops:
            left.append(line)
    if not drops:
        left += blank
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _rows(batches: Iterator[pa.RecordBatch], whole: bool, key_bytes: int) -> Iterator[pa.RecordBatch]:
    """From (id, text): (id, key), or (id, key, chunk), a row for each different chunk of a text."""
    for batch in slices(batches, "text", SLICE_BYTES):
        rows, chunks = [], []
        for row, text in enumerate(batch.column("text")):
            found = [*dict.fromkeys(occurrences(text.as_py()))]
            rows += [row] * len(found)
            chunks += found
        arrays = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array([key_of(chunk, key_bytes) for chunk in chunks], pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(chunks, pa.binary())] if whole else arrays, ["id", "key", "chunk"] if whole else ["id", "key"])


def earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """(id, known, same): for each id the keys, or where a key is ambiguous the bytes, of its chunks that rows with a smaller id have."""
    named = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    chunks = named.mapInArrow(lambda batches: _rows(batches, True, key_bytes), f"id {kind}, key long, chunk binary")
    classes = chunks.groupBy("key", "chunk").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = classes.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    keys = settle(keys.filter("first < last"))
    each = settle(named.mapInArrow(lambda batches: _rows(batches, False, key_bytes), f"id {kind}, key long"))
    common = F.col("n") * COMMON > each.count()  # of fewer than COMMON keys
    plain = keys.filter("kinds = 1")
    few = F.broadcast(plain.filter(common).select("key", "first"))
    rest = each.join(F.broadcast(keys.filter(common).select("key")), "key", "left_anti")
    found = each.join(few, "key").unionByName(rest.join(plain.filter(~common).select("key", "first"), "key")).filter("id > first")
    known = found.groupBy("id").agg(F.collect_set("key").alias("known"))
    ambiguous = keys.filter("kinds > 1").select("key")
    if ambiguous.isEmpty():
        return known.withColumn("same", F.lit(None).cast("array<binary>"))
    apart = classes.join(ambiguous, "key").filter("first < last").select("key", "chunk", "first")
    same = chunks.join(apart, ["key", "chunk"]).filter("id > first").groupBy("id").agg(F.collect_set("chunk").alias("same"))
    return known.join(same, "id", "full")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """The rows of docs, their text without repeated chunks, and (n_lines, n_removed) as added columns __lines and __removed.

    A text all of whose non-blank lines go becomes empty; the row stays. A null
    text stays null and has no lines; an empty or blank text has no chunks and stays. A
    text of any length is cut in time proportional to it. A row without an id
    loses only what it repeats of its own text, and isn't an occurrence for
    others. Rows that share an id aren't repeats of each other, so equal rows
    stay equal. Ties of chunks go to the lowest id, then the first place. Extra
    columns are carried along. A table without rows gives none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts, lines, removed = batch.column("text").to_pylist(), [], []
            for k, (known, same) in enumerate(zip(batch.column("known"), batch.column("same"), strict=True)):
                left, n, gone = (None, 0, 0) if texts[k] is None else without(texts[k], set(known.as_py() or ()), set(same.as_py() or ()), key_bytes)
                texts[k] = texts[k] if left is None else left
                lines.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column("rest"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], ["text", "rest", "lines", "removed"])

    found = earlier(docs, id_col, text_col, key_bytes).select(F.col("id").alias("__id"), "known", "same")
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.col(id_col).alias("__key"), F.col(text_col).cast("binary").alias("text"), F.struct(*(F.col(c) for c in rest)).alias("rest"))
    joined = packed.filter("__key IS NOT NULL").join(found, F.col("__key") == F.col("__id"), "left").select("text", "known", "same", "rest")
    apart = packed.filter("__key IS NULL").select("text", F.lit(None).cast("array<long>").alias("known"), F.lit(None).cast("array<binary>").alias("same"), "rest")  # not all to one task
    done = joined.unionByName(apart).mapInArrow(cut, f"text binary, rest {packed.schema['rest'].dataType.simpleString()}, lines long, removed long")
    return done.select(
        *(F.col("text").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns),
        F.col("lines").alias("__lines"),
        F.col("removed").alias("__removed"),
    )


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_ROLLED = " + ".join(f"coalesce(lag(h, {k}) OVER w, 0) * {FACTOR**k}" for k in range(WINDOW))

ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT *, CAST('0x' || md5(line)[1:8] AS BIGINT) AS h,
    strlen(line) >= {LINE_BYTES} OR len(regexp_extract_all(line, '[^ \t\r\x0b\x0c]+')) >= {LINE_WORDS} AS long
  FROM l WHERE regexp_matches(line, '[^ \t\r\x0b\x0c]')),
b AS (
  SELECT doc_id, i, long, lead(i) OVER w AS next, coalesce(lead(long) OVER w, false) AS next_long, ({_ROLLED}) % {DIVISOR} = 0 AS hit FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(CAST(hit OR long OR next_long AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b),
s AS (
  SELECT doc_id, min(i) AS a, max(i) AS z FROM c GROUP BY doc_id, place HAVING count(*) > 1 OR bool_or(long)
  UNION ALL SELECT doc_id, i, next FROM c WHERE next IS NOT NULL AND (hit OR long OR next_long) AND NOT (long AND next_long)),
k AS (SELECT s.doc_id, s.a, s.z, string_agg(l.line, chr(10) ORDER BY l.i) AS span FROM s JOIN l ON l.doc_id = s.doc_id AND l.i BETWEEN s.a AND s.z GROUP BY ALL),
r AS (
  SELECT doc_id, a, z FROM (
    SELECT *, min(doc_id) OVER (PARTITION BY span) AS first, first_value(z) OVER (PARTITION BY span, doc_id ORDER BY a, z) AS over FROM k)
  WHERE first < doc_id OR over < a),
g AS (SELECT DISTINCT r.doc_id, u.i FROM r JOIN u ON u.doc_id = r.doc_id AND u.i BETWEEN r.a AND r.z),
n AS (SELECT l.doc_id, l.i, l.line, u.i IS NOT NULL AS full_, g.i IS NOT NULL AS gone FROM l LEFT JOIN u ON u.doc_id = l.doc_id AND u.i = l.i LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i),
m AS (
  SELECT doc_id, i, line, CASE WHEN full_ THEN gone ELSE bool_or(full_) OVER (PARTITION BY doc_id)
    AND coalesce(last_value(CASE WHEN full_ THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), true)
    AND coalesce(first_value(CASE WHEN full_ THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), true) END AS gone FROM n)
SELECT d.doc_id, count(m.i) AS n_lines, count(m.i) FILTER (m.gone) AS n_removed, sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""
