"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed runs of WORDS words. Copies of a text are one node from
the start, whatever their ids. MinHash signatures are cut into bands; texts that agree on a
band meet in its bucket. Pairs compare their signatures STEP values at a time,
and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold is below TOLERANCE (uniform prior; m of n equal values).
What is left is verified exactly, on the sets.

A pair is looked at only in the first band on which it agrees. A large bucket is
cut into blocks, and each pair of blocks is one piece of work, so that no task
holds a whole large bucket. Pairs never become rows: a piece gives, for each
text, the weight of its links, and the lowest node it is connected to there.
Groups are the connected components of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from ._common import as_bytes, binary_view, read_table, settle, slices

WORDS = 5
THRESHOLD = 0.8
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 16
TOLERANCE = 1e-6
#: A bucket is cut into blocks of BLOCK texts, up to SPREAD blocks; into more only where one would have more than BLOCK_BYTES or BLOCK_TEXTS.
BLOCK, SPREAD, BLOCK_BYTES, BLOCK_TEXTS = 160, 8, 4 << 20, 1024
#: A text that more than one in so many rows have is common.
COMMON = 1000
SLICE_BYTES = 1 << 20
#: Parts into which the rows of one label are dealt.
SALTS = 16
#: Pairs, and cells of a matrix, that are held at once.
PAIRS, CELLS = 1 << 17, 1 << 22

#: What a piece of work is known by.
PIECE = ["band", "bucket", "low", "high"]

_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of each text, and where each text's begin. A text of fewer words is one run of them all; one without words has none."""
    _, _, hashes, firsts = textvec.words(data, ends)
    runs, begins = textvec.ngrams(hashes, firsts, words)
    few = np.flatnonzero((np.diff(firsts) > 0) & (np.diff(begins) == 0))
    if not len(few):
        return runs, begins
    counts = np.diff(begins)
    counts[few] = 1
    moved = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(moved[-1], np.uint64)
    out[np.arange(begins[-1]) + np.repeat(moved[:-1] - begins[:-1], np.diff(begins))] = runs
    for text in few:
        value = np.uint64(firsts[text + 1] - firsts[text])
        for h in hashes[firsts[text] : firsts[text + 1]]:
            value = textvec.mix(np.array([value ^ h]))[0]
        out[moved[text]] = value
    return out, moved


def signatures(runs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash signatures, 16 bits a value; texts without runs get zeros."""
    n = len(begins) - 1
    out = np.zeros((n, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(begins))
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(begins[some], begins[some[at]] + (1 << 15), "right")))
        low, high = begins[some[at]], begins[some[min(stop, len(some)) - 1] + 1]
        part, cuts = runs[low:high], begins[some[at:stop]] - low
        for k, seed in enumerate(_SEEDS):
            mixed = (part ^ seed) * _SEEDS[-1 - k]
            least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), cuts)
            out[some[at:stop], k] = (textvec.mix(least) >> np.uint64(48)).astype(np.uint16)
        at = stop
    return out


@lru_cache
def least_equal(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the least that must be equal for the pair to go on.

    The posterior of the similarity after m of n equal values is Beta(m + 1,
    n - m + 1), and its weight above the threshold is P(Binomial(n + 1,
    threshold) <= m).
    """
    out = []
    for n in range(HASHES + 1):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        out.append(m)
    return out


def surviving(signature: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """The numbers of the pairs that incremental comparison doesn't drop."""
    least, alive, equal = least_equal(threshold, tolerance), np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        equal = equal + (signature[left[alive], n - STEP : n] == signature[right[alive], n - STEP : n]).sum(axis=1)
        going = equal >= least[n]
        alive, equal = alive[going], equal[going]
    return alive


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, runs, signature): copy is a digest of the text's bytes, runs the number of its runs; signature null for texts without words."""

    def batches_signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            runs, begins = shingles(*binary_view(batch.column(2)))
            found, counts = signatures(runs, begins), np.diff(begins)
            values = [row.tobytes() if some else None for row, some in zip(found, counts > 0, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], names=["id", "copy", "runs", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), copy_of(text_col).alias("copy"), as_bytes(text_col).alias("__text"))
    return rows.mapInArrow(batches_signed, "id long, copy binary, runs long, signature binary")


def copy_of(text_col: str) -> Column:
    """A digest of a text's bytes; null for a null text."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches: a group that a batch cuts waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        first = last
        ends = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        arrays = [e.to_numpy(zero_copy_only=False) for e in ends]
        while first and all(a[first - 1] == a[last] for a in arrays):
            first -= 1
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks()
            held = [batch.slice(first)]
        elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != a[0] for k, a in zip(keys, arrays, strict=True)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_pairs(group: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, a part at a time; of a group of two blocks, only pairs across them."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    counts = end - 1 - np.arange(n)
    at = 0
    totals = np.concatenate([[0], np.cumsum(counts)])
    while at < n:
        stop = max(at + 1, int(np.searchsorted(totals, totals[at] + PAIRS, "right")) - 1)
        rows = np.arange(at, stop)
        left = np.repeat(rows, counts[rows])
        right = left + 1 + np.arange(len(left)) - np.repeat(totals[rows] - totals[at], counts[rows])
        across = (low[left] == high[left]) | (block[left] != block[right])
        yield left[across], right[across]
        at = stop


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    """The rows of each piece, from a table sorted by pieces."""
    new = np.zeros(table.num_rows, bool)
    for k in PIECE:
        key = table[k].to_numpy()
        new[1:] |= key[1:] != key[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _surviving_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each piece that agree first on its band and that pruning leaves, in the order of left, a part at a time."""
    band, low, high, block = (table[k].to_numpy() for k in ("band", "low", "high", "block"))
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
    bands = signature.view(np.uint64)
    group = np.zeros(table.num_rows, np.int64)
    for number, (a, b) in enumerate(_groups(table)):
        group[a:b] = number
    for left, right in _group_pairs(group, block, low, high):
        for cut in range(0, len(left), PAIRS):
            a, b = left[cut : cut + PAIRS], right[cut : cut + PAIRS]
            first = (bands[a] == bands[b]).argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            alive = surviving(signature, a, b)
            yield a[alive], b[alive]


def find_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (band, bucket, low, high, block, node, signature), sorted by piece: the same but for signature, only the rows that have a surviving pair."""
    for table in _runs(batches, PIECE):
        some = np.zeros(table.num_rows, bool)
        for left, right in _surviving_pairs(table):
            some[left] = some[right] = True
        if some.any():
            yield from table.select([*PIECE, "block", "node"]).filter(pa.array(some)).combine_chunks().to_batches()


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, node, weight, signature): the same with shingles, the sorted set of hashes as bytes, in place of text."""
    for batch in slices(batches, "text", SLICE_BYTES):
        runs, begins = shingles(*binary_view(batch.column(0)))
        sets = [np.unique(runs[a:b]).tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], names=["shingles", "node", "weight", "signature"])


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(left) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(left, right, strict=True)], np.int64)
    else:  # many pairs of few sets: as products of matrices, a part of the values at a time
        values, of = np.unique(np.concatenate(sets), return_inverse=True)
        owner, cells = np.repeat(np.arange(len(sets)), sizes), np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(of, kind="stable")
        of, owner = of[order], owner[order]
        step = max(1, CELLS // len(sets))
        for low in range(0, len(values), step):
            a, b = np.searchsorted(of, [low, low + step])
            present = np.zeros((len(sets), step), np.float32)
            present[owner[a:b], of[a:b] - low] = 1
            cells += present @ present.T
        common = cells[left, right].astype(np.int64)
    return common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From survivors with signatures and sets, sorted by piece: (node, links, lowest), for each text its links' weight in this piece and the lowest node it is connected to there."""
    for table in _runs(batches, PIECE):
        nodes, weights, shingle = table["node"].to_numpy(), table["weight"].to_numpy(), table["shingles"]
        pairs = [*_surviving_pairs(table)]
        lefts, rights = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in range(2))
        for a, b in _groups(table):
            at = slice(*np.searchsorted(lefts, [a, b]))
            left, right = lefts[at] - a, rights[at] - a
            if not len(left):
                continue
            true = linked([np.frombuffer(s, np.uint64) for s in shingle.slice(a, b - a).to_pylist()], left, right)
            left, right = left[true], right[true]
            if not len(left):
                continue
            own, weight = nodes[a:b], weights[a:b]
            links = np.bincount(left, weight[right], b - a) + np.bincount(right, weight[left], b - a)
            root = own.copy()
            while True:  # labels sink along links until they rest
                least = np.minimum(root[left], root[right])
                before = root.copy()
                np.minimum.at(root, left, least)
                np.minimum.at(root, right, least)
                if (root == before).all():
                    break
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "lowest"])


def salted_join(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows left join names on a key that many rows may share and names have once: rows are dealt into SALTS parts by their nodes."""
    parts = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(parts, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the lowest node of each connected component of edges (node, lowest).

    Labels move along edges both ways and then jump to their label's label,
    until none changes; each round is settled.
    """
    edges = edges.filter("node != lowest").distinct()
    both = settle(edges.select(F.col("node").alias("a"), F.col("lowest").alias("b")).unionByName(edges.select(F.col("lowest").alias("a"), F.col("node").alias("b"))))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("class")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "class"), "b").select(F.col("a").alias("node"), "class").unionByName(labels)
        lower = heard.groupBy("node").agg(F.min("class").alias("class"))
        jump = lower.filter("class < node").select(F.col("node").alias("class"), F.col("class").alias("next"))
        moved = settle(salted_join(lower, jump, "class").select("node", F.least("class", "next").alias("class")))
        at_rest = moved.join(labels.withColumnRenamed("class", "was"), "node").filter("class != was").isEmpty()
        labels = moved
        if at_rest:
            return labels


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, class_id, n_links, n_copies, copy, leads).

    Documents are linked if the Jaccard similarity of their sets of WORDS-word
    runs is at least THRESHOLD; n_links counts the other rows a row is linked
    to, copies of its own text among them (n_copies), and class_id is the lowest
    id of its group. copy is the text's digest, and leads is true for the rows of
    a group with the lowest id and, of its texts, the one with the lowest digest.
    Equal texts are linked, empty ones too. A text without words is linked to its
    copies only; a null text to none. A row without an id is in no group: class
    null, no links, leads true. Links and groups are those of texts: rows that
    share an id and not a text are linked only if their texts are, and repeated
    rows are copies. Texts of any length are compared whole. Other columns are
    left out, so that none can clash. A table without rows gives none.
    """
    signed = settle(sign(docs, id_col, text_col))
    named = signed.filter("id IS NOT NULL AND copy IS NOT NULL")
    copies = named.groupBy("copy").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.max("runs").alias("runs"), F.max("signature").alias("signature"))
    copies = settle(copies.withColumn("node", F.monotonically_increasing_id()))  # settled, so that nodes stay
    texts = copies.filter("signature IS NOT NULL")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.substring(F.col("signature"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket")))
    each = texts.select("node", "runs", F.explode(bands).alias("b")).select("node", "runs", "b.band", "b.bucket")
    full = each.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), (F.sum("runs") * 8 + F.count(F.lit(1)) * (2 * HASHES)).alias("bytes")).filter("n > 1")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(SPREAD)), F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    members = each.join(full.select("band", "bucket", blocks.alias("blocks")), ["band", "bucket"])
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pieces = members.select("band", "bucket", "block", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pieces = pieces.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")

    kinds = "band int, bucket long, low int, high int"
    dealt = lambda df: df.repartition(*PIECE).sortWithinPartitions(*PIECE)
    signed_pieces = pieces.join(texts.select("node", "signature"), "node").select(*PIECE, "block", "node", "signature")
    survivors = settle(dealt(signed_pieces).mapInArrow(find_survivors, f"{kinds}, block int, node long"))

    wanted = texts.join(survivors.select("node").distinct(), "node").select("node", "id", "copy", "weight", "signature")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), copy_of(text_col).alias("copy"), as_bytes(text_col).alias("text"))
    one = rows.groupBy("id", "copy").agg(F.first("text").alias("text"))  # of equal texts
    sets = one.join(wanted, ["id", "copy"]).select("text", "node", "weight", "signature").mapInArrow(shingle_sets, "shingles binary, node long, weight long, signature binary")
    held = survivors.join(sets, "node").select(*PIECE, "block", "node", "weight", "signature", "shingles")
    found = settle(dealt(held).mapInArrow(verify, "node long, links long, lowest long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = copies.select("node", "id", "copy").join(components(found.select("node", "lowest")), "node")
    firsts = groups.groupBy("class").agg(F.min(F.struct("id", "copy")).alias("first"))
    groups = salted_join(groups.select("node", "class"), firsts, "class").select("node", "first")
    classes = copies.select("copy", "node", "id", "weight").join(links, "node", "left").join(groups, "node", "left")
    classes = settle(classes.select("copy", "weight", "links", F.coalesce("first", F.struct("id", "copy")).alias("first")))
    common = F.col("weight") * COMMON > signed.count()  # of fewer than COMMON texts
    few = F.broadcast(classes.filter(common))
    in_groups = F.col("id").isNotNull() & F.col("copy").isNotNull()
    mine = signed.select("id", "copy")
    rest = mine.filter(in_groups).join(few.select("copy"), "copy", "left_anti")
    known = mine.join(few, "copy").filter("id IS NOT NULL").unionByName(rest.join(classes.filter(~common), "copy"))
    known = known.unionByName(mine.filter(~in_groups), allowMissingColumns=True)  # without a join, in which nulls would meet in one task
    return known.select(
        F.col("id").alias(id_col),
        F.coalesce("first.id", "id").alias("class_id"),
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce(F.col("weight") - 1, F.lit(0)).cast("long").alias("n_copies"),
        "copy",
        F.coalesce((F.col("first.id") == F.col("id")) & (F.col("first.copy") == F.col("copy")), F.lit(True)).alias("leads"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read_table(spark, sf_dir, "documents")).drop("copy", "leads")
