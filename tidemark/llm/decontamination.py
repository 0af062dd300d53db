"""Benchmark decontamination by the q-gram lemma.

An item of L characters that occurs in a text with at most k edits shares at
least L - q + 1 - k q of its q-grams with it, all on diagonals (place in the
text less place in the item) that lie k apart at most. So shared q-grams are
counted in diagonal bands of width 2(k + 1) that overlap by half; bands that
reach the bound are aligned, within the band, and kept if k edits are enough.

Texts are compared in lower case, with each white-space character as a blank.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, read_table, slices

Q = 10
#: Edits for each character of an item.
EDITS = 0.08
SLICE_BYTES = 1 << 20
#: Items are sent to the executors in blocks of about so many bytes, of which a worker holds one at a time.
BLOCK_BYTES = 8 << 20
#: Of several blocks, each is searched for in so many bytes of texts before the next is read; documents are read once.
HELD_BYTES = 64 << 20
FILTER_BITS = 22
#: Shared q-grams that are held at once.
HITS = 1 << 20

_RARE = "\t\v\f\r\x00\x1c\x1d\x1e\x1f\x85\xa0"
_BLANKS, _ANY_RARE = str.maketrans(dict.fromkeys(_RARE, " ")), re.compile(f"[{_RARE}]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case and blanks, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = low.replace("\n", " ")
    return low.translate(_BLANKS) if _ANY_RARE.search(low) else low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _odd(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters at each place, put together from runs of 1, 2, 4, ... of them."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, length, out, done = points.astype(np.uint64), 1, None, 0
    while True:
        if q & length:
            part = run[done : done + n]
            out = part.copy() if out is None else out * _odd(2 * length + 1) + part
            done += length
        if done == q:
            return (out ^ (out >> np.uint64(32))) * _FACTOR
        run = run[:-length] * _odd(2 * length) + run[length:]
        length *= 2


@dataclass
class Grams:
    """Where each q-gram of the items with one q occurs in them."""

    q: int
    items: np.ndarray
    texts: list[str]

    def __post_init__(self) -> None:
        grams = [gram_hashes(codes(t), self.q) for t in self.texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(self.items, [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.begins = np.unique(flat[order], return_index=True)
        self.begins = np.append(self.begins, len(flat))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def shared(self, points: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, band, shared q-grams) of all bands with any; a band b of an item with budget k covers diagonals b (k + 1) to (b + 2) (k + 1) - 1.

        Hits are made HITS at a time and added up by band, so that repetitive
        texts and items, whose every gram hits many places, need no more memory.
        """
        hashes = gram_hashes(points, self.q)
        where = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.grams, hashes[where])
        real = at < len(self.grams)
        real[real] = self.grams[at[real]] == hashes[where[real]]
        where, at = where[real], at[real]
        totals = np.concatenate([[0], np.cumsum(self.begins[at + 1] - self.begins[at])])
        none = np.zeros(0, np.int64)
        sums, held, start = (none, none, none), 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(totals, totals[start] + HITS, "right")) - 1)
            counts = np.diff(totals[start : stop + 1])
            hit = np.repeat(self.begins[at[start:stop]] - (totals[start:stop] - totals[start]), counts) + np.arange(counts.sum())
            item = self.item[hit]
            band = (np.repeat(where[start:stop], counts) - self.place[hit]) // (budget[item] + 1)
            parts.append(_added([item, item], [band, band - 1], None))
            held += len(parts[-1][0])
            if held > HITS:
                sums = _added(*(list(x) for x in zip(sums, *parts, strict=True)))
                parts, held = [], 0
            start = stop
        return _added(*(list(x) for x in zip(sums, *parts, strict=True)))


def _added(item: list[np.ndarray], band: list[np.ndarray], count: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, band, count) with the counts (or ones) of each item and band added up, by item and band."""
    item, band = np.concatenate(item), np.concatenate(band)
    order = np.lexsort((band, item))
    item, band = item[order], band[order]
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])])) if len(item) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(item))) if count is None else np.add.reduceat(np.concatenate(count)[order], new) if len(item) else new
    return item[new], band[new], count


@dataclass
class Index:
    """Items with their edit budgets, and their q-grams: q at most, and short enough that an item with its whole budget spent shares one."""

    ids: list
    texts: list[str]
    q: int
    rate: float

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budget = (self.lengths * self.rate).astype(np.int64)
        sizes = np.minimum(self.q, self.lengths // (self.budget + 1))
        self.needed = self.lengths - sizes + 1 - self.budget * sizes
        self.by_q = [Grams(int(q), np.flatnonzero(sizes == q), [self.texts[k] for k in np.flatnonzero(sizes == q)]) for q in np.unique(sizes)]

    def bands(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and bands with enough shared q-grams."""
        items, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for grams in self.by_q:
            item, band, shared = grams.shared(points, self.budget)
            enough = shared >= self.needed[item]
            items.append(item[enough])
            bands.append(band[enough])
        return np.concatenate(items), np.concatenate(bands)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best place of an item in a text, within diagonals low to high: (edits, start, end), if it takes at most `most` edits.

    Fewest edits first, then the leftmost end. Row i of the table has column
    i + d for each diagonal d; starting anywhere in the band is free.
    """
    width, far = high - low + 1, len(item) + len(text) + 1
    steps = np.arange(width)
    column = low + steps
    fits = (column >= 0) & (column <= len(text))
    cost = np.where(fits, 0, far)
    begin = np.where(fits, column, 0)
    for i, c in enumerate(item):
        column = i + 1 + low + steps
        inside = (column >= 1) & (column <= len(text))
        other = np.full(width, -1, np.int64)
        other[inside] = text[column[inside] - 1]
        best, start = cost + (other != c), begin
        up = np.append(cost[1:], far) + 1
        start = np.where(up < best, np.append(begin[1:], 0), start)
        best = np.minimum(up, best)
        best[(column < 0) | (column > len(text))] = far
        best[(column == 0)] = np.minimum(best[column == 0], i + 1)
        slope = best - steps  # insertions: the cheapest cell on the left, plus the way from it
        lowest = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == lowest, np.where(np.append(far, lowest[:-1]) > slope, steps, 0), 0))
        cost, begin = lowest + steps, start[source]
        cost[(column < 0) | (column > len(text))] = far
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(begin[k]), len(item) + low + k) if cost[k] <= most else None


def find(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of all matches; of matches of an item that overlap in a text, the one with fewest edits, leftmost."""
    texts = [normal(t) for t in texts]
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    whole = codes("\0".join(texts) + "\0")
    found = []
    for item, band in zip(*index.bands(whole), strict=True):
        item, k = int(item), int(index.budget[item])
        low, high = int(band) * (k + 1) - k, (int(band) + 2) * (k + 1) - 1 + k
        middle = min(max(low + (high - low + int(index.lengths[item])) // 2, 0), len(whole) - 1)
        for text in {int(np.searchsorted(ends, place, "right")) - 1 for place in (max(0, min(low + k, len(whole) - 1)), middle, min(len(whole) - 1, max(0, high + int(index.lengths[item]))))}:
            start, end = int(ends[text]), int(ends[text + 1]) - 1
            near = 2 * (k + 1)  # bands beside that of an exact match have most of its q-grams too
            at = texts[text].find(index.texts[item], max(0, low - near - start), max(0, high + near + int(index.lengths[item]) - start))
            best = (0, at, at + int(index.lengths[item])) if at >= 0 else None
            if best is None and k:
                left, right = max(start, low - k), min(end, high + int(index.lengths[item]) + k)
                if right - left >= index.lengths[item] - k:
                    best = align(codes(index.texts[item]), whole[left:right], low - left, high - left, k)
                    best = best and (best[0], best[1] + left - start, best[2] + left - start)
            if best:
                found.append((text, item, best[1], best[2], best[0]))
    out: list[tuple[int, int, int, int, int]] = []
    taken: dict[tuple[int, int], list[int]] = {}  # starts and ends of matches that stay, in order
    for match in sorted(set(found), key=lambda m: (m[0], m[1], m[4], m[2], m[3])):
        borders = taken.setdefault(match[:2], [])
        at = bisect_right(borders, match[2])
        if at % 2 == 0 and at == bisect_left(borders, match[3]):
            borders[at:at] = match[2:4]
            out.append(match)
    return out


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = EDITS) -> DataFrame:
    """(id, item, start, end, edits) of every place where a text has an item with at most rate edits a character; places in characters, end exclusive.

    Null, empty and blank items match nothing; items of fewer than 1 / rate
    characters match only exactly; equal items each match. A null or empty text
    has no matches; a text of any length is searched whole. Of overlapping
    matches of an item the one with fewest edits stays, the leftmost of equals.
    Rows of docs
    are taken one by one, so repeated rows repeat their matches, and a null id
    stays null. Other columns are left out, so that none can clash. Either table
    may be empty. Documents are read once, however many blocks items make up.
    """
    named = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.length(F.trim("text")) > 0)
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    sent = []
    for block in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        part = sorted(((row["item"], row["text"]) for row in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        sent.append(docs.sparkSession.sparkContext.broadcast(part))
    rows = docs.select(F.col(id_col), as_bytes(text_col).alias("__text"))
    return rows.mapInArrow(_search(sent, q, rate, pa_kind(items, item_col), id_col, item_col), f"`{id_col}` {kind}, `{item_col}` {item_kind}, start int, end int, edits int")


def pa_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _search(sent: list, q: int, rate: float, item_kind: pa.DataType, id_col: str, item_col: str):
    def read(block) -> Index:
        found = Index([i for i, _ in block.value], [normal(t) for _, t in block.value], q, rate)
        if len(sent) > 1:
            del block._value  # a worker holds one block at a time
        return found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = read(sent[0]) if len(sent) == 1 else None
        held, size = [], 0
        for batch in slices(batches, "__text", SLICE_BYTES):
            if index:
                yield matches(index, batch)
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from each_block(held)
                held, size = [], 0
        yield from each_block(held)

    def each_block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sent if held else ():
            index = read(block)
            for batch in held:
                yield matches(index, batch)

    def matches(index: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(index, [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
        columns = [pa.array([m[k] for m in found], pa.int32()) for k in (2, 3, 4)]
        ids = batch.column(0).take(pa.array([m[0] for m in found], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([index.ids[m[1]] for m in found], item_kind), *columns], names=[id_col, item_col, "start", "end", "edits"])

    return search


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
