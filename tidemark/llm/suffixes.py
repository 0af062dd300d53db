"""Suffix-array dedup of repeated byte strings, by deep-shallow sorting.

The rule: a byte goes if it lies in a string of LENGTH bytes that also starts in
a document with a smaller id. Windows of LENGTH bytes that could be equal are
first brought together, then sorted.

Each window has an anchor: the smallest of its GRAM-byte hashes, the leftmost of
equals. Equal windows have equal anchors at the same place. A run of windows
with one anchor is a fragment, whose bytes hold all its windows. Documents are
dealt to units of a few megabytes, anchors to buckets:

1. Each unit tells each bucket its anchors once; the bucket answers which of
   them occur in more than one document.
2. Each unit sends the bytes of fragments with such anchors, each different
   fragment once, with its smallest id. The bucket sorts the windows of
   fragments that share an anchor, and answers with the smallest id of each
   window where it is smaller than what the unit knows.
3. Each unit removes what its documents repeat.

So a string that a third of all documents hold crosses the network once for each
unit, and no task gets a row for each copy.

Sorting: strings that could be equal (fragments of one size whose anchors lie at
one place; windows of different fragments whose anchors do) are first ordered by
a multikey quicksort on characters of eight bytes, to SHALLOW bytes: a segment
is dealt around a pivot character into less, equal and greater, and the equal
part goes on with the next character. All segments of a task take each step
together, as array operations. Groups that are still equal there go to blind
tries, which look at the places where strings part and keep no other byte. The
leaves of the tries are the groups of equal strings, and nothing but these
decides which windows are equal; hashes only bring them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, binary_view, read_table
from .textvec import mix

LENGTH = 50
GRAM = 20
SHALLOW = 16
UNIT_BYTES = 4 << 20
#: Bytes whose hashes are made at once.
SEGMENT = 1 << 20
#: Up to so many bytes, a place and the upper bits of a hash make one number.
PACKED = 1 << 24
NONE = np.iinfo(np.int64).max

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length bytes at each place, put together from runs of 1, 2, 4, ... bytes."""
    runs, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * size <= length:
        run, factor = runs[size], np.uint64((int(_ODD) * (4 * size + 1)) & (2**64 - 1))
        runs[2 * size] = run[:-size] * factor + run[size:] if len(run) > size else run[:0]
        size *= 2
    n, at, whole = max(0, len(data) - length + 1), 0, np.zeros(max(0, len(data) - length + 1), np.uint64)
    for size in sorted(runs, reverse=True):
        if length & size:
            whole = whole * _ODD + runs[size][at : at + n]
            at += size
    return mix(whole)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


@dataclass
class Fragments:
    """Runs of windows with one anchor: the anchor's hash and place, the first and the last window, and the document."""

    anchor: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray

    def take(self, which: np.ndarray) -> Fragments:
        return Fragments(*(getattr(self, k)[which] for k in self.__dataclass_fields__))


def fragments(data: np.ndarray, ends: np.ndarray) -> Fragments:
    """The fragments of all documents of a unit; places are in its bytes."""
    parts, doc, sizes = [], 0, np.diff(ends)
    while doc < len(sizes):
        stop = max(doc + 1, int(np.searchsorted(ends, ends[doc] + SEGMENT, "right")) - 1)
        base, piece = int(ends[doc]), data[ends[doc] : ends[stop]]
        if len(piece) >= LENGTH:
            grams = _hashes(piece, GRAM)
            low = np.uint64((1 << 24) - 1)
            if len(piece) <= PACKED:
                keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
                at = (_sliding_min(keyed, LENGTH - GRAM + 1) & low).astype(np.int64)
            else:  # a single document of more than PACKED bytes: by rank instead of by bits
                order = np.argsort(grams & ~low, kind="stable")
                rank = np.empty(len(grams), np.int64)
                rank[order] = np.arange(len(grams))
                at = order[_sliding_min(rank, LENGTH - GRAM + 1)]
            start = np.arange(len(at))
            of = np.repeat(np.arange(doc, stop), sizes[doc:stop])[: len(at)]
            valid = start + LENGTH + base <= ends[of + 1]
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (of[1:] != of[:-1])
            over = valid.copy()
            over[:-1] &= ~valid[1:] | new[1:]
            first, last = np.flatnonzero(new), np.flatnonzero(over)
            parts.append((grams[at[first]], at[first] + base, first + base, last + base, of[first]))
        doc = stop
    if not parts:
        return Fragments(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    return Fragments(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _borders(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one character whose order is that of the bytes; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))


def distinct(data: np.ndarray, found: Fragments) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of fragments with different bytes or anchor places, in the order of anchors, and which of these each fragment is."""
    size, ahead = found.last - found.first, found.place - found.first
    order = np.lexsort((ahead, size, found.anchor))
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(_borders(*(x[order] for x in (found.anchor, size, ahead)))) - 1
    order, new = equal_groups(data, found.first, classes, size + LENGTH)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def equal_groups(data: np.ndarray, starts: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within their classes, by deep-shallow sorting: (order, new), new where a string differs from the one before. Strings of a class have one length."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    shallow, chars = min(SHALLOW, int(lengths.min()) // 8 * 8), eights(data)
    order, new = multikey_quicksort(chars, starts, classes, shallow)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    deep = np.repeat(size > 1, size)
    if deep.any():
        where = np.flatnonzero(deep)
        rows = order[where]
        inner, border = blind_tries(data, chars, starts[rows], np.cumsum(new)[where], lengths[rows], shallow)
        order[where], new[where] = rows[inner], border
    return order, new


def multikey_quicksort(chars: np.ndarray, starts: np.ndarray, classes: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within classes by their first bytes: (order, new), new where they differ from those before.

    A segment is a run of rows with one class and equal characters up to its
    depth. Each step deals all open segments around a pivot (the median of their
    first, middle and last character); a segment of one row, or whose depth is
    reached, is done.
    """
    order = np.argsort(classes, kind="stable")
    new = _borders(classes[order])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    depth = np.zeros(len(begin), np.int64)
    while True:
        going = (size > 1) & (depth < shallow)
        begin, size, depth = begin[going], size[going], depth[going]
        if not len(begin):
            return order, new
        segment = np.repeat(np.arange(len(begin)), size)
        first = np.cumsum(size) - size  # where segments begin among the open rows
        where = np.arange(len(segment)) + (begin - first)[segment]
        rows = order[where]
        char = chars[starts[rows] + depth[segment]].astype(np.uint64)
        low, middle, high = char[first], char[first + size // 2], char[first + size - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[segment]
        less, more = char < pivot, char > pivot
        n_less, n_more = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(more, first, dtype=np.int64)
        n_same = size - n_less - n_more

        def rank(chosen: np.ndarray) -> np.ndarray:
            """Places among the chosen rows of a segment."""
            seen = np.cumsum(chosen)
            return seen - (seen[first] - chosen[first])[segment] - 1

        same = ~(less | more)
        place = np.where(less, rank(less), np.where(same, n_less[segment] + rank(same), (n_less + n_same)[segment] + rank(more)))
        order[begin[segment] + place] = rows
        parts = np.stack([n_less, n_same, n_more], 1).ravel()
        heads = np.stack([begin, begin + n_less, begin + n_less + n_same], 1).ravel()
        deeper = np.stack([depth, depth + 8, depth], 1).ravel()
        some = parts > 0
        begin, size, depth = heads[some], parts[some], deeper[some]
        new[begin] = True


def parting(chars: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where two strings part, from place low on; their length if they don't."""
    part, at, open_ = lengths.copy(), low.copy(), np.arange(len(left))
    while len(open_):
        differs = chars[left[open_] + at[open_]].astype(np.uint64) ^ chars[right[open_] + at[open_]].astype(np.uint64)
        beyond = np.maximum(0, 8 - (lengths[open_] - at[open_])).astype(np.uint64) * np.uint64(8)
        differs = (differs >> beyond) << beyond
        found = differs != 0
        bits = differs[found]
        byte = sum((bits >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
        part[open_[found]] = at[open_[found]] + byte
        at[open_] += 8
        open_ = open_[~found]
        open_ = open_[at[open_] < lengths[open_]]
    return part


def blind_tries(data: np.ndarray, chars: np.ndarray, starts: np.ndarray, groups: np.ndarray, lengths: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """One blind trie for each group of strings (a run of equal values), built level by level for all groups at once.

    A node is the first place where its strings part; they are dealt to its
    children by the byte there, and no other byte is kept. A node whose strings
    never part is a leaf. Returns the order of the leaves from left to right,
    and where a new leaf begins.
    """
    order, new = np.arange(len(starts)), _borders(groups)
    open_, depth = np.arange(len(starts)), np.full(len(starts), shallow, np.int64)
    while len(open_):
        fresh = new[open_].copy()
        fresh[0] = True
        node = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        rows = order[open_]
        lead = rows[begin][node]
        part = parting(chars, starts[rows], starts[lead], depth[rows], lengths[rows])  # where a string leaves the first of its node
        branch = np.minimum.reduceat(part, begin)
        inner = branch[node] < lengths[rows]
        open_, node, rows = open_[inner], node[inner], rows[inner]
        if not len(open_):
            break
        place = branch[node]
        byte = data[starts[rows] + place]
        depth[rows] = place + 1
        by = np.lexsort((byte, node))
        order[open_], byte = rows[by], byte[by]
        border = _borders(node, byte)
        new[open_] |= border
        size = np.diff(np.append(np.flatnonzero(border), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]  # a single string is a leaf
    return order, new


# --- what units and buckets tell each other -------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """The upper 48 bits of each number."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(_borders(bucket[order])), len(order))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Unit:
    """The documents of a unit: bytes, ends, ids, and their fragments."""

    data: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    n_buckets: int

    @classmethod
    def of(cls, table: pa.Table, n_buckets: int) -> Unit:
        """Documents without an id, or shorter than a window, have no fragments."""
        table = table.combine_chunks()
        order = np.lexsort((np.arange(table.num_rows), table["id"].fill_null(0).to_numpy()))
        table = table.take(pa.array(order))
        data, ends = binary_view(table["text"])
        return cls(data, ends, table["id"].fill_null(0).to_numpy(), n_buckets)._known(table["id"].is_valid().to_numpy())

    def _known(self, valid: np.ndarray) -> Unit:
        found = fragments(self.data, self.ends)
        self.found = found.take(valid[found.doc]) if not valid.all() else found
        anchors = self.found.anchor
        order = np.argsort(anchors, kind="stable")
        new = _borders(anchors[order])
        self.anchors = anchors[order][new]
        begin = np.flatnonzero(new)
        ids = self.ids[self.found.doc[order]]
        self.several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(begin) else np.zeros(0, bool)
        self.number = np.empty(len(order), np.int64)  # the number of each fragment's anchor
        self.number[order] = np.cumsum(new) - 1
        self.buckets = _by_bucket((self.anchors % np.uint64(self.n_buckets)).astype(np.int64))
        return self

    def anchors_told(self) -> list[tuple[int, bytes, bytes]]:
        return [(bucket, _packed(self.anchors[which]), np.packbits(self.several[which]).tobytes()) for bucket, which in self.buckets]

    def hear_shared(self, answers: dict[int, bytes]) -> None:
        """Keeps the fragments whose anchors occur in several documents, and finds the different ones."""
        shared = np.zeros(len(self.anchors), bool)
        for bucket, which in self.buckets:
            if bucket in answers:
                shared[which] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=len(which)).astype(bool)
        self.found = self.found.take(shared[self.number])
        self.leaders, self.group = distinct(self.data, self.found)
        ids = self.ids[self.found.doc]
        self.least = np.full(len(self.leaders), NONE)
        np.minimum.at(self.least, self.group, ids)
        anchors = self.found.anchor[self.leaders]
        self.leader_buckets = _by_bucket((anchors % np.uint64(self.n_buckets)).astype(np.int64))

    def contents_told(self) -> list[tuple[int, bytes]]:
        out, press = [], zstandard.ZstdCompressor(level=1)
        for bucket, which in self.leader_buckets:
            lead = self.leaders[which]
            first, size = self.found.first[lead], self.found.last[lead] - self.found.first[lead]
            spans = size + LENGTH
            where = np.repeat(first - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            fields = (self.found.anchor[lead].astype("<u8"), self.least[which].astype("<i8"), size.astype(np.uint8), (self.found.place[lead] - first).astype(np.uint8), self.data[where])
            out.append((bucket, press.compress(len(which).to_bytes(4, "little") + b"".join(x.tobytes() for x in fields))))
        return out

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes go."""
        size = self.found.last[self.leaders] - self.found.first[self.leaders] + 1
        begins = np.concatenate([[0], np.cumsum(size)])
        least = np.repeat(self.least, size)  # for each window of each different fragment
        for bucket, which in self.leader_buckets:
            if bucket in answers:
                numbers, values = _read_answer(answers[bucket])
                spans = size[which[numbers]]
                where = np.repeat(begins[which[numbers]] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                least[where] = values
        spans = size[self.group]
        shift = np.arange(spans.sum()) - np.repeat(np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) if len(spans) else np.zeros(0, np.int64)
        gone = least[np.repeat(begins[self.group], spans) + shift] < np.repeat(self.ids[self.found.doc], spans)
        starts = (np.repeat(self.found.first, spans) + shift)[gone]
        depth = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + LENGTH, -1)
        return np.cumsum(depth[:-1]) > 0


def share(told: list[tuple[int, bytes, bytes]]) -> list[tuple[int, bytes]]:
    """A bucket's first answer, for (unit, anchors, several): (unit, bits), a bit for each anchor that occurs in several documents."""
    anchors = [_unpacked(a) for _, a, _ in told]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(a)).astype(bool) for a, (_, _, s) in zip(anchors, told, strict=True)]
    flat = np.concatenate(anchors)
    order = np.argsort(flat, kind="stable")
    new = _borders(flat[order])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(flat)))
    both = (count > 1) | np.logical_or.reduceat(np.concatenate(several)[order], begin)
    shared = np.empty(len(flat), bool)
    shared[order] = both[np.cumsum(new) - 1]
    parts = np.split(shared, np.cumsum([len(a) for a in anchors])[:-1])
    return [(unit, np.packbits(part).tobytes()) for (unit, _, _), part in zip(told, parts, strict=True) if part.any()]


def _read_content(data: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    anchor, least = np.frombuffer(raw, "<u8", n, 4), np.frombuffer(raw, "<i8", n, 4 + 8 * n)
    size, ahead = (np.frombuffer(raw, np.uint8, n, 4 + k * n).astype(np.int64) for k in (16, 17))
    return anchor, least, size, ahead, np.frombuffer(raw, np.uint8, -1, 4 + 18 * n)


def _read_answer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<i8", -1, 4 + 4 * n)


def resolve(told: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """A bucket's second answer, for (unit, contents): (unit, answer), the smallest id of each window of fragments for which it is below the unit's."""
    read = [_read_content(data) for _, data in told]
    anchor, least, size, ahead = (np.concatenate([r[k] for r in read]) for k in range(4))
    data = np.concatenate([r[4] for r in read])
    first = np.concatenate([[0], np.cumsum(size + LENGTH)[:-1]])
    whole = Fragments(anchor, first + ahead, first, first + size, np.zeros(len(first), np.int64))
    leaders, group = distinct(data, whole)
    lowest = np.full(len(leaders), NONE)
    np.minimum.at(lowest, group, least)
    count = size[leaders] + 1
    begins = np.concatenate([[0], np.cumsum(count)])
    known = np.repeat(lowest, count)
    number = np.cumsum(_borders(anchor[leaders])) - 1  # leaders are in the order of anchors
    many = np.bincount(number)[number] > 1
    if many.any():
        windows = np.flatnonzero(np.repeat(many, count))
        shift = np.arange(begins[-1]) - np.repeat(begins[:-1], count)
        starts = (np.repeat(first[leaders], count) + shift)[windows]
        classes = (np.repeat(number, count) * (LENGTH + 1) + np.repeat(ahead[leaders], count) - shift)[windows]  # anchor, and how far it lies within the window
        order, new = equal_groups(data, starts, classes, np.full(len(starts), LENGTH))
        value = known[windows][order]
        value = np.minimum.reduceat(value, np.flatnonzero(new))[np.cumsum(new) - 1]
        known[windows[order]] = value
    out, press, at = [], zstandard.ZstdCompressor(level=1), 0
    lower = np.minimum.reduceat(known, begins[:-1])
    for (unit, _), part in zip(told, read, strict=True):
        mine = np.arange(at, at + len(part[0]))
        at += len(mine)
        which = np.flatnonzero(lower[group[mine]] < least[mine])
        if len(which):
            own = group[mine[which]]
            where = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(count[own])[:-1]]), count[own]) + np.arange(count[own].sum())
            values = np.minimum(known[where], np.repeat(least[mine[which]], count[own]))
            out.append((unit, press.compress(len(which).to_bytes(4, "little") + which.astype("<u4").tobytes() + values.astype("<i8").tobytes())))
    return out


# --- on Spark ------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row for each row of docs: (id, n_bytes, kept, starts, ends): what is left of its bytes, and the removed runs as places in its bytes.

    A null text counts as empty, and texts below LENGTH bytes stay as they are.
    Repeated rows have one id, and so don't repeat each other. A row without an
    id has no smaller or larger ones: it stays whole, and nothing is removed for
    its sake. Other columns are left out, so that none can clash. A table
    without rows gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // unit_bytes))  # units, and as many buckets
    dealt = rows.withColumn("unit", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    units = dealt.groupBy("unit")

    def tell_anchors(key: tuple, table: pa.Table) -> pa.Table:
        told = Unit.of(table, n).anchors_told()
        return _table({"unit": [key[0].as_py()] * len(told), "bucket": [b for b, _, _ in told], "anchors": [a for _, a, _ in told], "several": [s for _, _, s in told]}, _ANCHORS)

    def answer_shared(key: tuple, table: pa.Table) -> pa.Table:
        told = sorted(zip(*(table[k].to_pylist() for k in ("unit", "anchors", "several")), strict=True))
        found = share(told)
        return _table({"unit": [u for u, _ in found], "bucket": [key[0].as_py()] * len(found), "answer": [a for _, a in found]}, _ANSWER)

    def answers(table: pa.Table, kind: int | None = None) -> dict[int, bytes]:
        return dict(zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), strict=True))

    def tell_contents(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        told = []
        if table.num_rows and heard.num_rows:
            unit = Unit.of(table, n)
            unit.hear_shared(answers(heard))
            told = unit.contents_told()
        return _table({"unit": [key[0].as_py()] * len(told), "bucket": [b for b, _ in told], "answer": [c for _, c in told]}, _ANSWER)

    def answer_least(key: tuple, table: pa.Table) -> pa.Table:
        found = resolve(sorted(zip(table["unit"].to_pylist(), table["answer"].to_pylist(), strict=True)))
        return _table({"unit": [u for u, _ in found], "bucket": [key[0].as_py()] * len(found), "answer": [a for _, a in found]}, _ANSWER)

    def finish(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table({k: [] for k in _RESULT.names}, _RESULT)
        order = np.lexsort((np.arange(table.num_rows), table["id"].fill_null(0).to_numpy()))
        table = table.take(pa.array(order))
        unit = Unit.of(table, n)
        first = heard.filter(pc.equal(heard["round"], 1))
        unit.hear_shared(answers(first))
        gone = unit.removed(answers(heard.filter(pc.equal(heard["round"], 2))))
        kept, starts, ends = [], [], []
        for a, b in zip(unit.ends[:-1], unit.ends[1:], strict=True):
            part = gone[a:b]
            steps = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
            starts.append(steps[::2])
            ends.append(steps[1::2])
            kept.append(unit.data[a:b][~part].tobytes())
        return _table({"id": table["id"], "n_bytes": np.diff(unit.ends), "kept": kept, "starts": starts, "ends": ends}, _RESULT)

    shared = units.applyInArrow(tell_anchors, _ddl(_ANCHORS)).groupBy("bucket").applyInArrow(answer_shared, _ddl(_ANSWER))

    # not settled: within one query the texts and the anchors are exchanged once and reused
    told = units.cogroup(shared.groupBy("unit")).applyInArrow(tell_contents, _ddl(_ANSWER))
    least = told.groupBy("bucket").applyInArrow(answer_least, _ddl(_ANSWER))
    heard = shared.withColumn("round", F.lit(1)).unionByName(least.withColumn("round", F.lit(2)))
    return units.cogroup(heard.groupBy("unit")).applyInArrow(finish, _ddl(_RESULT)).withColumnRenamed("id", id_col)


_ANCHORS = pa.schema([("unit", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("several", pa.binary())])
_ANSWER = pa.schema([("unit", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary", "list<item: int32>": "array<int>"}
    return ", ".join(f"`{field.name}` {names[str(field.type)]}" for field in schema)


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, schema.field(k).type) for k, v in columns.items()}, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
