"""Byte-level BPE encoding and decoding.

A pre-token's merges are ordered by a rank queue: one bucket of positions for
each merge rank that is waiting, and a hierarchical bitmap over the ranks, in
which three find-first-set steps give the lowest waiting rank. The symbols form
a linked list; a position whose pair has changed since it was queued is stale
and is skipped. The work for a pre-token of n bytes is O(n log n) at worst, so a
pre-token of megabytes is as safe as a word.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, slices

#: Pre-tokens that are kept with their ids, in each Python worker, at most. When they are so many, the later half goes: frequent ones come early.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens aren't kept.
CACHE_LENGTH = 48
#: Ranks to a word of the bitmap: 2 ** GROUP.
GROUP = 8
MASK = (1 << GROUP) - 1
#: Bytes of text whose tokens are handed on at once.
SLICE_BYTES = 4 << 20
#: A rank file above this isn't sent to the executors.
MOST_RANK_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a token in base 64, a blank, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


#: Characters outside the basic plane.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=8)
def compile_pattern(pattern: str, last: int) -> re.Pattern:
    r"""Compiles a pattern that uses \p{L}, \p{N} and \s in the Unicode sense for the re module, for texts of characters up to last. Sets within the basic plane are tables there, and so fast."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, last + 1))))

    def ranges(kind: str) -> str:
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(f"{kind}+", every))

    sets = {kind: ranges(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        kind = next((k for k in sets if pattern.startswith(k, i)), None)
        if kind:
            out.append(sets[kind] if inside else f"[{sets[kind]}]")
            i += len(kind)
        elif pattern.startswith(r"\S", i):
            out.append(f"[^{sets[chr(92) + 's']}]")
            i += 2
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


class Codec:
    """Encodes and decodes by a table of ranks and a pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern, self.basic = pattern, compile_pattern(pattern, 0xFFFF).findall
        self.most = max(ranks.values(), default=0)
        self.vocabulary: list[bytes | None] = [None] * (self.most + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.fine = [0] * ((self.most >> GROUP) + 1)  # all zero between pre-tokens
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.double = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        self.packed = _Packed(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue: buckets[rank] has the positions at which a pair of this rank
        waits, fine[g] a bit for each waiting rank of group g, coarse a bit for
        each group that has any. Find-first-set on coarse and then on a word of
        fine gives the lowest rank.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, fine, coarse, buckets, single, double = len(piece), self.fine, 0, {}, self.single, self.double
        following, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # the linked list of symbols, by their first byte
        symbols = [single[b] for b in piece]  # the id of the symbol that starts here
        waiting = [double[a][b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts here
        waiting.append(None)
        i = 0
        for rank in waiting:
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, and so a heap
                else:
                    buckets[rank] = [i]
                    group = rank >> GROUP
                    fine[group] |= 1 << (rank & MASK)
                    coarse |= 1 << group
            i += 1
        while coarse:
            group = (coarse & -coarse).bit_length() - 1
            word = fine[group]
            rank = (group << GROUP) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)  # the leftmost
            else:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                fine[group] = word
                if not word:
                    coarse &= coarse - 1
            if waiting[i] != rank:
                continue  # stale: one of the pair's symbols has been merged since
            symbols[i] = rank
            gone = following[i]
            after = following[i] = following[gone]
            waiting[gone] = None
            fresh = None
            if after < n:
                before[after] = i
                fresh = get(piece[i : following[after]])
            waiting[i] = fresh
            if fresh is not None:
                if fresh in buckets:
                    heappush(buckets[fresh], i)
                else:
                    buckets[fresh] = [i]
                    group = fresh >> GROUP
                    fine[group] |= 1 << (fresh & MASK)
                    coarse |= 1 << group
            i = before[i]
            if i >= 0:
                fresh = waiting[i] = get(piece[i:after])
                if fresh is not None:
                    if fresh in buckets:
                        heappush(buckets[fresh], i)
                    else:
                        buckets[fresh] = [i]
                        group = fresh >> GROUP
                        fine[group] |= 1 << (fresh & MASK)
                        coarse |= 1 << group
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = following[i]
        return out

    def pieces(self, text: str) -> list[str]:
        return compile_pattern(self.pattern, sys.maxunicode).findall(text) if ASTRAL.search(text) else self.basic(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Packed(dict):
    """Pre-tokens to packed ids."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        ids = self.codec.merge(raw)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                early = [*islice(self.items(), CACHE_ENTRIES // 2)]
                self.clear()
                self.update(early)
            self[piece] = packed
        return packed


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for each Python worker, kept between tasks."""
    key = (hash(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data), pattern)
    return _CODECS[key]


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has more than {MOST_RANK_BYTES} bytes")
    return data


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text: (id, ids), ids packed as little-endian unsigned 32-bit integers.

    One row for each row of docs, whatever else it has; other columns are left
    out, so that none can clash. A null text counts as empty, an empty text has
    no ids, a null id stays null, repeated rows stay repeated, and a table
    without rows gives none. Special tokens are ordinary text. The rank file is
    read by the driver and sent to the executors, MOST_RANK_BYTES at most.
    """
    data = docs.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            ids = [codec.encode(text.decode("utf-8", "replace")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), as_bytes(text_col).alias("__text")).mapInArrow(encode, f"`{id_col}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes packed ids: (id, ids, decoded), decoded as bytes. Null ids count as none; an id without a token is an error."""
    data = encoded.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, r"\s+")
        for batch in batches:
            texts = [codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias(ids_col)).mapInArrow(decode, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")


def transcode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids in the same Python worker: (id, ids, decoded). Cases are as for encode_documents."""
    data = docs.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def transcode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for whole in batches:
            for batch in slices([whole], "__text", SLICE_BYTES):
                ids = [codec.encode(text.decode("utf-8", "replace")) for text in batch.column(1).to_pylist()]
                texts = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), texts], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), as_bytes(text_col).alias("__text")).mapInArrow(transcode, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes what was encoded, and digests both: (id, n_tokens, ids_sha256, decoded_sha256)."""
    return transcode_documents(docs, ranks_path, pattern, id_col, text_col).select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._common import read_table

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
