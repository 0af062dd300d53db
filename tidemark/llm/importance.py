"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (single words and pairs), BUCKETS
wide: one of all texts as they are, one of the target, which is labelled rows of
good quality. Pairs of a word with itself are one n-gram, whatever the word: a
feature made by hand, for texts that repeat words. A document's weight is the
sum of the log ratios of its n-grams, less what the threshold takes for each
n-gram and for SHRINK more of them, so that short texts need more than a word or
two to be told from good ones. Rows are then drawn without replacement, with
probabilities in proportion to the exponential of weight over temperature, by
Gumbel top-k: each weight over temperature gets Gumbel noise of its own, and the
k largest sums are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from ._common import as_bytes, binary_view, read_table, settle, slices

BITS = 14
BUCKETS = 1 << BITS
#: The classifier is fitted on so many labelled rows at most, those with the lowest hashes of their ids: a third of them sets the threshold. The model of raw text counts every row.
LABELLED_ROWS = 24_000
SHRINK = 30
TEMPERATURE = 1.0
SEED = 7
#: Keys are compared in steps of this.
STEP = 2.0**-16
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    """ratios[bucket] is the log of target over raw; threshold is the least mean that counts as good; accuracy is on the rows that set it."""

    ratios: np.ndarray
    threshold: float
    accuracy: float


def buckets_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram of a batch."""
    _, _, hashes, firsts = textvec.words(data, ends)
    single, ends1 = textvec.ngrams(hashes, firsts, 1)
    double, ends2 = textvec.ngrams(hashes, firsts, 2)
    where = np.arange(len(double)) + np.repeat(firsts[:-1] - ends2[:-1], np.diff(ends2))
    double[hashes[where] == hashes[where + 1]] = np.uint64(0)
    texts = np.arange(len(ends) - 1)
    return (
        (np.concatenate([single, double]) >> np.uint64(64 - BITS)).astype(np.int64),
        np.concatenate([np.repeat(texts, np.diff(ends1)), np.repeat(texts, np.diff(ends2))]),
    )


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = LABELLED_ROWS) -> DataFrame:
    """(id, good, held): at most `most` labelled ids, by the hash of the id. Ids with labels that differ, or null, are left out; repeats count once."""
    each = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    mark = F.xxhash64("id", F.lit(SEED))
    return each.filter("low = high").orderBy(mark, "id").limit(most).select("id", (F.col("low") == 1).alias("good"), (F.pmod(mark, F.lit(3)) == 0).alias("held"))


def count_ngrams(docs: DataFrame, text_col: str, target: Column) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of those that count as target. Each task sends one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "__text", SLICE_BYTES):
            bucket, text = buckets_of(*binary_view(batch.column(0)))
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            wanted += np.bincount(bucket[chosen[text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(wanted[some])], names=["bucket", "raw", "target"])

    rows = docs.select(as_bytes(text_col).alias("__text"), F.coalesce(target, F.lit(False)).alias("__target"))
    return rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Counts all rows for the raw model and the sampled good ones for the target, then sets the threshold on held rows.

    Nothing is rejected (a threshold of minus infinity) if no label says good or none says bad.
    """
    sample = settle(sample_labels(labels, id_col, label_col))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id", "left")  # LABELLED_ROWS at most
    counts = np.ones((2, BUCKETS))
    for row in count_ngrams(marked, "text", F.col("good") & ~F.col("held")).collect():  # BUCKETS rows at most
        counts[:, row["bucket"]] += row["raw"], row["target"]
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    held = marked.filter("held")
    scores = weigh(held, Model(ratios, 0.0, 0.0), "id", "text", ["good"])
    found = scores.groupBy("id").agg(*(F.min(c).alias(c) for c in ("good", "n_ngrams", "log_ratio"))).collect()  # a row for each sampled id
    good = np.array([row["good"] for row in found], bool)
    if counts[1].sum() == BUCKETS or good.all() or not good.any():
        return Model(ratios, -np.inf, float("nan"))
    mean = np.array([row["log_ratio"] / (row["n_ngrams"] + SHRINK) for row in found])
    order = np.argsort(mean, kind="stable")
    right = np.concatenate([[good.sum()], good.sum() + np.cumsum(np.where(good[order], -1, 1))])  # if the lowest k are rejected
    cuts = np.concatenate([[mean[order[0]] - 1], mean[order]])
    borders = np.flatnonzero(np.append(np.diff(mean[order]) > 0, True)) + 1
    borders = np.concatenate([[0], borders[borders < len(mean)]])
    best = borders[np.argmax(right[borders])]
    threshold = (cuts[best] + mean[order[min(best, len(mean) - 1)]]) / 2
    return Model(ratios, float(threshold), float(right[best] / len(mean)))


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, n_ngrams, log_ratio, log_weight), one row for each row of docs."""
    ratios, threshold, keep = model.ratios, model.threshold, keep or []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            bucket, text = buckets_of(*binary_view(batch.column(0)))
            n = np.bincount(text, minlength=batch.num_rows)
            total = np.bincount(text, ratios[bucket], minlength=batch.num_rows)
            weight = total - (threshold * (n + SHRINK) if np.isfinite(threshold) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(total), pa.array(weight)], names=[*batch.schema.names[1:], "n_ngrams", "log_ratio", "log_weight"])

    rows = docs.select(as_bytes(text_col).alias("__text"), F.col(id_col), *keep)
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[1:])
    return rows.mapInArrow(score, f"{kinds}, n_ngrams long, log_ratio double, log_weight double")


def largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: four counts of 16 bits each, at most 65,536 rows to the driver a time."""
    if k <= 0:
        return None
    ordered = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # so that unsigned order is the order of the values
    prefix, left, rows = 0, k, keys.select(ordered.alias("v"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        counts = {row["d"]: row["n"] for row in rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for found in sorted(counts, reverse=True):
            if counts[found] >= left:
                break
            left -= counts[found]
        else:
            return None
        prefix = (prefix << 16) | found
        rows = rows.filter(digit == found)
    prefix ^= 1 << 63
    return prefix - (1 << 64) if prefix >= 1 << 63 else prefix


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise, a function of the id and the seed."""
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit("gumbel"), F.lit(seed)), F.lit(1 << 48)) + 0.5) / float(1 << 48)
    return -F.log(-F.log(uniform))


def _key(id_col: str, temperature: float, seed: int) -> Column:
    """Weight over temperature plus noise, in steps; null for a text without words."""
    return F.when(F.col("n_ngrams") > 0, F.round((F.col("log_weight") / temperature + noise(id_col, seed)) / STEP).cast("long"))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: list[str] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """The k drawn rows: (id, kept columns, n_ngrams, log_weight).

    Without k, as many rows are drawn as have a weight of 0 or more, that is, as
    the threshold counts as good; which ones is still drawn. A text without
    words (null, empty, blank) has no n-grams and is never drawn; a text of any
    length counts whole. The noise is a function of the id and the seed, so a
    run repeats itself; rows with one id, and rows without an id, share their
    noise. Rows that tie at the k-th place are all drawn, repeated rows as often
    as they occur; with k above their number all rows with words are. Columns
    that aren't asked for are left out, so that none can clash; a table without
    rows gives none; without labels of both kinds, every row's weight is its log
    ratio, and without k every row with words is drawn.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    key = _key(id_col, temperature, seed)
    scored = settle(weigh(docs, model, id_col, text_col).select("log_weight", key.alias("key")).filter(F.col("key").isNotNull()))
    every = scored.count()
    if k is None:
        k = every if not np.isfinite(model.threshold) else scored.filter("log_weight >= 0").count()
    least = largest(scored, "key", min(k, every))
    found = weigh(docs, model, id_col, text_col, keep)  # no row moves between tasks
    return found.filter(F.lit(False) if least is None else key >= least).drop("log_ratio")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
