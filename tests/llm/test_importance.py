import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import importance, queries, textvec

from . import awkward


def test_held_out_labels(spark):
    """Rows that the classifier never saw: labels beyond its sample."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    seen, unseen = labels.filter("pmod(xxhash64(doc_id), 4) != 0"), labels.filter("pmod(xxhash64(doc_id), 4) = 0")
    drawn = importance.resample(docs, seen)
    judged = unseen.join(drawn.select("doc_id", F.lit(True).alias("drawn")), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("drawn").alias("drawn"))
    rates = {r.quality: r.drawn / r.n for r in judged.collect()}
    assert rates[1] > 0.99 and rates[0] < 0.15, rates


def test_largest_is_exact(spark):
    values = [-(2**63), -5, -5, -1, 0, 7, 7, 7, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert importance.largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.largest(df, "v", 0) is None and importance.largest(df, "v", 99) is None


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    drawn = importance.resample(awkward.frame(spark), labels).collect()
    with_words = [d[0] for d in awkward.documents() if d[1] and d[1].strip(" \n\t")]
    assert sorted((r.doc_id for r in drawn), key=str) == sorted(with_words, key=str)  # no bad label: all that have words
    assert importance.resample(awkward.frame(spark), labels.limit(0)).count() == len(with_words)
    assert importance.resample(awkward.frame(spark, []), labels).count() == 0


def test_sampling_follows_the_weights(spark):
    """Of two weights that are 1 apart, the larger is drawn e times as often at temperature 1, less what drawing without replacement takes."""
    keys = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("log_weight"), F.lit(1).alias("n_ngrams"))
    keyed = keys.select("id", importance._key("id", 1.0, importance.SEED).alias("key")).filter("key IS NOT NULL")
    least = importance.largest(keyed, "key", 500)
    odd = keyed.filter(F.col("key") >= least).filter("id % 2 = 1").count() / 500
    assert 0.62 < odd < 0.80  # e to 1 without replacement


def test_draws_of_real_rows_follow_the_weights(spark):
    """k as given, another draw with each seed, and by groups of weight a rate as the exponential race has it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    weights = {r.doc_id: r.log_weight for r in importance.weigh(docs, importance.fit(docs, labels)).filter("n_ngrams > 0").collect()}
    temperature, k, rounds, drawn = 30.0, 200, 8, Counter()
    for seed in range(rounds):
        found = {r.doc_id for r in importance.resample(docs, labels, k, temperature=temperature, seed=seed).collect()}
        assert len(found) == k
        drawn.update(found)
    assert len(drawn) > 1.5 * k
    rng, ids, expected = np.random.default_rng(1), sorted(weights), Counter()
    scaled = np.array([weights[i] for i in ids]) / temperature
    for _ in range(400):  # k draws, one after another, each in proportion to what is left
        order = np.argsort(rng.exponential(size=len(ids)) / np.exp(scaled - scaled.max()))[:k]
        expected.update(ids[n] for n in order)
    order = sorted(ids, key=weights.get)
    for part in np.array_split(np.array(order), 5):
        got, wanted = sum(drawn[i] for i in part) / rounds, sum(expected[i] for i in part.tolist()) / 400
        assert abs(got - wanted) < 6 + 0.15 * wanted


def plainly(texts, labels, noises, k, marks):
    """Drawn ids, from words, models, threshold and keys made with integers and dictionaries."""
    most = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ x >> 27) * 0x94D049BB133111EB & most
        return x ^ x >> 31

    @lru_cache(None)
    def hash_of(word):
        return mixed(sum(int(textvec._BYTES[b]) * pow(base, j, 1 << 64) for j, b in enumerate(word)) & most)

    def grams(text):
        hashes = [hash_of(word) for word in re.split(rb"[\x00-\x20]+", text) if word]
        single = [mixed(h * base & most) for h in hashes]
        double = [0 if a == b else mixed(((a * base + b) * base) & most) for a, b in zip(hashes, hashes[1:])]
        return [g >> 64 - importance.BITS for g in single + double]

    found = {i: grams((t or "").encode()) for i, t in texts.items()}
    raw, target = Counter({b: 1 for b in range(importance.BUCKETS)}), Counter({b: 1 for b in range(importance.BUCKETS)})
    for i, buckets in found.items():
        raw.update(buckets)
        if labels.get(i) == 1 and marks[i] % 3:
            target.update(buckets)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {b: math.log(target[b] / n_target) - math.log(raw[b] / n_raw) for b in range(importance.BUCKETS)}
    total = {i: sum(ratio[b] for b in buckets) for i, buckets in found.items()}
    held = sorted((total[i] / (len(found[i]) + importance.SHRINK), labels[i]) for i in labels if i in found and marks[i] % 3 == 0)
    cuts = [held[0][0] - 1, *(m for m, _ in held)]
    right = [sum((m > c) == (good == 1) for m, good in held) for c in cuts]
    best = max(range(len(cuts)), key=lambda n: (right[n], -n))
    threshold = (cuts[best] + min((m for m, _ in held if m > cuts[best]), default=held[-1][0])) / 2
    keys = {i: round(((total[i] - threshold * (len(b) + importance.SHRINK)) + noises[i]) / importance.STEP) for i, b in found.items() if b}
    k = sum(total[i] >= threshold * (len(found[i]) + importance.SHRINK) for i in keys) if k is None else k
    least = sorted(keys.values(), reverse=True)[k - 1]
    return {i for i, key in keys.items() if key >= least}


def test_draw_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    noises = {r[0]: r[1] for r in docs.select("doc_id", importance.noise("doc_id", importance.SEED)).collect()}
    marks = {r[0]: r[1] for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(importance.SEED))).collect()}
    texts, known = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    for k in (None, 20, 900):
        drawn = {r.doc_id for r in importance.resample(docs, labels, k).collect()}
        assert drawn == plainly(texts, known, noises, k, marks) and (k is None or len(drawn) == k)


def test_query(spark):
    assert 800 < queries.QUERIES["op7_importance_resampling"](spark, "/root/testdata/sf0.01").count() < 1000
