import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import minjoin, pipeline

from . import awkward


def brute(docs):
    """(class, links) by all pairs that share a run of words."""
    named = {i: t for i, t in docs if i is not None and t is not None}
    sets = {}
    for i, text in named.items():
        found = [w for w in re.split(r"[\x00-\x20]+", text) if w]
        sets[i] = {tuple(found[k : k + 5]) for k in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())
    holders, copies = defaultdict(list), defaultdict(list)
    for i, s in sets.items():
        copies[named[i]].append(i)
        for g in s:
            holders[g].append(i)
    parent, links = {i: i for i in named}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        near = {j for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9} | set(copies[named[i]])
        for j in near - {i}:
            links[i] += 1
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in named}


def test_real_documents(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = brute([(r.doc_id, r.text) for r in df.collect()])
    monkeypatch.setattr(minjoin, "BLOCK", 2)  # large buckets, in small
    assert {r.doc_id: (r.class_id, r.n_links) for r in minjoin.join_similar(df).collect()} == wanted
    assert sum(n for _, n in wanted.values())


def test_awkward_documents(spark):
    docs = awkward.documents()
    found = minjoin.join_similar(awkward.frame(spark)).collect()
    assert len(found) == len(docs)
    wanted = brute([d[:2] for d in docs])
    for r in found:
        if r.doc_id is None:
            assert (r.class_id, r.n_links) == (None, 0)
        elif r.doc_id == 12:  # a repeated row is one more copy
            assert r.n_copies == 1 and r.class_id == wanted[12][0]
        elif r.doc_id not in wanted:  # a null text
            assert (r.class_id, r.n_links) == (r.doc_id, 0)
        else:
            assert r.class_id == wanted[r.doc_id][0]
    assert {r.doc_id: r.class_id for r in found}[5] == 1 and {r.doc_id: r.class_id for r in found}[17] == 16
    assert minjoin.join_similar(awkward.frame(spark, [])).count() == 0


def test_one_id_on_several_texts(spark):
    """Links are those of texts, so that an id in two groups doesn't lose either, or join them."""
    rng = random.Random(2)
    a, b, c = (awkward.words(rng, 60) for _ in range(3))
    rows = [(1, a), (5, a + " x"), (5, b), (7, b + " y"), (5, b), (9, c), (9, c + " z"), (9, c + " z"), (10, c + " q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in minjoin.join_similar(docs).collect())
    assert found == [(1, 1, 1, 0), (5, 1, 1, 0), (5, 5, 2, 1), (5, 5, 2, 1), (7, 5, 2, 0), (9, 9, 3, 0), (9, 9, 3, 1), (9, 9, 3, 1), (10, 9, 3, 0)]
    left = [tuple(r) for r in pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert len(left) == 3 and {i: t for i, t in left if i != 9} == {1: a, 5: b} and [t for i, t in left if i == 9][0] in (c, c + " z")


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Every pair of 2,500 near copies is a link, no row is a list of them, and blocks are cut by texts and bytes as well."""
    rng = random.Random(3)
    base = awkward.words(rng, 60)
    rows = [(k, f"{base} end{k}") for k in range(2500)] + [(3000 + k, awkward.words(rng, 30)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for name, value in (("SPREAD", minjoin.SPREAD), ("BLOCK_TEXTS", 300), ("BLOCK_BYTES", 100_000)):
        monkeypatch.setattr(minjoin, name, value)
        if name != "SPREAD":
            monkeypatch.setattr(minjoin, "SPREAD", 1)
        found = {r.doc_id: (r.class_id, r.n_links) for r in minjoin.join_similar(docs).collect()}
        assert found == {i: (0, 2499) if i < 2500 else (i, 0) for i, _ in rows}


def test_common_texts_are_the_same_by_broadcast(spark, monkeypatch):
    docs = awkward.frame(spark)
    whole = sorted(map(tuple, minjoin.join_similar(docs).collect()), key=str)
    monkeypatch.setattr(minjoin, "COMMON", 0)
    assert sorted(map(tuple, minjoin.join_similar(docs).collect()), key=str) == whole


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    n = 4000
    for similarity, low, high in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.001)):
        left = rng.integers(0, 1 << 16, (n, minjoin.HASHES), dtype=np.uint16)
        right = np.where(rng.random((n, minjoin.HASHES)) < similarity, left, rng.integers(0, 1 << 16, (n, minjoin.HASHES), dtype=np.uint16))
        kept = minjoin.surviving(np.concatenate([left, right]), np.arange(n), np.arange(n) + n)
        assert low <= len(kept) / n <= high


def test_both_ways_of_verifying_agree():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    dense = minjoin.linked(sets, left, right, 0.5)
    single = np.array([minjoin.linked([sets[a], sets[b]], np.array([0]), np.array([1]), 0.5)[0] for a, b in zip(left, right, strict=True)])
    assert (dense == single).all() and dense.any() and not dense.all()


def test_components(spark):
    chain = [(k + 1, k) for k in range(30)] + [(100, 90), (95, 90), (200, 100)]
    found = {r.node: r["class"] for r in minjoin.components(spark.createDataFrame(chain, "node long, lowest long")).collect()}
    assert all(found[k] == 0 for k in range(31)) and all(found[k] == 90 for k in (90, 95, 100, 200))
