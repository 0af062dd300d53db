import random

from pyspark.sql import functions as F

from tidemark.llm import decontamination as dec

from . import awkward


def best_distance(item, text):
    """The least edit distance of an item to any part of a text."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        fresh = [0]
        for i, d in enumerate(item, 1):
            fresh.append(min(column[i - 1] + (d != c), column[i] + 1, fresh[i - 1] + 1))
        column = fresh
        best = min(best, column[-1])
    return best


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        fresh = [i]
        for j, d in enumerate(b, 1):
            fresh.append(min(row[j - 1] + (c != d), row[j] + 1, fresh[j - 1] + 1))
        row = fresh
    return row[-1]


def test_matches_are_those_of_a_full_table():
    rng = random.Random(4)
    alphabet, hits = "abcdefgh ", 0
    for _ in range(250):
        item = "".join(rng.choice(alphabet) for _ in range(rng.choice((rng.randint(2, 12), rng.randint(13, 40), rng.randint(40, 110)))))
        index = dec.Index([0], [item], dec.Q, dec.EDITS)
        budget = int(len(item) * 0.08)
        edited = list(item)
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet)])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + "".join(edited) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        found = [m for m in dec.find(index, ["zzz", text]) if m[0] == 1]
        distance = best_distance(item, text)
        assert bool(found) == (distance <= budget)
        hits += bool(found)
        if found:
            assert min(m[4] for m in found) == distance
            assert all(edit_distance(item, text[m[2] : m[3]]) == m[4] for m in found)
    assert hits > 50


def test_repetitive_texts_and_items():
    """Every gram hits every place; memory stays bounded, and the matches cover the text."""
    import resource
    import time

    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for unit, n in (("a", 200_000), ("ab", 100_000)):
        index = dec.Index([0], [(unit * 400)[:400]], dec.Q, dec.EDITS)
        found = dec.find(index, [unit * n])
        assert {m[4] for m in found} == {0} and len(found) > 400
        assert all(a[3] <= b[2] < a[3] + 400 for a, b in zip(found, found[1:]))  # nothing fits between them
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert time.time() - began < 120
    index = dec.Index([0], ["ab" * 20], dec.Q, dec.EDITS)
    text = "x" + "ab" * 30 + "yy" + "ab" * 19 + "b" + "zz"
    assert [m[2:] for m in dec.find(index, [text])] == [(1, 41, 0), (63, 102, 1)]


def test_counts_are_those_of_one_pass(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(80)) for _ in range(5)]
    points = dec.codes("".join(rng.choice("ab") for _ in range(3000)))
    index = dec.Index([*range(5)], texts, 4, dec.EDITS)
    whole = [x.tolist() for x in index.by_q[0].shared(points, index.budget)]
    monkeypatch.setattr(dec, "HITS", 50)
    assert [x.tolist() for x in index.by_q[0].shared(points, index.budget)] == whole and sum(whole[2]) > 10_000


def test_awkward_tables(spark):
    docs = awkward.documents()
    passage = docs[6][1].split(" ", 30)[30].split(" ")
    passage = " ".join(passage[:40])
    items = [(1, passage), (2, None), (3, ""), (4, "  "), (5, passage.upper()), (6, "漢字"), (None, "intro line")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "doc_id", "start")})
    found = dec.find_items(awkward.frame(spark), benchmark).collect()
    pairs = sorted({(r.doc_id, r.item_id) for r in found}, key=str)
    assert pairs == sorted([(7, 1), (7, 5), (8, 1), (8, 5), (18, 6), (12, None)], key=str)
    assert sum(r.doc_id == 12 for r in found) == 2  # repeated rows repeat
    texts = {d[0]: d[1] for d in docs}
    assert all(texts[7][r.start : r.end] == passage for r in found if r.doc_id == 7)
    assert dec.find_items(awkward.frame(spark, []), benchmark).count() == 0
    assert dec.find_items(awkward.frame(spark), benchmark.limit(0)).count() == 0


def test_several_blocks_find_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, dec.find_items(docs, items).collect()))
    monkeypatch.setattr(dec, "BLOCK_BYTES", 3000)  # read by the driver
    assert sorted(map(tuple, dec.find_items(docs, items).collect())) == whole
    texts = {r.doc_id: dec.normal(r.text) for r in docs.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if dec.normal(r.text) in t}
    assert exact <= {m[:2] for m in whole} and exact
