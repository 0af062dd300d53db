import random

from tidemark.llm import linechunks, pipeline

from . import awkward
from .awkward import words


def brute(rows):
    """What is left of (id, text), by looking each span up in all that comes before; borders are made anew for each line, from sums of powers."""
    import hashlib

    def spans(lines):
        full = [k for k, line in enumerate(lines) if line.strip()]
        number = [int(hashlib.md5(lines[k]).hexdigest()[:8], 16) for k in full]
        long_ = [len(lines[k].split()) >= 10 or len(lines[k]) >= 60 for k in full]
        sums = [sum(number[n - j] * 31**j for j in range(linechunks.WINDOW) if n >= j) for n in range(len(full))]
        borders = [n for n in range(len(full) - 1) if long_[n] or long_[n + 1] or sums[n] % linechunks.DIVISOR == 0]
        for first, last in zip([0, *(n + 1 for n in borders)], [*borders, len(full) - 1]):
            if last > first or last == first and long_[first]:
                yield full[first], full[last]
        for n in borders:
            if not long_[n] or not long_[n + 1]:
                yield full[n], full[n + 1]

    out, before = {}, set()
    for doc_id, text in sorted(rows):
        lines = text.encode().split(b"\n")
        own = [(b"\n".join(lines[a : z + 1]), a, z) for a, z in spans(lines)]
        gone = set()
        for span, a, z in own:
            if span in before or any(s == span and e < a for s, _, e in own):
                gone.update(range(a, z + 1))
        for k, line in enumerate(lines):
            if not line.strip():
                sides = [next((j for j in side if lines[j].strip()), None) for side in (range(k, -1, -1), range(k, len(lines)))]
                gone.discard(k)
                if any(j is not None for j in sides) and all(j is None or j in gone for j in sides):
                    gone.add(k)
        out[doc_id] = b"\n".join(line for k, line in enumerate(lines) if k not in gone).decode(), len(lines), len(gone)
        before |= {span for span, _, _ in own}
    return out


def found_in(rows, spark, **given):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.text, r["__lines"], r["__removed"]) for r in linechunks.drop_repeats(docs, **given).collect()}


def test_random_texts_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["a", "b", "", " ", "\t", "c c", "\x01", words(rng, 12), "é" * 40, *(f"short {k}" for k in range(4))]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(-20, 100)]
    assert found_in(rows, spark) == brute(rows)
    monkeypatch.setattr(linechunks, "WINDOW", 4)
    monkeypatch.setattr(linechunks, "DIVISOR", 3)
    wanted, before = brute(rows), set()
    for doc_id, text in sorted(rows):
        left, *counts = linechunks.without(text.encode(), set(), before)
        assert (text if left is None else left.decode(), *counts) == wanted[doc_id]
        before |= set(linechunks.occurrences(text.encode()))


def test_planted_passages_and_copies_go(spark):
    """Passages of 50 words over two to five lines, amid other lines, and copies of texts of one line or more."""
    rng = random.Random(4)
    line = lambda: words(rng, 12)
    rows, planted, copies = [], {}, {}
    for k in range(40):
        n = 2 + k % 4
        passage = [words(rng, 50 // n + 1) for _ in range(n)]
        for copy in range(3):
            doc = 3 * k + copy
            above, below = [line() for _ in range(rng.randint(1, 4))], [line() for _ in range(rng.randint(1, 4))]
            rows.append((doc, "\n".join(above + passage + below)))
            planted[doc] = "\n".join(above + below) if copy else rows[-1][1]
    for k in range(40):
        text = "\n".join(line() for _ in range(1 + k % 5))
        rows += [(1000 + k, text), (2000 + k, text)]
        copies[1000 + k], copies[2000 + k] = text, ""
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    found = pipeline.drop_line_chunks(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in found} == planted | copies
    assert all(r.n_chars == len(r.text) for r in found)


def test_an_insertion_moves_only_the_borders_beside_it():
    lines = [b"line %d" % (k * k) for k in range(100)]
    moved = [b"new first line", *lines[:50], b"and another", *lines[50:]]
    cut = lambda x: {tuple(x[a : z + 1]) for a, z in linechunks.spans_of(x)}
    assert len(cut(lines)) > 50 and len(cut(lines) & cut(moved)) >= len(cut(lines)) - 6


def test_unequal_bytes_under_one_key_stay(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, "\n".join(words(rng, 1) for _ in range(rng.randint(2, 4)))) for k in range(90)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 90, 2)]
    for common in (linechunks.COMMON, 0):
        monkeypatch.setattr(linechunks, "COMMON", common)
        assert found_in(rows, spark, key_bytes=1) == brute(rows)


def test_awkward_documents(spark, monkeypatch):
    texts = {d[0]: d[1] for d in awkward.documents() if d[0] is not None}
    for common in (linechunks.COMMON, 0):
        monkeypatch.setattr(linechunks, "COMMON", common)
        docs = awkward.frame(spark)
        found = linechunks.drop_repeats(docs).collect()
        assert len(found) == len(awkward.documents()) and set(docs.columns) <= set(found[0].asDict())
        left = {r.doc_id: r.text for r in found if r.doc_id is not None}
        assert left == texts | {5: "", 12: "intro line\noutro line"}
        assert sorted(r.text or "" for r in found if r.doc_id is None) == ["", texts[1]]
    assert linechunks.drop_repeats(awkward.frame(spark, [])).count() == 0
