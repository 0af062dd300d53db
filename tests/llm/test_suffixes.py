import numpy as np

from tidemark.llm import suffixes

from . import awkward


def brute(docs, length=suffixes.LENGTH):
    first, out = {}, []
    named = sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
    for doc_id, text in named:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], doc_id)
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[k : k + length]] < doc_id:
                gone[k : k + length] = True
        out.append((doc_id, len(data), bytes(np.frombuffer(data, np.uint8)[~gone]), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return sorted(out, key=str)


def rows(df, unit_bytes):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.starts)) for r in suffixes.remove_repeats(df, unit_bytes=unit_bytes).collect()), key=str)


def test_awkward_documents(spark):
    docs = [d for d in awkward.documents() if d[0] != 9]
    docs += [(40, "ab" * 300 + "c" + "ab" * 200, "en", "a", 1), (41, "\x00" * 200, "en", "a", 1), (42, "\x00" * 120 + "q", "en", "a", 1)]
    wanted = brute([d[:2] for d in docs])
    for unit_bytes in (3000, 4 << 20):
        assert rows(awkward.frame(spark, docs), unit_bytes) == wanted
    assert suffixes.remove_repeats(awkward.frame(spark, [])).count() == 0


def test_real_documents_over_many_units(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = brute([(r.doc_id, r.text) for r in df.collect()])
    assert rows(df, 20_000) == wanted
    assert any(n for _, _, _, n in wanted)


def test_sorting_finds_equal_strings_and_orders_the_rest():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1000:1200] = data[200:400]
    data[2000:2300] = 97
    starts = np.arange(0, 2900, 1)
    classes = starts % 2
    lengths = np.where(classes == 0, suffixes.LENGTH, 73)
    order, new = suffixes.equal_groups(data, starts, classes, lengths)
    strings = [(int(classes[k]), data[starts[k] : starts[k] + lengths[k]].tobytes()) for k in order]
    assert strings == sorted(strings)
    assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_each_step_of_the_sort():
    """The shallow sort orders heads of 16 bytes, in segments of all sizes; the tries order what it leaves, by bytes of any value."""
    rng = np.random.default_rng(5)
    for alphabet, n, spread in ((2, 500, 1), (256, 500, 3), (1, 60, 2), (3, 2000, 40)):
        data = rng.integers(0, alphabet, 4000, dtype=np.uint8)
        starts, classes = rng.integers(0, 3900, n), rng.integers(0, spread, n)
        chars = suffixes.eights(data)
        order, new = suffixes.multikey_quicksort(chars, starts, classes, suffixes.SHALLOW)
        heads = [(int(classes[k]), data[starts[k] : starts[k] + suffixes.SHALLOW].tobytes()) for k in order]
        assert heads == sorted(heads) and new.tolist() == [k == 0 or heads[k] != heads[k - 1] for k in range(n)]
        groups = np.sort(classes)
        rows = starts[np.argsort(classes, kind="stable")]
        lengths = np.full(n, 61)
        inner, border = suffixes.blind_tries(data, chars, rows, groups, lengths, 0)
        whole = [(int(groups[k]), data[rows[k] : rows[k] + 61].tobytes()) for k in inner]
        assert whole == sorted(whole) and border.tolist() == [k == 0 or whole[k] != whole[k - 1] for k in range(n)]


def test_short_strings_go_to_the_tries_alone():
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    order, new = suffixes.equal_groups(data, np.array([0, 3, 6, 1]), np.zeros(4, int), np.full(4, 3))
    assert order.tolist() == [0, 2, 1, 3] and new.tolist() == [True, False, True, True]


def test_documents_of_more_than_16_megabytes_have_the_same_fragments(monkeypatch):
    """Their path is taken by all documents once PACKED is zero."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 20_000, dtype=np.uint8)
    data[9000:9500] = data[100:600]
    data[15_000:16_000] = 98
    ends = np.array([0, 9000, 9030, 20_000])
    whole = suffixes.fragments(data, ends)
    monkeypatch.setattr(suffixes, "PACKED", 0)
    found = suffixes.fragments(data, ends)
    assert all((getattr(whole, k) == getattr(found, k)).all() for k in whole.__dataclass_fields__)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last, strict=True)])
    assert sorted(windows) == [k for a, b in zip(ends[:-1], ends[1:], strict=True) for k in range(a, b - suffixes.LENGTH + 1)]
    assert ((found.place >= found.last) & (found.place + suffixes.GRAM <= found.first + suffixes.LENGTH)).all()
