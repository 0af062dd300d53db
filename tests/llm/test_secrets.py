import hashlib
import re
from collections import defaultdict

from tidemark.llm import secrets

from . import awkward

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    """Matches first, conditions afterwards."""
    return sorted((m.start(), k, m.end(), m[group]) for k, (_, pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(text) if len(m[group]) >= least)


def brute(docs):
    found = []
    for doc_id, text, lang, source, *_ in docs:
        base = base_spans(text or "")
        left = text or ""
        for _, pattern, group, least in PATTERNS:
            left = pattern.sub(lambda m: " " * len(m[0]) if len(m[group]) >= least else m[0], left)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(secrets.LIVE, left) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        found.append((doc_id, source or "", base, more))
    owners = defaultdict(set)
    for _, owner, base, more in found:
        for span in (*base, *more):
            owners[span[3]].add(owner)
    label = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'live')[k]}:{a}:{b}" for a, k, b, _ in spans)
    for doc_id, _, base, more in found:
        live = [m for m in more if len(owners[m[3]]) == 1]
        yield doc_id, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(label(base).encode()).hexdigest(), label(sorted([*base, *live]))


def test_awkward_documents(spark, tmp_path):
    rows = awkward.documents()
    rng_text = "token: abcde password=secret=abcdef AKIAKIA AKIA" + "Z" * 30 + " live_Ab3" + "x9Y" * 8 + " deadbeef" * 2 + "f" * 40
    rows += [(30, rng_text, "en", "z", 1), (31, "😀 é " + rng_text + " paſſword=abcdefgh", "en", "z", 1), (32, "password=token: abcdefgh " * 50, "en", "z", 1), (33, "secret=abcdef1 AKIA" + "A1" * 9 + " live_Ab3x9Yzz00qq11 " * 3000, "en", "y", 1)]
    folder = awkward.write(spark, tmp_path, awkward.frame(spark, rows))
    found = secrets.op3_secret_ownership(spark, folder).collect()
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in found]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert any("live" in r.spans for r in found)


def test_many_matches_and_copied_values(spark, tmp_path, monkeypatch):
    """A text of 2 MB with 80,000 matches, and a value that most rows share, with and without the broadcast of common ones."""
    import time

    dense = "".join(f"token=abc{k:06d} Zx9{k:017d}k " for k in range(40_000))
    rows = [(k, "password=sharedvalue1 own" + f"{k:020d}", "en", f"s{k % 5}", 1) for k in range(300)] + [(999, dense, "en", "dense", len(dense))]
    folder = awkward.write(spark, tmp_path, awkward.frame(spark, rows))
    wanted = sorted(brute(rows), key=str)
    for common in (secrets.COMMON, 1):
        monkeypatch.setattr(secrets, "COMMON", common)
        began = time.time()
        found = secrets.op3_secret_ownership(spark, folder).collect()
        assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in found), key=str) == wanted
        assert time.time() - began < 60


def test_empty_table(spark):
    assert secrets.scan_secrets(awkward.frame(spark, [])).count() == 0
