import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import linkgraph

from ..oracle import compare

PAGES = [
    (1, "https://good.com/a", '<a href="https://friend.org/x">f</a> <A HREF="//Friend.ORG">f</A><a href="/home">h</a>'),
    (2, "http://friend.org/p?q#f", '<a href="http://unknown.io/1">u</a>'),
    (3, "http://unknown.io/1", None),
    (4, "http://bad.net/es/1", "<p>none</p>"),
    (5, "http://bad.net/en/1", "x"),
    (6, "http://linker.org/l", "<a href='https://bad.net/en/'>b</a><img src=https://bad.net/i.png>"),
    (7, None, '<a href="https://bad.net/">b</a>'),
    (8, "no scheme", ""),
    (9, "HTTP://WWW.Example.COM/en/x", ""),
    (10, "https://sub.example.com/en/", ""),
    (11, "https://sub.example.com/enx", ""),
    (12, "https://com", ""),
    (13, "x://notexample.com/en/", ""),
    (14, "https://Ünicode.net/fr/ä?b", ""),
    (15, "://:80/fr/", ""),
    (None, "https://good.com/a", None),
    (1, "https://good.com/a", '<a href="https://friend.org/x">f</a> <A HREF="//Friend.ORG">f</A><a href="/home">h</a>'),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "src", "dst", "trust", "mass", "side")})


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def brute_rule(host, path):
    fits = []
    for _, rule in linkgraph.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(rule)
    return max(fits, key=len, default=None)


def test_rules_and_propagation(spark):
    found = linkgraph.judge(pages(spark)).collect()
    assert len(found) == len(PAGES)
    verdicts = {rule: verdict for verdict, rule in linkgraph.RULES}
    by_id = {r.page_id: r for r in found}
    for page_id, url, _ in PAGES:
        host, path = brute_host_path(url)
        row = by_id[page_id]
        assert (row.host, row.path, row.rule) == (host, path, brute_rule(host, path)), url
        if row.rule:
            assert row.verdict == verdicts[row.rule]
    assert by_id[2].trust > by_id[3].trust > 0  # trust flows along links and fades
    assert by_id[6].distrust > 0 and by_id[6].verdict == "block"  # distrust flows against them
    assert by_id[5].verdict == "block" and by_id[8].verdict == "allow"


def solved(edges, seeds, hosts):
    """{side: mass of each host}, from the closed form of the series."""
    at = {h: k for k, h in enumerate(hosts)}
    out = {}
    for k, (side, turn) in enumerate((("trust", 1), ("distrust", -1))):
        links = np.zeros((len(hosts), len(hosts)))
        for edge in edges:
            a, b = edge[:2][::turn]
            links[at[b], at[a]] += edge[2]
        seed = np.zeros(len(hosts))
        for seeded in seeds:
            seed[at[seeded[0]]] = seeded[1 + k]
        sums = links.sum(0)
        out[side] = np.linalg.solve(np.eye(len(hosts)) - linkgraph.DAMPING * links / np.where(sums, sums, 1), (1 - linkgraph.DAMPING) * seed / max(seed.sum(), 1e-300))
    return out


def held_against(spark, edges, seeds):
    hosts = sorted({h for e in edges for h in e[:2]} | {s[0] for s in seeds})
    found = {r.host: r for r in linkgraph.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-4).collect()}
    for side, exact in solved(edges, seeds, hosts).items():
        got = [found[h][side] if h in found else 0.0 for h in hosts]
        assert np.abs(np.array(got) - exact).sum() < 2e-4


def test_mass_is_that_of_the_closed_form(spark):
    held_against(spark, [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("d", "c", 5)], [("a", 1.0, 0.0), ("c", 0.0, 0.5), ("e", 0.25, 0.0)])


def test_hubs_on_a_graph_with_hubs(spark, monkeypatch):
    """A host that links to all, one that all link to, and random links between; hubs are dealt in parts."""
    monkeypatch.setattr(linkgraph, "HUBS", 20)
    rng = np.random.default_rng(2)
    edges = {("out", f"h{k}"): 1 for k in range(400)} | {(f"h{k}", "in"): 2 for k in range(400)} | {("in", "out"): 1}
    edges |= {(f"h{a}", f"h{b}"): int(n) for a, b, n in rng.integers(1, 400, (900, 3)) if a != b}
    seeds = [(f"h{k}", float(k % 3 == 0), float(k % 50 == 1)) for k in range(400)]
    held_against(spark, [(a, b, n) for (a, b), n in edges.items()], seeds)


def test_a_host_far_from_blocked_seeds_is_blocked(spark):
    """h0 links to h1, and so on; the last is blocked."""
    n = 14
    rows = [(k, f"https://h{k}.org/", f'<a href="https://h{k + 1}.org/">x</a>') for k in range(n)] + [(n, f"https://h{n}.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in linkgraph.judge(pages, rules=(("block", f"h{n}.org/"),)).collect()}
    assert {r.verdict for r in found.values()} == {"block"}
    assert all(abs(found[k].distrust - 0.15 * 0.85 ** (n - k)) < 1e-12 for k in found)


def test_rules_as_a_table(spark, monkeypatch):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(("a", "b", "com", "net")) for _ in range(rng.randint(1, 4)))
    rules = {f"{host()}/{rng.choice(('', 'x', 'x/', 'x/y', 'en/'))}": rng.choice(("allow", "block")) for _ in range(150)}
    rules = [(verdict, rule) for rule, verdict in rules.items()]
    rows = PAGES + [(100 + k, f"http://{host()}/{rng.choice(('', 'x', 'x/', 'x/yz', 'en/1', 'z'))}", None) for k in range(300)]
    judged = lambda given: sorted((tuple(r)[:5] for r in linkgraph.judge(pages(spark, rows), given).collect()), key=str)
    table = judged(spark.createDataFrame(rules, "verdict string, rule string"))
    listed = judged(rules)
    monkeypatch.setattr(linkgraph, "MOST_RULES", len(rules))
    assert table == listed == judged(rules)
    assert len({r[3] for r in table}) > 20


def test_sql_on_pages_with_links(spark, tmp_path):
    folder = tmp_path / "linked"
    rows = [r for r in PAGES if r[0] is not None and r[0] != 14][:-1]
    pages(spark, rows).select("page_id", "url", "html").write.parquet(f"{folder}/pages.parquet")
    compare(spark, "op5_link_trust", linkgraph.op5_link_trust, linkgraph.ORACLE, folder)


def test_empty_table(spark):
    assert linkgraph.judge(pages(spark, [])).count() == 0
