"""URL filters: rules first, then trust over the link graph of hosts.

Trust is a personalised PageRank that starts at hosts with allowed pages and
follows links; distrust starts at hosts with blocked pages and follows links
backwards, since who links to bad hosts is suspect. The seeds of a side add up
to 1. Both are sums of a damped series over host edges, computed in one loop
until what is still to come is negligible. A page without a rule takes its
host's verdict: block if distrust is more than LIMIT of the host's trust and
distrust together, else allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, settle

#: Fixed rules: verdict, and host with path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
#: The series ends once, on each side, all terms to come add up to less than this; the seeds add up to 1.
TOLERANCE = 1e-12
#: A host is blocked beyond this share of distrust.
LIMIT = 0.5
#: So many terms of the series are held before they are added up.
MOST_TERMS = 16
#: A host with more than one in so many of the pages is large.
LARGE_HOSTS = 1000
#: So many rules are expressions of the plan; more are joined as a table.
MOST_RULES = 100
#: A source with more than one in so many of a side's edges is a hub; its edges are dealt into PARTS.
HUBS, PARTS = 1000, 64
#: Parts into which the pages of a name are dealt for the join with rules.
SALTS = 16
#: An absolute link in a page, with its host.
LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z in lower case; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.translate(F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the host or a parent of it, and whose path begins the path; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last condition is tested first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def with_rules(seen: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds rule and ruled (its verdict) to rows of host and path, both null without a rule.

    Rules are pairs (verdict, rule), or a table of these columns of any size,
    in which a rule must be unique. The table is joined by the host and its
    parents, as many labels long as its longest name.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            named = seen.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
            allow, block = ([rule for verdict, rule in rules if verdict == kind] for kind in ("allow", "block"))
            return named.withColumn("ruled", F.when(F.col("rule").isin(allow), F.lit("allow")).when(F.col("rule").isin(block), F.lit("block")))
        rules = seen.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    table = settle(rules.select("rule", F.col("verdict").alias("ruled"), F.substring_index("rule", "/", 1).alias("name"), F.expr("substring(rule, locate('/', rule))").alias("start")))
    most = table.agg(F.max(F.size(F.split("name", r"\."))).alias("n")).first()["n"] or 0
    pairs = seen.filter("host != ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    lengths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1))))
    parents = pairs.select("host", "path", F.explode(F.transform(lengths, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("name"))
    parents = parents.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))  # all pages of com meet its rules otherwise
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = parents.join(salted, ["name", "salt"]).filter(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("size"), "rule", "ruled")).alias("best"))
    best = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))
    return seen.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, weight the share of the source's links."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src != dst AND src != '' AND dst != ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (side, src, part, dst, weight) with weights that add up to 1 for each source, and the hubs (side, src), HUBS a side at most."""
    degrees = settle(edges.groupBy("side", "src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("degree")))
    every = degrees.groupBy("side").agg(F.sum("degree").alias("every"))  # two rows
    hubs = settle(degrees.join(F.broadcast(every), "side").filter(F.col("degree") * HUBS > F.col("every")).select("side", "src"))
    marked = edges.join(F.broadcast(hubs.withColumn("hub", F.lit(True))), ["side", "src"], "left")
    parted = marked.withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(PARTS))).otherwise(0).cast("int"))
    totals = _in_parts(degrees.drop("degree"), hubs)
    return parted.join(totals, ["side", "src", "part"]).select("side", "src", "part", "dst", (F.col("n") / F.col("total")).alias("weight")), hubs


def _in_parts(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows of (side, src), with a part: those of hubs once for each of their parts."""
    marked = rows.join(F.broadcast(hubs.withColumn("hub", F.lit(True))), ["side", "src"], "left")
    return marked.withColumn("part", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("hub")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust), whose sides are scaled to add up to 1, and edges (src, dst, n).

    Each side is the sum over k of (1 - damping) damping^k times the seeds
    carried k links far: along links for trust, against them for distrust. What
    reaches a host without links ends there. The loop ends when, on each side,
    all terms to come add up to less than the tolerance (about 170 rounds on a
    graph with cycles). Every round is settled, so the plan stays short.
    """
    both = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("side", "mass")).filter("mass > 0")
    sums = lambda df: {r["side"]: r["mass"] for r in df.groupBy("side").agg(F.sum("mass").alias("mass")).collect()}
    scale = F.lit(0.0)
    for name, total in sums(both).items():
        scale = F.when(F.col("side") == name, F.lit((1 - damping) / total)).otherwise(scale)
    mass = settle(both.select("side", "host", (F.col("mass") * scale).alias("mass")))
    terms = [mass]
    links = edges.select(F.lit("trust").alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    links = settle(links)
    if not links.isEmpty():
        dealt, hubs = _dealt(links)
        dealt = settle(dealt)
        while True:
            carried = dealt.join(_in_parts(mass.withColumnRenamed("host", "src"), hubs), ["side", "src", "part"])
            mass = settle(carried.groupBy("side", F.col("dst").alias("host")).agg((F.sum(F.col("weight") * F.col("mass")) * damping).alias("mass")))
            terms.append(mass)
            if all(m * damping < tolerance * (1 - damping) for m in sums(mass).values()):
                break
            if len(terms) > MOST_TERMS:
                terms = [settle(reduce(DataFrame.unionByName, terms).groupBy("side", "host").agg(F.sum("mass").alias("mass")))]
    every = reduce(DataFrame.unionByName, terms)
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("mass"))), F.lit(0.0)).alias(name)
    return every.groupBy("host").agg(side("trust"), side("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: float = LIMIT) -> DataFrame:
    """One row for each page: (id, host, path, rule, verdict, trust, distrust).

    The longest rule that fits decides; pages without one take the verdict of
    their host. A seed's mass is the share of the host's pages that rules allow,
    or block, over the sum of these shares. A null url, or one without ://, has
    an empty host and path, and is allowed: nothing speaks against it, as for a
    host that no mass reaches. Null or empty html has no links; html of any
    length is searched in one pass. Repeated rows stay, and count as pages and
    links; other columns are left out, so that none can clash; a table without
    rows gives none.
    """
    host, path = (F.coalesce(of(F.col(url_col)), F.lit("")) for of in (host_of, path_of))
    seen = with_rules(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), rules)
    share = lambda verdict: F.avg((F.coalesce("ruled", F.lit("")) == verdict).cast("double"))
    seeds = settle(seen.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), share("allow").alias("trust"), share("block").alias("distrust")))
    scores = propagate(host_edges(pages, url_col, html_col), seeds)
    total = seeds.agg(F.sum("pages")).first()[0] or 0
    large = seeds.filter(F.col("pages") * LARGE_HOSTS > total).select("host").join(scores, "host", "left")  # so at most LARGE_HOSTS rows
    large = large.select("host", F.struct("trust", "distrust").alias("known"))
    # pages of large hosts have their scores already, those without a host have none: for the join below they get keys of their own, so that they don't meet in one task
    apart = F.concat(F.lit("/"), F.pmod(F.xxhash64(id_col, "path"), F.lit(4096)).cast("string"))
    keyed = seen.join(F.broadcast(large), "host", "left").withColumn("__key", F.when(F.col("known").isNull() & (F.col("host") != ""), F.col("host")).otherwise(apart))
    scores = scores.select(F.col("host").alias("__key"), F.struct("trust", "distrust").alias("found"))
    trust, distrust = (F.coalesce(f"known.{side}", f"found.{side}", F.lit(0.0)) for side in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > limit * (trust + distrust), F.lit("block")).otherwise(F.lit("allow")))
    return keyed.join(scores, "__key", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "pages"))
    return judged.withColumns({"trust": F.round("trust", 12), "distrust": F.round("distrust", 12)})


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    cases = "".join(
        f" WHEN (host = '{name}' OR suffix(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{name}/{rest}'" for name, _, rest in (rule.partition("/") for _, rule in ordered)
    )
    allow = ", ".join(f"'{rule}'" for verdict, rule in RULES if verdict == "allow")
    link = LINK.replace("'", "''")
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, html, coalesce({lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT page_id, html, host, path, CASE{cases} END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
s AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM v WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS d FROM v),
n AS (SELECT src, {lower.format("d")} AS dst, count(*) AS n FROM l WHERE src <> '' AND d <> '' AND src <> {lower.format("d")} GROUP BY ALL),
e AS (
  SELECT 'trust' AS side, src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM n
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM n),
p AS (SELECT sum(trust) AS trust, sum(distrust) AS distrust FROM s),
m AS (
  SELECT 0 AS k, 'trust' AS side, host, s.trust * {1 - DAMPING} / p.trust AS mass FROM s, p WHERE s.trust > 0
  UNION ALL SELECT 0, 'distrust', host, s.distrust * {1 - DAMPING} / p.distrust FROM s, p WHERE s.distrust > 0
  UNION ALL SELECT m.k + 1, e.side, e.dst, sum(e.weight * m.mass) * {DAMPING} FROM m JOIN e ON e.side = m.side AND e.src = m.host WHERE m.k < 200 GROUP BY m.k + 1, e.side, e.dst),
t AS (SELECT host, coalesce(sum(mass) FILTER (side = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (side = 'distrust'), 0) AS distrust FROM m GROUP BY host)
SELECT page_id, v.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {LIMIT} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(round(coalesce(trust, 0), 12) AS DOUBLE) AS trust, CAST(round(coalesce(distrust, 0), 12) AS DOUBLE) AS distrust
FROM v LEFT JOIN t ON v.host = t.host"""


ORACLE = _oracle()
