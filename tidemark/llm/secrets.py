"""Secret scans with corpus-wide ownership.

Spans are found by Spark's own regular expressions: splitting a text at a
pattern and extracting its matches gives both the pieces between matches and the
matches, and their lengths add up to places in code points. Hashes of the
candidates' values are then aggregated by distinct repositories and owners over
the whole corpus: a value that many owners share is a copied example, one that
a single owner has looks live. Long mixed tokens in what the base spans leave are
candidates as well, and become spans of their own (live) if one owner has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, settle

#: Fixed patterns: kind, pattern, the group that is measured, its least length. The order breaks ties of start.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A candidate beyond the base kinds: a long token with letters and digits.
LIVE = r"[A-Za-z0-9+/_-]{20,}"
#: A value with so many owners and repositories is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 3

#: A hash with more than one in so many of all spans is common.
COMMON = 1000
#: Numbers that are summed at once.
SUM_BLOCK = 256

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def with_value(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once, however often it is named, within lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sums_before(numbers: Column) -> Column:
    """For each number of an array, the sum of those before it. Sums are made within blocks and over blocks, so that a long array isn't copied for each element."""

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

    def in_blocks(numbers: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / SUM_BLOCK).cast("int")), lambda k: running(F.slice(numbers, k * SUM_BLOCK + 1, SUM_BLOCK)))

    def shifted(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda block: F.element_at(block, -1)))
        return F.zip_with(blocks, with_value(starts, lambda s: F.slice(s, 1, F.size(s) - 1)), lambda block, start: F.transform(F.slice(block, 1, F.size(block) - 1), lambda n: n + start))

    return with_value(numbers, lambda ns: F.when(F.size(ns) > 0, F.flatten(with_value(in_blocks(ns), shifted))).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """The pieces of a text: (between, match, value, fits), what lies before a match, the match, its measured group and if that fits; the last piece has no match."""
    expression = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, expression, 0).alias("match"),
        F.regexp_extract_all(text, expression, group).alias("value"),
    )
    return F.transform(
        parts,
        lambda p: F.struct(
            p["between"].alias("between"), F.coalesce(p["match"], F.lit("")).alias("match"), p["value"].alias("value"), F.coalesce(F.char_length(p["value"]) >= least, F.lit(False)).alias("fits")
        ),
    )


def _spans(parts: Column, number: int, also: Column | None = None) -> Column:
    """The fitting matches as an array of SPAN, leftmost and non-overlapping."""
    def span(part: Column, at: Column) -> Column:
        start = at + F.char_length(part["between"])
        fits = part["fits"] & part["value"].rlike("[0-9]") & part["value"].rlike("[A-Za-z]") if also is not None else part["fits"]
        made = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.char_length(part["match"])).alias("end"), part["value"].alias("value"))
        return F.when(fits, made)

    sizes = lambda ps: F.transform(ps, lambda p: F.char_length(p["between"]) + F.char_length(p["match"]))
    return with_value(parts, lambda ps: F.array_compact(F.zip_with(ps, sums_before(sizes(ps)), span))).cast(f"array<{SPAN}>")


def _blanked(parts: Column) -> Column:
    """The text with each fitting match as blanks, so that places stay."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["between"], F.when(p["fits"], F.repeat(F.lit(" "), F.char_length(p["match"]))).otherwise(p["match"]))), "")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(row, id, owner, repository, spans): base spans, and candidates beyond them; values hashed.

    Candidates are looked for in the text without the base kinds: matches of the
    first kind are blanked, then those of the next in what is left, and so on.
    """
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(f"array<{SPAN}>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        text.alias("text"),
        text.alias("left"),
        none.alias("spans"),
    )
    for number, (_, pattern, group, least) in enumerate(BASE):
        where = F.col("text").rlike(pattern)  # no kind but the first, whose left is the text, can match blanks: so left has no matches where text has none
        rows = rows.withColumn("where", where).withColumns(
            {
                "spans": F.when(F.col("where"), F.concat("spans", _spans(_matches(F.col("text"), pattern, group, least), number))).otherwise(F.col("spans")),
                "left": F.when(F.col("where"), _blanked(_matches(F.col("left"), pattern, group, least))).otherwise(F.col("left")),
            }
        )
    more = F.when(F.col("left").rlike(LIVE), _spans(_matches(F.col("left"), LIVE, 0, 20), len(BASE), F.lit(True))).otherwise(none)
    hashed = F.transform(
        F.concat("spans", more),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")),
    )
    return rows.select("row", "id", "owner", "repository", hashed.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n, owners, repositories) of every candidate value, n its spans. A repository belongs to its owner, so both counts come from two small aggregates."""
    each = found.select(F.explode("spans.hash").alias("hash"), "owner", "repository")
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row for each row of docs: (id, base, live), arrays of (start, kind, end, owners, repositories) by start and kind.

    owner is the column source and repository source and lang unless given; a
    null in either is one more owner or repository, unnamed. A null text counts
    as empty and has no spans; the work for a text grows with its length, however
    many matches it has; repeated rows each keep their spans and count
    once as owners; other columns are left out, so that none can clash; a table
    without rows gives none. Places are in code points, ends exclusive.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", owner.cast("string"), F.col("lang")) if repository is None else repository
    found = settle(candidates(docs, id_col, text_col, owner, repository))
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    owned = settle(ownership(found))
    copied = F.col("n") * COMMON > each.count()  # of fewer than COMMON hashes
    few = F.broadcast(owned.filter(copied))
    rare = each.join(few.select("hash"), "hash", "left_anti").join(owned.filter(~copied), "hash")
    known = each.join(few, "hash").unionByName(rare)
    lists = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("all"))
    base = F.filter(F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,owners:long,repositories:long>>")), lambda s: s["kind"] < len(BASE))
    live = F.filter("all", lambda s: (s["kind"] >= len(BASE)) & (s["owners"] == 1))
    return found.select("row", F.col("id").alias(id_col)).join(lists, "row", "left").select(id_col, base.alias("base"), F.coalesce(live, F.array().cast("array<struct<start:int,kind:int,end:int,owners:long,repositories:long>>")).alias("live"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(kind) for kind, *_ in BASE), F.lit("live"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    number = lambda test: F.size(F.filter("base", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    copied = lambda s: (s["owners"] >= COPIED_OWNERS) & (s["repositories"] >= COPIED_REPOSITORIES)
    return found.select(
        "doc_id",
        *(number(of_kind(k)).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "live"))).alias("spans"),
        number(copied).alias("n_copied"),
        number(lambda s: s["owners"] == 1).alias("n_owned"),
    )


def _sql_spans(number: int, pattern: str, group: int, text: str = "t") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, {number} AS kind, unnest(
    list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      'size': length(m[i]), 'value': v[i]}}), recursive := true)
  FROM (SELECT doc_id, source, lang, string_split_regex({text}, '{quoted}') AS b, regexp_extract_all({text}, '{quoted}', 0) AS m, regexp_extract_all({text}, '{quoted}', {group}) AS v
        FROM d WHERE regexp_matches({text}, '{quoted}'))"""


def _sql_blanked(text: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""(SELECT CASE WHEN len(m) = 0 THEN x ELSE
    array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(m) THEN '' WHEN length(v[i]) >= {least} THEN repeat(' ', length(m[i])) ELSE m[i] END), '') END
   FROM (SELECT x, string_split_regex(x, '{quoted}') AS b, regexp_extract_all(x, '{quoted}', 0) AS m, regexp_extract_all(x, '{quoted}', {group}) AS v FROM (SELECT {text} AS x)))"""


ORACLE = (
    "WITH d0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, coalesce(text, '') AS left0 FROM documents)"
    + "".join(f",\nd{k + 1} AS (SELECT *, {_sql_blanked(f'left{k}', pattern, group, least)} AS left{k + 1} FROM d{k})" for k, (_, pattern, group, least) in enumerate(BASE))
    + f",\nd AS (SELECT * FROM d{len(BASE)}),\nraw AS ("
    + "\nUNION ALL".join([*(_sql_spans(number, pattern, group) for number, (_, pattern, group, _) in enumerate(BASE)), _sql_spans(len(BASE), LIVE, 0, f"left{len(BASE)}")])
    + """),
apart AS (
  SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, kind, CAST("start" AS BIGINT) AS s, CAST("start" + size AS BIGINT) AS e, value FROM raw
  WHERE length(value) >= CASE kind WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END
    AND (kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')))),
own AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM apart GROUP BY value),
named AS (
  SELECT a.*, o.owners, o.repositories, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || s || ':' || e AS label
  FROM apart a JOIN own o USING (value)),
agg AS (
  SELECT doc_id,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3 OR owners = 1) AS spans,
    count(*) FILTER (kind < 3 AND owners >= 3 AND repositories >= 3) AS n_copied, count(*) FILTER (kind < 3 AND owners = 1) AS n_owned
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN agg USING (doc_id)"""
)
