import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import fingerprint, label_of, max_label, rank_of, ratio
from tidemark.operators import history, marts, merge, quality, ranking, temporal
from tidemark.session import get_session
from tidemark.streaming import first_within

T0 = dt.datetime(2026, 1, 1)


def changes(spark, rows):
    return spark.createDataFrame([(i, k, s, T0 + dt.timedelta(days=d)) for i, (k, s, d) in enumerate(rows)], "id long, k long, s string, t timestamp")


def timeline(df):
    return history.build_timeline(df, "k", ["s"], "t", ["id"])


def test_timeline_of_changes_that_come_late(spark):
    """A on day 1 and again on day 3, and late B on day 2: A, B, A."""
    first, late = changes(spark, [(1, "A", 1), (1, "A", 3)]), changes(spark, [(1, "B", 2)])
    assert timeline(first).count() == 1
    found = history.affected_timelines(first, late, "k", ["s"], "t", ["id"]).orderBy("version").collect()
    assert [r.s for r in found] == ["A", "B", "A"] and [r.version for r in found] == [1, 2, 3]
    assert found[0].valid_from == dt.datetime(1970, 1, 2) and found[-1].is_current and found[-1].valid_to is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("ABC"), st.integers(0, 6)), min_size=1, max_size=25), st.integers(0, 25))
def test_timelines_don_t_overlap_and_don_t_depend_on_batches(spark, rows, cut):
    df = changes(spark, rows)
    columns = ["k", "s", "t", "version", "valid_from", "valid_to", "is_current"]
    whole = timeline(df).select(*columns)
    first, second = df.filter(F.col("id") < cut), df.filter(F.col("id") >= cut)
    fresh = history.affected_timelines(first, second, "k", ["s"], "t", ["id"])
    batched = merge.replace_keys(timeline(first), fresh, ["k"]).select(*columns)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, batched.collect()), key=str)
    by_key = {}
    for r in whole.orderBy("k", "version").collect():
        by_key.setdefault(r.k, []).append(r)
    for versions in by_key.values():
        assert [r.is_current for r in versions] == [False] * (len(versions) - 1) + [True]
        assert all(a.valid_to == b.t and a.s != b.s for a, b in zip(versions, versions[1:], strict=False))


def test_point_in_time_is_half_open_and_both_plans_agree(spark):
    versions = timeline(changes(spark, [(1, "A", 0), (1, "B", 5), (2, "C", 3)])).select("k", "valid_from", "valid_to", "s")
    facts = spark.createDataFrame([(f, k, None if d is None else T0 + dt.timedelta(days=d)) for f, k, d in [(1, 1, -100), (2, 1, 5), (3, 1, 4), (4, 2, 1), (5, 9, 1), (6, None, 1), (7, 1, None)]], "f long, k long, at timestamp")
    joined = temporal.pit_join(facts, versions, "k", "at", "v_").select("f", "v_s")
    assert dict(map(tuple, joined.collect())) == {1: "A", 2: "B", 3: "A", 4: "C", 5: None, 6: None, 7: None}
    swept = temporal.pit_join_sweep(facts, versions, "k", "at", "v_").select("f", "v_s")
    assert sorted(map(tuple, swept.collect())) == sorted(map(tuple, joined.collect()))


def test_small_dimensions_are_broadcast_and_filters_reach_the_scan(spark):
    from tidemark.plans import catalog

    plan = catalog.pit_month_mart(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    scan = catalog.scan_project_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in scan and "l_comment" not in scan


def test_timeline_shuffles_once(spark):
    plan = timeline(changes(spark, [(1, "A", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_gate_gives_all_reasons_in_order_and_passes_nulls(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, -1, ""), (3, None, "y")], "id long, v int, s string")
    rules = [quality.Rule("negative", F.col("v") >= 0), quality.Rule("blank", F.length("s") > 0)]
    gated = quality.gate(df, rules)
    assert [r.id for r in gated.valid.orderBy("id").collect()] == [1, 3]
    assert gated.rejected.first()[quality.REASONS] == "negative; blank"
    assert quality.gate(df, rules, strict=True).rejected.count() == 2
    assert quality.gate(df, []).valid.count() == 3


def test_references_and_identities(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id long, parent string")
    parents = spark.createDataFrame([("p",), ("p",), (None,)], "parent string")
    assert {r.id: r.known for r in quality.mark_known(df, parents, "parent").collect()} == {1: True, 2: None, 3: None}
    assert quality.mark_known(df, None, "parent").filter("known").count() == 0
    assert sorted(r.id for r in quality.orphans(df, parents, "parent").collect()) == [2, 3]
    people = spark.createDataFrame([(1, "c1", "x"), (2, "c1", "x"), (3, "c1", "y"), (4, None, "z"), (5, None, "w")], "id long, cpf string, who string")
    rest, shared = quality.shared_identity(people, "cpf", "who")
    assert sorted(r.id for r in shared.collect()) == [1, 2, 3] and sorted(r.id for r in rest.collect()) == [4, 5]


def test_functions(spark):
    df = spark.createDataFrame([("a", None, "b", 1.0, 0.0), ("a", "b", None, 3.0, 8.0)], "x string, y string, z string, n double, d double")
    hashes = lambda **k: {r[0] for r in df.select(fingerprint(["x", "y", "z"], **k)).collect()}
    assert len(hashes()) == 2 and len(hashes(skip_nulls=True)) == 1
    assert [r[0] for r in df.select(ratio(F.col("n"), F.col("d"), 2, 100)).collect()] == [None, 37.5]
    order = marts.SEVERITY
    labels = spark.createDataFrame([("BAIXA",), ("ALTA",), ("NONE",), (None,)], "s string")
    assert [r[0] for r in labels.select(rank_of("s", order)).collect()] == [1, 3, None, None]
    assert labels.agg(max_label("s", order)).first()[0] == "ALTA"
    assert labels.select(label_of(F.lit(4), order)).first()[0] == "CRITICA"
    assert get_session() is spark


@pytest.mark.parametrize("n,tiles", [(0, 4), (1, 4), (3, 4), (10, 4), (103, 10)])
def test_tiles_without_a_single_task(spark, monkeypatch, n, tiles):
    df = spark.createDataFrame([(k, float(k * 7 % 11)) for k in range(n)], "id long, v double")
    monkeypatch.setattr(ranking.global_positions, "__defaults__", (5,))  # several ranges for few rows
    found = {r.id: r.tile for r in ranking.with_ntile(df, "v", "id", tiles, "tile").collect()}
    df.createOrReplaceTempView("tiles")
    wanted = {r.id: r.tile for r in spark.sql(f"SELECT id, ntile({tiles}) OVER (ORDER BY v, id) AS tile FROM tiles").collect()}
    assert found == wanted


def test_late_children_and_following_months_are_affected(spark):
    day = lambda m: dt.date(2026, m, 3)
    fact = spark.createDataFrame([(1, 7, day(1)), (2, 7, day(3)), (3, 7, day(4)), (4, 8, day(1))], "id_transacao long, id_cliente_na_data long, dt_transacao date")
    touched = marts.facts_touched(fact.filter("false"), fact.filter("id_transacao = 1"), fact.filter("false"))
    assert sorted(map(tuple, marts.affected_months(fact, touched).collect())) == [(7, "2026-01"), (7, "2026-03")]


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(minutes=1)), (2, T0)], "k long, t timestamp").coalesce(1).write.parquet(path)
    stream = first_within(spark.readStream.schema("k long, t timestamp").parquet(path), ["k"], "t", "1 hour")
    stream.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]


def test_ranks_over_many_ranges_with_ties(spark, monkeypatch):
    """One value holds most rows, and so spans ranges; nulls too; ties go by a string."""
    rows = [(f"k{k:04d}", None if k % 11 == 0 else 7.5 if k % 3 else float(k % 40), ("a", "b", None)[k % 3] if k % 5 else "c") for k in range(700)]
    df = spark.createDataFrame(rows, "id string, v double, g string").repartition(6)
    df.createOrReplaceTempView("ranked_rows")
    wanted = {r.id: tuple(r) for r in spark.sql("SELECT id, row_number() OVER (ORDER BY v, id) AS p, rank() OVER (ORDER BY v) - 1 AS b, percent_rank() OVER (PARTITION BY g ORDER BY v) AS r FROM ranked_rows").collect()}
    for rows_per_range in (5, 60, 10_000):
        placed, n = ranking.global_positions(df, "v", "id", rows_per_range)
        assert n == 700 and {r.id: (r.id, r["__position"], r["__below"]) for r in placed.collect()} == {i: w[:3] for i, w in wanted.items()}
        for common in (ranking.COMMON, 2):
            monkeypatch.setattr(ranking, "COMMON", common)
            ranked = ranking.with_percent_rank(df, "g", "v", "r", rows_per_range).collect()
            assert len(ranked) == 700 and all(abs(r.r - wanted[r.id][3]) < 1e-12 for r in ranked)
    assert ranking.with_percent_rank(df.limit(0), "g", "v", "r").count() == 0 == ranking.global_positions(df.limit(0), "v", "id")[0].count()
