import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.tables import ConcurrentCommit, VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_and_pinned_readers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.read_or_empty("k long").count() == 0
    table.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    pinned = table.read()
    table.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string"), ["k"])
    assert rows(table.read()) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(pinned) == [(1, "a"), (2, "b")] == rows(table.read(1))
    assert [h["operation"] for h in table.history()] == ["overwrite", "upsert"]
    table.register("t_view")
    assert spark.sql("SELECT count(*) FROM t_view").first()[0] == 3


def test_append_adds_columns_without_rewriting(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1,)], "k long"))
    table.append(spark.createDataFrame([(2, "x")], "k long, extra string"))
    assert rows(table.read()) == [(1, None), (2, "x")]
    with pytest.raises(TypeError, match="extra"):
        table.append(spark.createDataFrame([(3, 1.0)], "k long, extra double"))
    assert table.version() == 2


def test_upsert_refuses_ambiguous_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.overwrite(spark.createDataFrame([(1, "a")], "k long, v string"))
    with pytest.raises(merge.DuplicateKeys):
        table.upsert(spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string"), ["k"])


def test_replacement_is_null_safe(spark):
    held = spark.createDataFrame([(None, "m", 1), (1, "m", 2), (1, "n", 3)], "c long, m string, v long")
    staged = spark.createDataFrame([(None, "m", 10), (None, "m", 11)], "c long, m string, v long")
    for _ in range(3):
        held = merge.replace_keys(held, staged, ["c", "m"])
    assert rows(held) == sorted([(1, "m", 2), (1, "n", 3), (None, "m", 10), (None, "m", 11)], key=str)


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "k long")
    table.overwrite(one)
    with pytest.raises(ConcurrentCommit):
        table._commit(0, one, "late", [], one.schema)
    assert rows(table.read()) == [(1,)]


def test_published_views_have_all_columns(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.publish("shelf", "t")
    table.append(spark.createDataFrame([(1,)], "k long"))
    table.append(spark.createDataFrame([(2, "x")], "k long, extra string"))
    assert table.publish("shelf", "t") == "shelf.t"
    assert rows(spark.sql("SELECT k, extra FROM shelf.t")) == [(1, None), (2, "x")]


def test_merges_rewrite_only_the_files_they_touch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for low in (0, 10, 20):
        table.append(spark.range(low, low + 10, numPartitions=1).selectExpr("id AS k", "'old' AS v"))
    before = set(table._state(table.version())[0])
    table.upsert(spark.createDataFrame([(12, "new"), (99, "new")], "k long, v string"), ["k"])
    after = set(table._state(table.version())[0])
    assert len(before) == 3 and len(before & after) == 2
    found = dict(rows(table.read()))
    assert len(found) == 31 and {k for k, v in found.items() if v == "new"} == {12, 99}
    table.upsert(spark.createDataFrame([(100, "new", 1)], "k long, v string, w int"), ["k"])
    assert set(table._state(table.version())[0]) > after and table.read().filter("w = 1").count() == 1
    assert table.publish("shelf", "merged") and spark.sql("SELECT count(*) FROM shelf.merged").first()[0] == 32
    assert table.read(3).count() == 30


def test_a_commit_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    one, two = (spark.createDataFrame([(k,)], "k long") for k in (1, 2))
    table.overwrite(one, note={"from": "here"})

    def die(*_):
        raise SystemExit

    for step in ("_publish", "_manifest"):
        with monkeypatch.context() as patch:
            patch.setattr(VersionedTable, step, die)
            with pytest.raises(SystemExit):
                table.append(two)
        assert rows(table.read()) == [(1,)] and table.version() == 1 and table.note() == {"from": "here"}
    table.append(two)
    assert rows(table.read()) == [(1,), (2,)] and table.note() == {}


def test_staged_rows_are_settled_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.range(0, 1000, numPartitions=8).selectExpr("id AS k", "0D AS v"))
    table.upsert(spark.range(0, 400, numPartitions=4).selectExpr("cast(rand() * 1000 AS long) AS k", "rand() AS v").dropDuplicates(["k"]), ["k"])
    assert table.read().count() == 1000 == table.read().select("k").distinct().count()


def test_merges_read_only_files_whose_ranges_meet(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for low in (0, 100, 200):
        table.upsert(spark.range(low, low + 10, numPartitions=1).selectExpr("id AS k", "concat('s', id) AS s", "'old' AS v"), ["k", "s"])
    files = table._state(3)[0]

    def near(*keys):
        found = table._may_hold(3, files, spark.createDataFrame(keys, "k long, s string"), ["k", "s"])
        held = {r.f for r in table._scan(files, table.read().schema).selectExpr("k", "_metadata.file_name AS f").filter(F.col("k").isin([k for k, _ in keys])).collect()}
        assert held <= {f.rpartition("/")[2] for f in found}
        return len(found)

    assert near((50, "s50")) == 0 == near((None, "s5")) and 0 < near((105, "s105")) < near((5, "s5"), (205, "s205")) <= len(files)
    table.upsert(spark.createDataFrame([(105, "s105", "new"), (None, "n", "new"), (999, "s999", "new")], "k long, s string, v string"), ["k", "s"])
    table.replace_keys(spark.createDataFrame([(None, "n", "newer")], "k long, s string, v string"), ["k", "s"])
    assert table.read().count() == 32 and rows(table.read().filter("v != 'old'").select("k", "v")) == [(105, "new"), (999, "new"), (None, "newer")]


def test_compaction_and_vacuum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for k in range(3):
        table.append(spark.createDataFrame([(k,)], "k long"))
    table.compact()
    assert len(table._state(table.version())[0]) == 1 and table.history()[-1]["operation"] == "compact"
    spark.range(3).write.parquet(f"{table.path}/data/orphan")
    assert table.vacuum() == [] and table.read(1).count() == 1  # all too young
    gone = table.vacuum(keep=2, least_hours=0)
    assert "data/orphan" in gone and "_versions/00000002.json" in gone and len(table.history()) == 2
    assert rows(table.read(3)) == rows(table.read()) == [(0,), (1,), (2,)]
    assert len(table.vacuum(least_hours=0)) == 4 and rows(table.read()) == [(0,), (1,), (2,)]


def test_tables_of_the_catalogue(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.publish_table("shelf", "p")
    for k in range(2):  # one folder, then two
        table.append(spark.createDataFrame([(k,)], "k long"))
        assert table.publish_table("shelf", "p") == "shelf.p" and rows(spark.table("shelf.p")) == [(n,) for n in range(k + 1)]
        assert spark.catalog.getTable("shelf.p").tableType == ("MANAGED" if k else "EXTERNAL")
