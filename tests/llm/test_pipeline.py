import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, importance, queries

from ..oracle import DATA, compare
from . import awkward
from .test_decontamination import dec
from .test_importance import plainly
from .test_linechunks import brute as brute_lines
from .test_minjoin import brute as brute_groups


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], DATA / "sf0.001")


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's decisions on its own input."""
    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [dec.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "quality classifier":
            good = [labels[i] for i in gone if i in labels]
            assert sum(good) <= 0.02 * len(good) + 1 and good.count(0) > 0.8 * list(labels.values()).count(0)
            assert all(after[i] == before[i] for i in after)
            noises = {r[0]: r[1] for r in docs.select("doc_id", importance.noise("doc_id", importance.SEED)).collect()}
            marks = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(importance.SEED))).collect()}
            assert set(after) == plainly({i: r.text for i, r in before.items()}, labels, noises, None, marks)
        elif name == "line dedup":
            assert not gone and any(after[i].text != before[i].text for i in after)
            wanted = brute_lines([(i, r.text) for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: left for i, (left, _, _) in wanted.items()}
            assert all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != before[i].text)
        elif name == "n-gram Jaccard join":
            groups = brute_groups([(r.doc_id, r.text) for r in before.values()])
            assert gone == {i for i, (c, _) in groups.items() if c != i}
        elif name == "benchmark decontamination":
            leaked = {i for i, r in before.items() if any(t in dec.normal(r.text) for t in items)}
            assert leaked and gone == leaked
        else:
            assert not gone and all(r.n_tokens > 0 or not before[r.doc_id].text for r in after.values())
            codec = library()
            for i, r in before.items():
                raw = (r.text or "").encode()
                ids = codec.encode_ordinary(r.text or "")
                packed = b"".join(x.to_bytes(4, "little") for x in ids)
                found = after[i]
                assert (found.n_tokens, found.ids_sha256, found.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest())
        docs = out
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_awkward_tables_run_through(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for name, rows in (("full", None), ("none", [])):
        folder = awkward.write(spark, tmp_path / name, awkward.frame(spark, rows), labels=labels, benchmark=items)
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (found.count() > 0) == (rows is None)


