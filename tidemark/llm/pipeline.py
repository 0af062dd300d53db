"""The corpus pipeline: five stages over documents, each written and read again.

Every stage works on all that its predecessor kept. Stages hand on the columns of
documents, and further columns if the input has them; the last returns a row of
token digests for each document that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, importance, linechunks, minjoin
from ._common import read_table, settle, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: the documents that importance resampling draws. Null and blank texts aren't drawn."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))  # so that no column clashes with the operator's
    return importance.resample(packed, read_table(spark, sf_dir, "labels"), keep=["__row"]).select("__row.*")


def drop_line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the chunks of lines that occur before them; documents stay, empty if nothing is left, and n_chars is counted again."""
    left = linechunks.drop_repeats(docs)
    return left.select(*(F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the lowest id stays. Of rows that repeat an id and a text one stays; rows without an id, or with null text, all stay."""
    found = minjoin.join_similar(docs.select("doc_id", "text"))
    gone = found.filter("NOT leads").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct()
    left = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (minjoin.copy_of("text") == F.col("__copy")), "left_anti")
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left.select(*docs.columns)
    named = left.filter("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.filter("doc_id IS NULL OR text IS NULL")).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark item go. A row without an id can't be named by a match, and stays."""
    found = decontamination.find_items(docs, read_table(spark, sf_dir, "benchmark"))
    gone = settle(found.filter("doc_id IS NOT NULL").select("doc_id").distinct())
    left = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return left.unionByName(docs.filter("doc_id IS NULL"))  # not all to one task


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: each document's number of tokens, and digests of its ids and of what they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_line_chunks),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenize),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written in the shared folder and read again by the next, and goes once that has been written. The last one's stays, as the rows are read from it."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}", read_table(spark, sf_dir, "documents")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            files.delete(path.suffix(f"/{number - 1}"), True)
    return docs
