"""The corpus pipeline: documents in, token ids of good, distinct and uncontaminated documents out.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm import benchmark, jaccard, pieces, quality, substrings
from fathomline.llm.queries import PIECES
from fathomline.llm.storage import small_batches
from fathomline.session import settle


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _measured(substrings.remove_repeats(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _measured(benchmark.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encode_pieces(docs, PIECES, columns=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", encoded),
]

# SQL has neither the hashes of the quality rules nor the encoder; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
