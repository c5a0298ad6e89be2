"""A training corpus from the raw documents: reject toxic ones, deduplicate, decontaminate and pack.

Each stage calls one operator on all that the stage before it kept; what is written between two stages is Parquet in the
shared folder, so a lost executor repeats one stage at most.

Every stage takes documents with null ids and texts, empty tables and repeated rows: rows are judged for toxicity one by one;
of equal texts the row with the smallest id stays, repeated rows once; of near copies the smallest id stays; a document with a
benchmark passage goes with all its rows; a null text is packed as its end id. Columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pigeonhole.llm import decontaminate, exact, minhash, packing, toxicity
from pigeonhole.llm.common import table
from pigeonhole.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs).select(COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # learned scores, banding and packing have no SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
