"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, BPE.

Each stage works on all rows that the one before has kept; all but the last return the columns of documents.  Null texts count as empty,
repeated rows as copies of each other, and a document without an id is in no group of near-duplicates, so it is never taken for a copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, decontam, near, quality, queries, secrets
from chronofold.llm.util import checkpoint_folder


def _held(docs: DataFrame) -> DataFrame:
    """Id, text and the row as it was, so that no column of an operator can clash with one of the row."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on those that are labelled, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(_held(docs), labels).where("predicted = 1").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates (five-word similarity 0.8 or more), once.

    Rows of one id are told apart by their texts: those that are no near copies of each other all stay.  Of rows with equal id and text
    the one whose columns come first stays.
    """
    kept = near.firsts(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("id"), "copy", F.col("n").alias("times"))
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), near.copy_of(F.col("text")).alias("copy"), F.struct("*").alias("row"))
    held = held.join(kept, ["id", "copy"])
    # only rows that share id and text with others have to meet
    first = held.where("times = 1").select("row").unionByName(held.where("times > 1").groupBy("id", "copy").agg(F.min("row").alias("row")).select("row")).select("row.*")
    return first.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.contamination(_held(docs), benchmark).where("not contaminated").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the secrets out of the texts."""
    clean = secrets.scan_secrets(_held(docs), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return clean.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; the text and its length give way to what comes of them, other columns stay."""
    return bpe.round_trip(docs.drop("n_chars"), queries.vocabulary()).drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL has neither the classifier nor the fingerprints' hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages hand over is written below the checkpoint folder, and removed once it has been used."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
