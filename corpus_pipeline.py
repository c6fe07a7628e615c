"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark leaks go,
personal data is masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), reads all rows that its predecessor kept, and returns a
DataFrame; between stages rows are written as Parquet in the session's shared checkpoint folder and
read again, so a lost executor costs at most one stage's tasks.  Every stage but the last returns the
columns of ``documents``, and rows that it keeps keep all of them.

Edge cases: null and empty texts pass every filter (toxicity scores them like any text) and encode to
no ids; rows without a doc_id are never near duplicates and never contaminated; of repeated rows one
stays, of a group the smallest doc_id; very long texts go through whole; an empty table gives an empty
table; extra columns, whatever their names, go through all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waybill.llm import byte_bpe, decontaminate, near_dup, pii, toxicity
from waybill.llm.common import ensure_checkpoint_dir, table
from waybill.llm.queries import RANK_FILE

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR = near_dup.NearDupParams(shingle=5, percent=80, tables=10, agree=0.68)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def fold(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the smallest doc_id of each group of near duplicates stays; documents without words are no group."""
    return near_dup.keep_one(docs, NEAR)


def unleak(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data becomes its kind in angle brackets."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of ids and of the decoded bytes."""
    return byte_bpe.token_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [("toxicity", clean), ("near_dup", fold), ("decontaminate", unleak), ("pii", mask), ("byte_bpe", encode)]

#: Trained models and the rank queue have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table of ``sf_dir``.  A stage's rows go when the next one's are written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs
