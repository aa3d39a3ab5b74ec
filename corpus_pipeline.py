"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.llm import decontaminate, near_dup, packing, quality, secrets
from querylume.llm.common import DOCUMENT_COLUMNS, discard, shared_dir, table
from querylume.llm.queries import word_bpe_path


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def edited(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` with n_chars of its texts."""
    return documents(after).withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts score what the bias says; repeated rows and null ids are rows like others.  Without labels of both
    kinds every text has the share of label 1 as its score.
    """
    return quality.keep_good(documents(docs), table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the smallest id (null last), then the smallest hash of the text.

    Null and empty texts are one class; of equal ids and texts one row stays.
    """
    return near_dup.keep_one(documents(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go.

    Null and empty texts stay as they are; without items nothing changes.
    """
    return edited(docs, decontaminate.decontaminate(documents(docs), table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mask.  Null texts stay null; no row goes."""
    return edited(docs, secrets.redact(documents(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences.  A null or empty text is its end id alone; an empty table gives no rows."""
    return packing.pack_documents(documents(docs), word_bpe_path())


STAGES = [
    ("quality classifier", classify),
    ("near-dedup", deduplicate),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: No SQL: the stages hold trained models, sketches and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns the last one's rows, read from its Parquet."""
    docs, last = table(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark)}/querylume-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{top}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._written_path = path  # type: ignore[attr-defined]
        discard(last)
        last = docs
    return docs
