"""The corpus pipeline: five stages over documents, each reading what its predecessor wrote.

Every stage but the last returns the columns of documents, so stages can be
run, kept and repeated one by one; the last returns the packed pieces.

Defined results, for a stage given any of these: null and empty texts are
rejected by the quality stage (no words) and kept by the others, a null or
empty text being packed as the end token alone; a very long text is judged,
redacted and packed as a whole; repeated rows are judged alike, and one of them
stays after near_duplicates; of tied copies the least doc_id (then text hash)
stays, null ids last; an empty table gives an empty result; other columns, with
whatever names, are kept up to the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import cut, table
from riftscan.llm.decontamination import decontaminate
from riftscan.llm.jaccard import keep_one
from riftscan.llm.packing import pack_documents
from riftscan.llm.pii import redact
from riftscan.llm.pii import train as train_pii
from riftscan.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in the text; n_chars follows the text."""
    redacted = redact(docs, train_pii(spark))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return redacted


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack_documents(docs, payload="ids_crc32").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The learned list, the trees and the tokenizer are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one returns is kept, so that the next ones don't make it again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
