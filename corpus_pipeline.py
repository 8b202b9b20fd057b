"""From raw documents to packed training bins: five stages, each written as Parquet and read again by the next.

Low-quality documents go, then exact copies, then near copies (one document of each group stays);
secrets are masked in the texts that remain, and these are packed into bins. Every stage works on all
rows that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rootweave.llm import exact_dedup, packing, quality_mil, secret_scan, simhash
from rootweave.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; those without a score (no passage) stay."""
    return quality_mil.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("secret scans", secrets), ("best-fit packing", packed)]

#: A trained classifier, fingerprints and local search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
