"""Documents to token ids in stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import bpe, decontaminate, quality, secrets, simhash
from rillspark.llm.common import forget, table, temporary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    text = F.col("clean_text")
    return quality.kept_only(docs.select(*COLUMNS)).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of op4 (3-word shingles) that differ in at most 2 bits, and
    chains of such. That is op4's definition, not a share of common shingles; README gives its recall against one."""
    return simhash.without_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids and the texts that they decode to again, with digests of both, language and source."""
    return bpe.with_ids(docs.select(*COLUMNS), extra=True, keep=("lang", "source"), held=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("token_ids", token_ids),
]

#: Fingerprints, shared spans and token ids aren't in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir. Tables that a stage's operators write go when its own is written, and
    that goes when the next one is; the last one's documents stay, as the result reads them."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            made = stage(spark, docs, sf_dir)
            kept: list[str] = []
            docs = written(made, name, kept)
        forget(spark, last)
        last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
