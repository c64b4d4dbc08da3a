"""A training corpus from raw documents in five stages; each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, secrets, simhash
from tessera.llm.queries import TOKENIZER, tokenizer_path
from tessera.plans.staging import recorded, remove, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's thresholds reject go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays, that with the smallest id."""
    return simhash.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secrets.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as token ids."""
    encoded = bpe.encode_documents(docs, tokenizer_path(TOKENIZER), keep=["doc_id", "lang", "source", "n_chars"])
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_passages), ("secrets", secret_spans), ("bpe", token_ids)]
#: SQL has neither XXH64 nor this tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. When a stage's result is written, what it read and wrote on the way goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with recorded() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = staged(docs, f"stage-{name}")
        if k + 1 < len(STAGES):
            remove(spark, [*before, *made[:-1]])
            before = made[-1:]
    return docs
