"""Thin queries over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, hard_negatives, html_extract, lattice_lm, licenses, phrases, preference, quality, secrets, sharding, simhash, toxicity
from tessera.llm.oracles import ORACLES
from tessera.llm.words import documents

__all__ = ["ORACLES", "QUERIES"]
TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def filed(doc_id: Column, source: Column, lang: Column) -> tuple[Column, Column]:
    """Path of a document, and whether it is a licence file. Documents have no paths: the query files them four folders deep, by source,
    language, and runs of 400 and 40 ids; every eighth is a licence file, in one of the four folders above it."""
    folders = F.array(source, lang, F.concat(F.lit("d"), F.floor(doc_id / 400).cast("string")), F.concat(F.lit("e"), F.floor(doc_id / 40).cast("string")))
    is_file = doc_id % 8 == 0
    depth = F.when(is_file, F.floor(doc_id / 8) % 4 + 1).otherwise(4).cast("int")
    name = F.concat(F.when(is_file, "LICENSE-").otherwise("f"), doc_id.cast("string"))
    return F.concat_ws("/", F.slice(folders, F.lit(1), depth), name), is_file


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path, is_file = filed(docs.doc_id, docs.source, docs.lang)
    return licenses.scanned(docs, ["doc_id"], path, docs.text, is_file).withColumn("score", F.round("score", 6))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(documents(spark, sf_dir), ["doc_id"])
    base, spans = F.col("__ts_base"), F.col("__ts_spans")
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform(spans, lambda s: s[c])), F.lit(0)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"), most("n_owners").alias("most_owners"), most("n_repositories").alias("most_repositories"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(documents(spark, sf_dir), tokenizer_path(PIECES))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(documents(spark, sf_dir), tokenizer_path(TOKENIZER), keep=["doc_id"])
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    return preference.self_formatted(turns).withColumnRenamed("pair", "conv_id")


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's segments as rows of one prompt and two completions, with the learned ranges as start:stop, comma-joined."""
    rows = preference.paired(op9_preference(spark, sf_dir).withColumnRenamed("conv_id", "pair"))
    masks = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"], m["stop"])), ",").alias(c)
    return rows.select(F.col("pair").alias("conv_id"), "prompt", "chosen", "rejected", masks("chosen_masks"), masks("rejected_masks"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_digest(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "found")
    hit = F.col("found")
    return found.select("doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"), decontaminate.is_contaminated(hit).alias("contaminated"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), name="score")
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = hard_negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mined(rows, F.col("id") % 50 == 0)


QUERIES = {"op1_sharding": op1_sharding, "op2_licenses": op2_licenses, "op3_main_text": op3_main_text, "op4_secrets": op4_secrets, "op5_quality": op5_quality, "op6_simhash": op6_simhash, "op7_lattice_lm": op7_lattice_lm, "op8_bpe": op8_bpe, "op9_preference": op9_preference, "preference_pairs": preference_pairs, "op10_decontaminate": op10_decontaminate, "op11_phrases": op11_phrases, "op12_toxicity": op12_toxicity, "op13_hard_negatives": op13_hard_negatives}
