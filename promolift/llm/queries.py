"""Registered queries of this subpackage: each applies its operator to the
whole tables of ``sf_dir`` and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, language, licenses, linededup, packing, quality, resampling, sharding, simhash, sitetree,
               spelling, toxicity, vptree)
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = language.learn(docs, ~held_out(F.col("doc_id"), 5, 0))
    out = language.identify(docs, known)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "accepted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    out = quality.score(docs, model, threshold=0.7)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_deleted", "owners")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows.where(F.col("vec_id") % 100 == 0), rows, k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    out = toxicity.score(docs, model, threshold=0.5)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_table(spark, sf_dir, "documents"), sharding.layout(24), sharding.layout(25, base=24))
    return out.withColumn("law", F.lit("key"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), min_letters=7, min_count=2, drop_every=31)
    return spelling.group_variants(words, ratio=10)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                               percent=10, min_words=20, seed=2024, buckets=10_000, longest=1)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_language, op2_quality, op3_license, op4_line_dedup, op5_decontaminate, op6_pack, op7_nearest, op8_toxicity,
        op9_shard, op10_simhash, op11_spelling, op12_resample, op13_html)}
