"""Corpus pipeline: stages over ``documents``, each one of the library's
operators. Every stage takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs; the table before
goes once the next one is written.

Every stage keeps rows with null ids or texts, empty and very long texts
unless its own rule takes them; rows equal in id and text are one document
repeated and share its fate, ties go to the smaller id, then the smaller
content key; an empty table gives no rows, and other columns pass through
whatever their names (the last stage returns pieces instead)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promolift.llm import decontaminate, linededup, packing, simhash, toxicity
from promolift.llm.common import held_out, without
from promolift.llm.queries import tokenizer_path
from promolift.session import materialize, remove_staged


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the
    labels of documents whose crc32(doc_id as text) mod 5 is not 0. Null and
    empty texts hold no n-grams and get the model's base score."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 5, 0))
    found = toxicity.score(docs, model)
    return without(docs, found.where("predicted = 1").select(F.col("doc_id").alias("_id"), "_hash", "_bytes"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 50 words or more that an earlier document has go from the
    later one; a document that loses every line goes. n_chars follows the text.
    Null and empty texts have no lines and stay."""
    out = linededup.dedup_lines(docs).where("n_deleted = 0 OR n_deleted < n_lines")
    changed = F.col("n_deleted") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id
    (of rows with that id, the least text checksum); groups of null ids alone
    keep one too. Texts without words, null ones too, are one group."""
    found = simhash.near_duplicates(docs, shingle=3, radius=3)
    return simhash.keep_one(docs, found)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose benchmark overlap reaches the contamination rule go.
    Null and empty texts have no words and stay."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias("_id"), "_hash", "_bytes"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences.
    Null and empty texts are pieces of one token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pack", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"corpus-{name}", done)
            remove_staged(spark, done[:-1])
            done = done[-1:]
    return docs
