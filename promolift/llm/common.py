"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder (``spark.checkpoint.dir``)
    and read from there: later steps re-read files when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged. ``lower`` does the same on
    texts of one-byte characters; the others go through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is ``fold`` (a null id
    counts as the text 'null')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == fold


def row_key(text_col: str = "text", id_col: str = "doc_id") -> list[Column]:
    """Columns that identify a document's content: rows that agree on all three
    are the same document repeated."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(-1)).alias("_bytes")]


def sigmoid_scores(z):
    """Logistic function of a numpy array, safe for large magnitudes."""
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process, so that
    what one task has learnt or loaded serves the next."""
    import sys
    import types

    return sys.modules.setdefault("_llm_kept", types.ModuleType("_llm_kept")).__dict__


KEY_ROWS = 200_000  # content keys that are broadcast at most


def _keyed(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    keys = F.broadcast(keys) if keys.count() <= KEY_ROWS else keys
    same = docs[id_col].eqNullSafe(keys["_id"])
    for found, name in zip(row_key(text_col, id_col)[1:], ("_hash", "_bytes")):
        same &= found == keys[name]
    return docs.join(keys, same, how)


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose content key (``row_key``) isn't in ``keys``.
    Up to ``KEY_ROWS`` keys (counted) are broadcast, more are joined by shuffle."""
    return _keyed(docs, cut(keys.distinct()), "left_anti", id_col, text_col)


def only(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose content key is in ``keys``."""
    return _keyed(docs, cut(keys.distinct()), "left_semi", id_col, text_col)
