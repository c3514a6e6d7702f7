"""Toxicity: a linear classifier on character n-grams whose features are scaled
by naive Bayes log-count ratios.

Features are the distinct hashed 3- and 5-grams of a text's lower-cased UTF-8
bytes. The classifier is fitted on a bounded, class-balanced sample of labelled
rows, weighted back to the class shares of all labelled rows; every text is
then scored whole on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, sigmoid_scores

BITS = 18
GRAMS = (3, 5)
SAMPLE = 1000  # labelled texts of each class that are fitted at most
SAMPLE_BYTES = 32_768  # larger texts are fitted only where a class has too few others


@dataclass(frozen=True)
class Model:
    """score = sigmoid(sum of weights / root of sum of squared ratios + bias),
    both sums over a text's distinct features."""

    weights: Any
    squares: Any
    bias: float


def featurizer():
    """A function from text to its distinct features, as unsigned numbers."""
    import numpy as np

    last = np.zeros(1 << BITS, np.uint32)

    def features(text):
        data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
        parts = [np.zeros(0, np.uint32)]
        for n in GRAMS:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h ^= data[j:j + m]
                h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
            h >>= np.uint32(32 - BITS)
            parts.append(h)
        h = np.concatenate(parts)
        order = np.arange(len(h), dtype=np.uint32)
        last[h] = order  # of equal features the last one stays
        return h[last[h] == order]

    return features


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on up to ``sample`` texts of each class: those of ``docs`` whose id
    has a label where ``learn`` (a condition on the id column) holds, with the
    least hashed ids. Texts over ``SAMPLE_BYTES`` come after all others, until
    the class's texts fill ``sample * SAMPLE_BYTES`` (a text counts for 2 **
    (``BITS`` - 1) bytes at most). Null labels, ids and texts are left out; of
    several labels of an id the largest counts; equal texts count once. Without
    both classes the model scores every text with the share of label 1 (smoothed
    towards a quarter)."""
    import numpy as np

    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(learn)
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")))
    shares = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    prior = (n1 + 0.5) / (n1 + n0 + 2)
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    if not n1 or not n0:
        return none
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("_doc"), text.alias("text"), F.xxhash64(text).alias("_hash"),
                        F.octet_length(text).alias("_bytes")).where("text IS NOT NULL")
    # one row per class and text, without the text
    able = cut(texts.select("_doc", "_hash", "_bytes").join(known, F.col("_doc") == F.col("_id"))
               .groupBy("_label", "_hash", "_bytes").agg(F.min(F.struct(F.xxhash64("_id").alias("order"), "_id")).alias("_first")))
    first = [F.col("_bytes") > SAMPLE_BYTES, F.col("_first"), F.col("_hash"), F.col("_bytes")]
    chosen = None
    for value in (0, 1):
        part = able.where(F.col("_label") == value).orderBy(*first).limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    size = F.least(F.col("_bytes"), F.lit(1 << BITS - 1)).cast("long")
    before = Window.partitionBy("_label").orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)
    chosen = (chosen.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
              .where(F.col("_before") < sample * SAMPLE_BYTES)
              .select("_label", F.col("_first._id").alias("_id"), F.col("_hash").alias("_h"), F.col("_bytes").alias("_b")))
    picked = texts.join(F.broadcast(chosen), (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_h"))
                        & (F.col("_bytes") == F.col("_b")))
    # repeated rows of a chosen id are one text
    picked = picked.groupBy("_label", "_hash", "_bytes").agg(F.first("text").alias("text")).select("_label", "text")

    def run(batches):
        import pyarrow as pa

        features = featurizer()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())],
                                  names=["label", "features"])

    # made in parallel, then fetched in eight parts: at most 2 * sample rows, 2 * SAMPLE_BYTES features a row on average
    made = picked.mapInArrow(run, "label int, features binary").repartition(8)
    rows = sorted({(r["label"], bytes(r["features"])) for r in made.toLocalIterator()})
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return none
    return _logistic([np.frombuffer(r[1], np.uint32) for r in rows], y, n1 / (n1 + n0))


def _logistic(features, y, share: float, ridge: float = 1e-4, steps: int = 60, bits: int = BITS) -> Model:
    """Accelerated gradient descent on the ridge-penalised logistic loss, over
    blocks of rows so that temporary arrays stay small."""
    import numpy as np

    size, block = 1 << bits, 64
    blocks = []
    for at in range(0, len(y), block):
        part = features[at:at + block]
        lengths = np.array([len(f) for f in part])
        blocks.append((slice(at, at + len(part)), np.concatenate(part), lengths, np.cumsum(lengths)))

    def per_row(values, ends):
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return np.diff(total[np.concatenate([[0], ends])])

    counts = np.zeros((2, size))
    for at, index, lengths, _ in blocks:
        positive = np.repeat(y[at], lengths)
        counts[1] += np.bincount(index, weights=positive, minlength=size)
        counts[0] += np.bincount(index, weights=1 - positive, minlength=size)
    ratio = np.log((counts[1] + 1) / (y.sum() + 2)) - np.log((counts[0] + 1) / (len(y) - y.sum() + 2))
    scales = [1 / np.sqrt(np.maximum(per_row(ratio[index] ** 2, ends), 1e-9)) for _, index, _, ends in blocks]
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    v, bias = np.zeros(size), float(np.log(share / (1 - share)))
    z, z_bias, t = v, bias, 1.0
    for _ in range(steps):
        scaled, slope, bias_slope = z * ratio, np.zeros(size), 0.0
        for (at, index, lengths, ends), scale in zip(blocks, scales):
            error = (sigmoid_scores(per_row(scaled[index], ends) * scale + z_bias) - y[at]) * weight[at]
            slope += np.bincount(index, weights=np.repeat(error * scale, lengths), minlength=size)
            bias_slope += error.sum()
        new, new_bias = z - 80 * (slope * ratio + ridge * z), z_bias - 2 * bias_slope
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, z_bias = new + (t - 1) / t_next * (new - v), new_bias + (t - 1) / t_next * (new_bias - bias)
        v, bias, t = new, new_bias, t_next
    return Model((v * ratio).astype(np.float32), (ratio ** 2).astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, _hash, _bytes (content key), score
    (0 to 1), predicted (1 from ``threshold`` on). A null or empty text, or one
    without features, gets the score of the bias. Repeated rows get equal
    scores, other columns are ignored, an empty table gives no rows."""
    from .common import row_key

    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.squares, model.bias))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, squares, bias = shared.value
        features = featurizer()

        def one(text):
            f = features(text)
            return weights[f].sum(dtype=float) / np.sqrt(max(squares[f].sum(dtype=float), 1e-9)) + bias

        for batch in batches:
            p = sigmoid_scores(np.array([one(t.as_py()) for t in batch.column(3)], float))
            yield pa.record_batch([*batch.columns[:3], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                  names=["doc_id", "_hash", "_bytes", "score", "predicted"])

    rows = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, _hash bigint, _bytes int, score double, predicted int")
