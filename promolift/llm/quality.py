"""Quality by positive-unlabelled learning.

Known are trusted good texts and unlabelled web text. The share of good texts
among the unlabelled is estimated from the two samples (best-bin estimate on a
first discriminator), then an additive model over binned text statistics
minimises the non-negative unbiased risk: the positive risk weighted by that
share, plus the unlabelled negative risk less the positives' part of it, which
is kept from going below zero. Bad labels are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, sigmoid_scores

SAMPLE = 4000  # positives, and unlabelled texts, that are fitted at most (about)
BINS = 16
NAMES = ("letters", "upper", "digits", "symbols", "bars", "stops", "blanks", "word_length", "repeated", "distinct",
         "top_word", "words", "line_words", "same_lines", "marked_words")


@dataclass(frozen=True)
class Model:
    edges: Any  # (statistics, BINS - 1)
    weights: Any  # (statistics, BINS)
    bias: float
    prior: float


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of ``NAMES``."""
    from collections import Counter
    from math import log

    import numpy as np

    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[128:].sum())
    letters = max(1, upper + lower + high)
    words = data.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    symbols = int(byte[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum())
    marks = sum(int(byte[c]) for c in b"!?;:\"'()")
    return [letters / n, upper / letters, int(byte[48:58].sum()) / n, symbols / m, int(byte[124]) / m,
            (int(byte[46]) + int(byte[44])) / m, int(byte[[9, 10, 13, 32]].sum()) / n, n / m, repeated / m,
            log(1 + len(counts)) / log(2 + m), max(counts.values(), default=0) / m, log(1 + len(words)),
            log(1 + m / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), marks / m]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on up to ``sample`` positives (labels of 1 where ``learn`` holds,
    least hashed ids first, and of their texts no more than that) and about as many texts of all of ``docs`` where
    ``learn`` holds, chosen by hashed text and without copies. Null ids and
    labels are left out. Without positives, or without texts, every score is
    0.5."""
    import numpy as np

    none = Model(np.zeros((len(NAMES), BINS - 1)), np.zeros((len(NAMES), BINS)), 0.0, 0.5)
    trusted = (labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).where(learn)
               .select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.where(learn).select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.count_distinct(F.xxhash64("text"))).first()[0]
    share = min(1.0, sample / max(1, total))
    web = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53)) < share
    marked = rows.join(F.broadcast(trusted), F.col("_doc") == F.col("_id"), "left").select(
        F.col("_id").isNotNull().alias("trusted"), web.alias("web"), "text").where("trusted OR web")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([statistics(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))],
                                  names=["trusted", "web", "x"])

    made = cut(marked.mapInArrow(run, "trusted boolean, web boolean, x array<double>").distinct())
    # a trusted id may be repeated with many texts: no more than the sample is fetched
    least = made.where("trusted").select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(sample)
    good = np.array(sorted(r["x"] for r in least.collect()), float)
    # copies of trusted texts count once, too
    web_x = np.array(sorted(r["x"] for r in made.where("web").select("x").distinct().collect()), float)
    if not len(good) or not len(web_x):
        return none
    edges = np.quantile(np.concatenate([good, web_x]), np.arange(1, BINS) / BINS, axis=0).T
    p, u = _binned(good, edges), _binned(web_x, edges)
    prior = estimated_prior(p, u)
    weights, bias = _risk_minimum(p, u, prior)
    return Model(edges, weights, bias, prior)


def _binned(x, edges):
    """Bin number of each statistic, offset so that all bins are distinct."""
    import numpy as np

    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") + j * (edges.shape[1] + 1)
                     for j in range(edges.shape[0])], axis=1)


def _descend(p, u, slope, steps: int, ridge: float):
    """Adam on weights of one-hot bins. ``slope(zp, zu)`` gives the derivatives
    of the risk with respect to the two samples' scores."""
    import numpy as np

    size = len(NAMES) * BINS
    w, b = np.zeros(size), 0.0
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        dp, du = slope(w[p].sum(1) + b, w[u].sum(1) + b)
        g = (np.bincount(p.ravel(), weights=np.repeat(dp, p.shape[1]), minlength=size)
             + np.bincount(u.ravel(), weights=np.repeat(du, u.shape[1]), minlength=size) + ridge * w)
        g = np.append(g, dp.sum() + du.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def estimated_prior(p, u) -> float:
    """Best-bin estimate of the positives' share among the unlabelled: the least
    ratio of the two samples' fractions above a discriminator's threshold, with
    an allowance for the samples' sizes. Thresholds come from one half of each
    sample, the discriminator from the other."""
    import numpy as np

    half_p, half_u = p[::2], u[::2]

    def slope(zp, zu):
        return (sigmoid_scores(zp) - 1) / len(zp) / 2, sigmoid_scores(zu) / len(zu) / 2

    w, b = _descend(half_p, half_u, slope, 200, 1e-3)
    zp, zu = np.sort(w[p[1::2]].sum(1) + b), np.sort(w[u[1::2]].sum(1) + b)
    if not len(zp) or not len(zu):
        return 0.5
    cuts = np.quantile(zp, np.arange(0, 100) / 100)
    above_p = 1 - np.searchsorted(zp, cuts, side="left") / len(zp)
    above_u = 1 - np.searchsorted(zu, cuts, side="left") / len(zu)
    allowance = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((above_u + allowance) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def _risk_minimum(p, u, prior: float, steps: int = 400, ridge: float = 2e-3):
    """Weights (statistics, bins) and bias of the least non-negative risk of the
    logistic loss."""
    import numpy as np

    def slope(zp, zu):
        sp, su = sigmoid_scores(zp), sigmoid_scores(zu)
        positive = prior * (sp - 1) / len(zp)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative_risk < 0:  # leave the region where the estimate is below zero
            return prior * sp / len(zp), -su / len(zu)
        return positive - prior * sp / len(zp), su / len(zu)

    w, b = _descend(p, u, slope, steps, ridge)
    return w.reshape(len(NAMES), BINS), float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from
    ``threshold`` on). Null texts score like empty ones; repeated rows get equal
    scores; other columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights, model.bias))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges, weights, bias = shared.value
        flat = weights.ravel()
        for batch in batches:
            p = np.zeros(0)
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(1)], float)
                p = sigmoid_scores(flat[_binned(x, edges)].sum(1) + bias)
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                  names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
