"""Importance resampling towards a target distribution: documents are weighted
by the log ratio of their hashed word counts under target and corpus, and drawn
by Gumbel top-k.

Weights are exact integers from bit-sliced aggregation: a document's bucket
counts become bit planes (one bit a bucket for each power of two), as do the
buckets' gains, positive and negative ones apart. A count plane AND a gain
plane, popcounted, times the two powers of two, sums to counts times gains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BUCKETS = 10_000
CACHED = 1 << 17  # words of at most 64 bytes whose buckets a worker remembers


def _bucketer(buckets: int, longest: int):
    """text -> (buckets of its features, its number of words)."""
    import re
    import zlib

    words = re.compile(rb"[0-9a-z\x80-\xff]+")

    class Buckets(dict):
        def __missing__(self, feature: bytes) -> int:
            found = zlib.crc32(feature) % buckets
            if len(self) < CACHED and len(feature) <= 64:
                self[feature] = found
            return found

    bucket = Buckets()

    def split(text):
        found = [] if text is None else words.findall(text.encode("utf-8", "replace").lower())  # of bytes: A-Z only
        out = [bucket[w] for w in found]
        for n in range(2, longest + 1):
            out += [bucket[b" ".join(found[i:i + n])] for i in range(len(found) - n + 1)]
        return out, len(found)

    return split


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1):
    """How many features of all texts fall into each bucket (a numpy array).
    Every task adds up its own rows; ``buckets`` sums come to the driver,
    whatever the number of texts."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        split, total = _bucketer(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = split(text.as_py())[0]
                total += np.bincount(np.array(found, np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus, target):
    """Per bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in
    doubles: s, S counts of the corpus and their sum, t, T those of the target."""
    import numpy as np

    size = len(corpus)
    all_s, all_t = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_s) / (float(s + 1) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def planes(values):
    """(bit planes, powers) of non-negative integers, one value a bit position,
    as rows of 64-bit words; planes without a bit are left out."""
    import numpy as np

    top = int(values.max(initial=0))
    values = values.astype(np.uint8 if top < 256 else np.uint64)
    packed = np.zeros((top.bit_length(), -(-len(values) // 64) * 8), np.uint8)
    for b in range(len(packed)):
        row = np.packbits(values & values.dtype.type(1 << b), bitorder="little")  # any other than 0 is a set bit
        packed[b, :len(row)] = row
    kept = np.flatnonzero(packed.any(axis=1))
    return packed[kept].view(np.uint64), np.array([1 << int(b) for b in kept], object)


def signed_planes(values):
    """Planes of the positive parts, then of the negative ones, with signed powers."""
    import numpy as np

    plus, plus_powers = planes(np.maximum(values, 0))
    minus, minus_powers = planes(np.maximum(-values, 0))
    return np.concatenate([plus, minus]), np.concatenate([plus_powers, -minus_powers])


def plane_product(counts, gain_planes, gain_powers) -> int:
    """Sum of counts times gains, exactly, from their planes."""
    import numpy as np

    mine, powers = planes(counts)
    ones = np.bitwise_count(mine[:, None, :] & gain_planes).sum(axis=2, dtype=np.int64)
    return int(powers @ (ones.astype(object) @ gain_powers)) if ones.size else 0


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          target_text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, the
    floored mean gain of the text's features (runs of 1 to ``longest`` words).

    Both tables are read whole for the counts. A null, empty or wordless text
    has weight 0; repeated rows count each time and get equal weights; other
    columns are ignored; with an empty target, gains favour buckets that are
    rare in the corpus; an empty ``docs`` gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(
        signed_planes(gains(bucket_counts(docs, text_col, buckets, longest),
                            bucket_counts(target, target_text_col, buckets, longest))))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        split, (gain_planes, gain_powers) = _bucketer(buckets, longest), shared.value
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                found, words = split(text.as_py())
                total = plane_product(np.bincount(np.array(found, np.int64), minlength=buckets),
                                      gain_planes, gain_powers) if found else 0
                n_words.append(words)
                n_features.append(len(found))
                weights.append(total // len(found) if found else 0)
            yield pa.record_batch([batch.column(0), *(pa.array(v, pa.int64()) for v in (n_words, n_features, weights))],
                                  names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from the first 32 bits of
    sha256(``<seed>:<doc_id>``); a null id counts as the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score (weight
    plus Gumbel noise), rank. Of the N rows with at least ``min_words`` words the
    floor(``percent`` N / 100) with the highest scores are drawn, ranked from 1,
    ties to the smaller doc_id (a null one last); rank is null for the others.

    Scores are integers within 70,000 of 0, so the table of rows per score has
    a fixed size: it gives each score its first rank, and only rows of one score
    are ordered among each other. The noise keeps any score below one row in
    2,000."""
    scored = cut(weigh(docs, target, id_col, text_col, target_text_col, buckets, longest)
                 .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    per_score = scored.where(able).groupBy(F.col("score").alias("_score")).agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_score.select("_score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    drawn = (per_score.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
             .first()["n"]) * percent // 100
    ranked = scored.join(F.broadcast(firsts), able & (F.col("score") == F.col("_score")), "left")
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    first_in = F.col("_before") < drawn
    chosen = ranked.where(first_in).withColumn("rank", (F.col("_before") + F.row_number().over(within)).cast("bigint"))
    rest = ranked.where(~F.coalesce(first_in, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return (chosen.unionByName(rest)
            .select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))
