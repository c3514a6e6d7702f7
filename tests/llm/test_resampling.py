"""Importance resampling against plain sums."""

import hashlib
import math
import re
import zlib

import numpy as np

from llm_data import frame
from promolift.llm import resampling as R


def features(text, longest=1):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, percent=10, min_words=20, buckets=10_000, longest=1):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    split = [(i, *features(t, longest)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in split:
        for f in found:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (sum(s) + buckets) / (float(s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    rows = []
    for i, words, found in split:
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    ranks = [(r, k + 1) for k, r in enumerate(able[:len(able) * percent // 100])]
    out = []
    for r in rows:
        at = next((p for p in ranks if p[0] == r), None)
        if at:
            ranks.remove(at)
        out.append((r[0], r[2], r[3], r[4], at[1] if at else None))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(df):
    return [r[0] for r in df.select("text").collect()]


def test_equals_plain_sums(tables):
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    assert got(R.resample(tables["documents"], tables["benchmark"])) == expected(rows, texts(tables["benchmark"]))


def test_longer_runs_fewer_buckets(tables):
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    out = R.resample(tables["documents"], tables["benchmark"], percent=37, min_words=1, buckets=77, longest=3)
    assert got(out) == expected(rows, texts(tables["benchmark"]), 37, 1, 77, 3)


def test_edge_cases(edge, nothing, tables):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for percent in (0, 50, 100):
        assert got(R.resample(edge, edge, percent, 1)) == expected(rows, [t for _, t in rows], percent, 1)
    assert got(R.resample(edge, nothing, 100, 1)) == expected(rows, [], 100, 1)
    assert R.resample(nothing, tables["benchmark"]).count() == 0


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for size in (1, 63, 64, 65, 10_000):
        gain = rng.integers(-9000, 9000, size)
        for top in (2, 200, 5_000_000):
            counts = rng.integers(0, top, size)
            assert R.plane_product(counts, *R.signed_planes(gain)) == int((counts * gain).sum())
    assert R.plane_product(np.zeros(10, int), *R.signed_planes(np.zeros(10, int))) == 0


def test_draws_lean_towards_the_target(spark):
    near = [(i, "river water boat fish lake " * 6) for i in range(0, 300, 3)]
    far = [(i, "market price stock bond fund " * 6) for i in range(300) if i % 3]
    target = spark.createDataFrame([("the boat on the lake and the fish in the water of the river " * 5,)], "text string")
    drawn = [r.doc_id for r in R.resample(frame(spark, near + far), target, 20).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 60 and sum(i % 3 == 0 for i in drawn) > 40


def test_ranks_are_gapless_with_ties(spark):
    docs = frame(spark, [(i % 50, "same words in every text " * 5) for i in range(400)])
    ranks = sorted(r.rank for r in R.resample(docs, docs, 50).where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 201))
