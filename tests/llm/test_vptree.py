"""Vantage-point search: exact with factor one, recall with more, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolift.llm import vptree as V


def brute(points, ids, queries, query_ids, k):
    out = {}
    for q, name in zip(queries, query_ids):
        d = np.sqrt(((points - q) ** 2).sum(1))
        out[int(name)] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != name][:k]
    return out


@pytest.mark.parametrize("dim,leaf", [(2, 4), (8, 16), (64, 64)])
def test_factor_one_is_exact(dim, leaf):
    rng = np.random.default_rng(dim)
    points = np.round(rng.normal(size=(1500, dim)), 1)
    points[100:400] = points[0]  # many copies
    ids = rng.permutation(1500)
    d, i = V.walk(points, ids, points[::50], ids[::50], 10, 1.0, leaf)
    want = brute(points, ids, points[::50], ids[::50], 10)
    assert {int(q): row.tolist() for q, row in zip(ids[::50], i)} == want
    assert (np.diff(d, axis=1) >= 0).all()


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_factor_one_is_exact_on_grids(dim):
    """Many equal distances whose computed differences don't come out equal."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        points = rng.integers(0, 60, (400, dim)) / 1000 + 0.001
        ids = rng.permutation(400)
        _, i = V.walk(points, ids, points[::4], ids[::4], 5, 1.0, 4)
        assert {int(q): row.tolist() for q, row in zip(ids[::4], i)} == brute(points, ids, points[::4], ids[::4], 5)


def test_limits_keep_what_is_within():
    rng = np.random.default_rng(3)
    points, ids = rng.normal(size=(900, 5)), np.arange(900)
    full, wanted = V.walk(points, ids, points[:50], ids[:50], 10, 1.0, 8)
    d, i = V.walk(points, ids, points[:50], ids[:50], 10, 1.0, 8, limits=full[:, -1])
    assert (i == wanted).all() and (d == full).all()


@pytest.mark.parametrize("dim", [1, 3, 24])
def test_regions_lose_nothing(spark, dim):
    """Factor one over many regions, shards and blocks equals all pairs; ids repeat with other vectors."""
    rng = np.random.default_rng(dim)
    centres = 4 * rng.normal(size=(12, dim))
    points = np.round(centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, dim)), 2) + 0.005
    ids = rng.integers(0, 900, 1200)
    table = {(int(i), tuple(p.tolist())) for i, p in zip(ids, points)}
    df = spark.createDataFrame([(i, list(p)) for i, p in table] * 2, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in V.nearest(df.where("vec_id % 10 = 0"), df, k=7, relax=1.0, shard_rows=40, block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    rows = sorted(table)
    at, names = np.array([p for _, p in rows]), np.array([i for i, _ in rows])
    want = {}
    for n, (i, p) in enumerate(rows):
        if i % 10 == 0:
            d = np.sqrt(((at - np.array(p)) ** 2).sum(1))
            order = [j for j in np.lexsort((names, d)) if j != n][:7]
            want.setdefault(i, []).extend((k + 1, float(d[j]), int(names[j])) for k, j in enumerate(order))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_vectors_of_one_id_are_rows(spark):
    df = spark.createDataFrame([(1, [0.5]), (1, [1.0]), (2, [0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in V.nearest(df.where("vec_id = 2"), df).collect())
    assert got == [(2, 1, 1, 0.4), (2, 2, 1, 0.9)]


def test_relaxed_walks_skip_work_and_keep_recall():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    points = centres[rng.integers(0, 20, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    ids = np.arange(4000)
    want = brute(points, ids, points[::40], ids[::40], 10)
    _, i = V.walk(points, ids, points[::40], ids[::40], 10, V.RELAX)
    assert np.mean([len({*row.tolist()} & {*want[int(q)]}) / 10 for q, row in zip(ids[::40], i)]) >= 0.9


def test_recall_on_embeddings(spark, tables):
    rows = tables["embeddings"]
    all_rows = rows.select("vec_id", "embedding").toPandas()
    points, ids = np.stack(all_rows.embedding.values).astype(float), all_rows.vec_id.values
    asked = ids % 20 == 0
    want = brute(points, ids, points[asked], ids[asked], 10)
    for relax, least in ((1.0, 1.0), (V.RELAX, 0.9)):
        got = {}
        for r in V.nearest(rows.where("vec_id % 20 = 0"), rows, relax=relax, shard_rows=128, block_rows=8).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert np.mean([len({*got[q]} & {*want[q]}) / 10 for q in want]) >= least
        assert relax > 1 or got == want


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("x"), "dim": F.lit("x")})
    got = sorted(tuple(r) for r in V.nearest(df, df, k=10).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 7, 1.0), (2, 1, 1, 0.0), (2, 2, 7, 1.0), (7, 1, 1, 1.0), (7, 2, 2, 1.0)]
    assert V.nearest(df.limit(0), df).count() == 0 and V.nearest(df, df.limit(0)).count() == 0
