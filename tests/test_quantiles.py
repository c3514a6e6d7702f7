"""Exact tertiles by bounded selection, against sorting."""

import math
import random

import pytest

from promolift.functions import quantiles as Q


def expected(values):
    s = sorted(values)
    m = len(s) - 1
    at = {"s0": 0, "sa": m // 3, "sb": -(-m // 3), "sc": 2 * m // 3, "sd": -(-2 * m // 3), "smax": m}
    by = {}
    for v in set(s):
        r6 = 6 * s.index(v) + 3 * s.count(v) + 3
        by[v] = "slow" if r6 <= 2 * len(s) else "medium" if r6 <= 4 * len(s) else "fast"
    top = lambda c: max((v for v, x in by.items() if x == c), default=None)
    return {k: s[i] for k, i in at.items()} | {"n": len(s), "rank_slow": top("slow"), "rank_medium": top("medium")}


def stats(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = Q.tertile_stats(df, "x").collect()[0].asDict()
    return row


def test_small_inputs_equal_sorting(spark):
    rng = random.Random(1)
    cases = [[float(i) for i in range(n)] for n in range(1, 13)]
    cases += [[rng.choice([0.0, 1.0, 2.5, 7.0]) for _ in range(rng.randint(1, 20))] for _ in range(12)]
    cases += [[rng.random() for _ in range(rng.randint(1, 50))] + [0.5] * rng.randint(0, 30) for _ in range(8)]
    for values in cases:
        got = stats(spark, [*values, None])
        want = expected(values)
        assert {k: got[k] for k in want} == want, values


@pytest.mark.parametrize("accuracy", [100, 1000])
def test_a_coarse_sketch_gives_exact_ranks_too(spark, monkeypatch, accuracy):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    monkeypatch.setattr(Q, "MARGIN", 8 / accuracy)
    rng = random.Random(accuracy)
    values = [round(rng.gauss(0, 1), 3) for _ in range(6_000)]
    got, want = stats(spark, values), expected(values)
    assert {k: got[k] for k in want} == want
    rows = Q.banded_counts(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    assert sum(r.cnt for r in rows) == len(values) and {r.n for r in rows} == {len(values)}
    assert len(rows) <= 3 + math.ceil(4.5 * 8 / accuracy * len(values))


def test_empty_and_null_values(spark):
    row = stats(spark, [None, None])
    assert row["n"] == 0 and row["sa"] is None and row["rank_slow"] is None


def test_a_broken_sketch_is_no_silent_result(spark, monkeypatch):
    monkeypatch.setattr(Q, "MARGIN", -0.2)  # bands that miss the edges
    with pytest.raises(Exception, match="outside the sketched band"):
        stats(spark, [float(i) for i in range(1000)])
