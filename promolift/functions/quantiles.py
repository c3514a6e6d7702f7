"""Exact tertile edges from order statistics.

With linear interpolation the q-quantile of n sorted values s_0..s_{n-1} lies
at position P = (n-1) q, between s_floor(P) and s_ceil(P), and no data value
lies strictly between those two. So for tertiles:

* v <= q(1/3)  <=>  v <= s_a,   a = floor((n-1)/3)
* v <= q(2/3)  <=>  v <= s_c,   c = floor(2(n-1)/3)
* v >= q(2/3)  <=>  v >= s_d,   d = ceil(2(n-1)/3)

and edge equalities reduce to equalities of order statistics. All decisions
are integer rank arithmetic, independent of float rounding.

They are selected in two passes, without sorting the values or writing them
out: a sketch bounds a narrow band around each tertile edge; then one aggregate
counts exactly, the values inside a band one by one and those outside in three
parts, each with its count, least and greatest value. Ranks that the counts
don't decide (the sketch would have to break its error bound) raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

ACCURACY = 100_000   # a sketched rank is off by at most n / ACCURACY
MARGIN = 8 / ACCURACY   # half width of a band, as a share of the rows


def banded_counts(df: DataFrame, value: str) -> DataFrame:
    """(part, low, high, cnt, cum_before, n) of the non-null values, in order:
    parts 1 and 3 are the bands around the first and second tertile edge, one
    row per distinct value; parts 0, 2 and 4 one row each at most. A band's rows
    are summed in order in one task: about 2 * ``MARGIN`` of the values, apart
    from ties at its ends (one row each)."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    edges = [1 / 3 - MARGIN, 1 / 3 + MARGIN, 2 / 3 - MARGIN, 2 / 3 + MARGIN]
    bounds = rows.agg(F.percentile_approx("v", edges, ACCURACY).alias("b")).select("b").scalar()
    v, b = F.col("v"), F.col("_bounds")
    part = (F.when(v < b[0], 0).when(v <= b[1], 1).when(v < b[2], 2).when(v <= b[3], 3).otherwise(4))
    marked = rows.withColumn("_bounds", bounds).select("v", part.alias("part"))
    counts = marked.groupBy("part", F.when(F.col("part") % 2 == 1, v).alias("at")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = as_scalar(counts.agg(*[F.coalesce(F.sum(F.when(F.col("part") == k, F.col("cnt"))), F.lit(0)).alias(f"p{k}")
                                    for k in range(5)]))
    marked = counts.withColumn("_totals", totals)
    size = [F.col("_totals")[f"p{k}"] for k in range(5)]
    inside = Window.partitionBy("part").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sum((F.when(F.col("part") > k, size[k]).otherwise(F.lit(0)) for k in range(4)), F.lit(0))
    return marked.select("part", "low", "high", "cnt",
                         (earlier + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).cast(T.LongType()).alias("cum_before"),
                         sum(size, F.lit(0)).cast(T.LongType()).alias("n"))


def _undecided(kind: str) -> Column:
    return F.raise_error(F.lit("tertiles: a rank lies outside the sketched band")).cast(kind)


def _value_at(rank: Column) -> Column:
    """The value of a 0-based rank."""
    first, last = F.col("cum_before"), F.col("cum_before") + F.col("cnt") - 1
    value = (F.when(rank == first, F.col("low")).when((rank == last) | (F.col("low") == F.col("high")), F.col("high"))
             .otherwise(_undecided("double")))
    return F.max(F.when((rank >= first) & (rank <= last), value))


def rank_tertile(cum_before: Column, cnt: Column, n: Column) -> Column:
    """Rank-fallback class of a value with ``cnt`` ties after ``cum_before``
    smaller values among n: average rank r = cum_before + (cnt + 1) / 2, compared
    with n/3 and 2n/3 in exact integer arithmetic (6r = 6cb + 3cnt + 3)."""
    six_r = 6 * cum_before + 3 * cnt + 3
    return (F.when(six_r <= 2 * n, F.lit("slow"))
            .when(six_r <= 4 * n, F.lit("medium"))
            .otherwise(F.lit("fast")))


def _rank_class() -> Column:
    """``rank_tertile`` of a row of ``banded_counts``. A row of several values
    has one class if its first and its last rank, taken alone, agree."""
    cb, cnt, n = F.col("cum_before"), F.col("cnt"), F.col("n")
    first, last = rank_tertile(cb, F.lit(1), n), rank_tertile(cb + cnt - 1, F.lit(1), n)
    return (F.when(F.col("low") == F.col("high"), rank_tertile(cb, cnt, n)).when(first == last, first)
            .otherwise(_undecided("string")))


def tertile_stats(df: DataFrame, value: str) -> DataFrame:
    """One row over the non-null values: n, the order statistics s0, sa, sb, sc,
    sd, smax (a, b = floor/ceil of (n-1)/3; c, d = floor/ceil of 2(n-1)/3), the
    greatest values that the rank method calls slow and medium, plus the
    interpolated quantiles q1, q2 for reporting."""
    counts = banded_counts(df, value).withColumn("rank_class", _rank_class())
    # every row carries the total n, so ranks are row expressions
    m = F.col("n") - 1
    a, b = F.floor(m / 3), F.ceil(m / 3)
    c, d = F.floor(2 * m / 3), F.ceil(2 * m / 3)
    stats = counts.agg(
        F.coalesce(F.max("n"), F.lit(0)).cast(T.LongType()).alias("n"),
        F.min("low").alias("s0"),
        _value_at(a).alias("sa"),
        _value_at(b).alias("sb"),
        _value_at(c).alias("sc"),
        _value_at(d).alias("sd"),
        F.max("high").alias("smax"),
        F.max(F.when(F.col("rank_class") == "slow", F.col("high"))).alias("rank_slow"),
        F.max(F.when(F.col("rank_class") == "medium", F.col("high"))).alias("rank_medium"),
    )
    p1 = (F.col("n") - 1).cast(T.DoubleType()) / F.lit(3.0)
    p2 = (F.col("n") - 1).cast(T.DoubleType()) * F.lit(2.0) / F.lit(3.0)
    q1 = F.col("sa") + (F.col("sb") - F.col("sa")) * (p1 - F.floor(p1))
    q2 = F.col("sc") + (F.col("sd") - F.col("sc")) * (p2 - F.floor(p2))
    return stats.select("*", q1.alias("q1"), q2.alias("q2"))


def edges_repeated(stats: Column) -> Column:
    """True when the four tertile edges (min, q1, q2, max) are not distinct."""
    return ((stats["sb"] == stats["s0"]) | (stats["sa"] == stats["sd"])
            | (stats["sc"] == stats["smax"]))


def as_scalar(stats: DataFrame) -> Column:
    """The one-row stats as a struct scalar subquery (computed once, inlined)."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()
