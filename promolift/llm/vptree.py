"""Approximate nearest neighbours with vantage-point trees, one per shard.

Rows lie in the region of their nearest pivot (a bounded sample of the rows);
large regions are split into shards of bounded size. A query first searches the
region of its nearest pivot, then every region that the triangle inequality, by
the region's radius and the distance of the k-th nearest so far, doesn't rule
out; only queries are copied for that. Inside a shard a tree is grown and walked
by a whole block of queries at once, and a subtree is skipped by the same bound.
The bounds are multiplied by ``relax``: 1 is exact search, larger values skip more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

SHARD_ROWS = 4096
BLOCK_ROWS = 8192
PIVOTS = 256  # regions at most; beyond that they have more shards each
LEAF = 64
RELAX = 1.25


def margin(length: int, *distances):
    """More than rounding can add to a difference of distances between vectors of this length."""
    import numpy as np

    return (length + 16) * np.finfo(float).eps * sum(distances)


def walk(points, ids, queries, query_ids, k: int, relax: float = RELAX, leaf: int = LEAF, keys=None, query_keys=None,
         limits=None):
    """(distances, ids) of each query's ``k`` nearest among ``points`` in double
    precision, nearest first, ties to the smaller id, a query's own row (equal
    key; keys are the ids unless given) left out; missing ones are inf. Points
    farther than a query's limit may be missing. Nodes are split as the walk
    reaches them, once for all queries that do."""
    import numpy as np

    keys, query_keys = ids if keys is None else keys, query_ids if query_keys is None else query_keys
    limits = np.full(len(queries), np.inf) if limits is None else limits
    none = np.iinfo(np.int64).max
    best_d = np.full((len(queries), k), np.inf)
    best_i = np.full((len(queries), k), none)

    def distances(a, b):
        out = np.empty((len(a), len(b)))
        step = max(1, 1_000_000 // max(1, len(b) * a.shape[1]))
        for at in range(0, len(a), step):
            gap = a[at:at + step, None, :] - b[None, :, :]
            out[at:at + step] = np.sqrt((gap * gap).sum(2))
        return out

    def offer(q, rows):
        d = distances(queries[q], points[rows])
        own = query_keys[q][:, None] == keys[rows][None, :]
        all_d = np.concatenate([best_d[q], np.where(own, np.inf, d)], axis=1)
        all_i = np.concatenate([best_i[q], np.where(own, none, ids[rows][None, :])], axis=1)
        pick = np.lexsort((all_i, all_d), axis=1)[:, :k]
        best_d[q], best_i[q] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_i, pick, 1)
        return d

    def visit(q, rows):
        if len(rows) <= leaf:
            offer(q, rows)
            return
        spread = distances(points[rows[:1]], points[rows])[0]
        if spread.max() == 0:  # one vector many times: nothing to split
            for at in range(0, len(rows), 1024):
                offer(q, rows[at:at + 1024])
            return
        vantage = rows[spread.argmax():][:1]
        rest = rows[rows != vantage[0]]
        d = distances(points[vantage], points[rest])[0]
        radius = np.median(d)
        inside = d <= radius if (d > radius).any() else d < radius
        to_vantage = offer(q, vantage)[:, 0]
        sides = [(rest[s], d[s].min(), d[s].max()) for s in (inside, ~inside) if s.any()]
        nearer = to_vantage <= radius
        for own_side in (True, False):  # first the side a query lies on, then the other
            for i, (part, low, high) in enumerate(sides):
                here = nearer == (i == 0)
                here = np.flatnonzero(here == own_side)
                apart = np.maximum(low - to_vantage[here], to_vantage[here] - high)
                apart = apart - margin(points.shape[1], high, to_vantage[here])
                here = here[relax * apart <= np.minimum(best_d[q[here], -1], limits[q[here]])]
                if len(here):
                    visit(q[here], part)

    if len(points) and len(queries):
        visit(np.arange(len(queries)), np.arange(len(points)))
    return best_d, best_i


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, relax: float = RELAX, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest rows by
    Euclidean distance, nearest first, ties to the smaller id; all candidates
    where there are fewer. Every row is a candidate but the query's own.

    Null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part, as query or candidate; vectors are compared with
    those of equal length only; rows that agree in id and vector are one row,
    rows with an id and different vectors are rows, and queries, of their own;
    other columns are ignored; an empty table gives no rows.
    """

    def valid(df):
        v = F.col(vector_col)
        good = (F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                & F.exists(v, lambda x: x != 0))
        vector = F.transform(v.cast("array<double>"), lambda x: x + 0.0)  # no negative zeros: equal vectors, equal keys
        return (df.where(good).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
                .select("id", "v", F.size("v").alias("dim"), F.xxhash64("id", "v").alias("key")).dropDuplicates(["id", "key"]))

    spark = rows.sparkSession
    known = cut(valid(rows))
    n_pivots = min(PIVOTS, -(-known.count() // shard_rows))
    # PIVOTS vectors at most, and one per region of sizes and radii, come to the driver
    pivots: dict[int, list] = {}
    for r in known.orderBy(F.xxhash64("key"), "key").limit(n_pivots).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    shared = spark.sparkContext.broadcast(pivots)

    def to_pivots(batch):
        """Per length of vector: its rows in the batch, the vectors, their distances to the pivots."""
        import numpy as np

        lengths = batch.column("dim").to_numpy()
        vectors = batch.column("v")
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            v = vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
            centres = np.array(shared.value.get(int(dim), []), float).reshape(-1, dim)
            gaps = np.empty((len(at), len(centres)))
            for c, centre in enumerate(centres):
                gaps[:, c] = np.sqrt(((v - centre) ** 2).sum(1))
            yield int(dim), at, gaps

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            region, apart = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for _, at, gaps in to_pivots(batch):
                if gaps.shape[1]:  # a length without a pivot is one region that every query of that length visits
                    region[at], apart[at] = gaps.argmin(1), gaps.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(apart)],
                                             names=["id", "v", "dim", "key", "region", "apart"])

    kept = cut(known.mapInArrow(assign, "id bigint, v array<double>, dim int, key bigint, region int, apart double"))
    sizes = {(r["dim"], r["region"]): (r["n"], r["radius"]) for r in
             kept.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}
    regions = spark.sparkContext.broadcast(sizes)

    def route(first: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            held = regions.value
            for batch in batches:
                rows_of, region_of = [], []
                limits = None if first else batch.column("bound").to_numpy()
                for dim, at, gaps in to_pivots(batch):
                    there = np.array([(dim, c) in held for c in range(gaps.shape[1])], bool)
                    radii = np.array([held.get((dim, c), (0, 0.0))[1] for c in range(gaps.shape[1])])
                    if there.any():
                        home = np.where(there, gaps, np.inf).argmin(1)
                        if first:
                            rows_of.append(at)
                            region_of.append(home)
                        else:
                            near = relax * (gaps - radii - margin(dim, gaps, radii)) <= limits[at][:, None]
                            near &= there
                            near[np.arange(len(at)), home] = False
                            q, c = np.nonzero(near)
                            rows_of.append(at[q])
                            region_of.append(c)
                    if first and (dim, -1) in held:
                        rows_of.append(at)
                        region_of.append(np.full(len(at), -1))
                taken = pa.array(np.concatenate(rows_of) if rows_of else np.zeros(0, np.int64))
                part = batch.take(taken)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "v", "dim", "key", "bound")),
                     pa.array(np.concatenate(region_of).astype(np.int32) if region_of else np.zeros(0, np.int32))],
                    names=["id", "v", "dim", "key", "bound", "region"])

        return run

    def run(mine, theirs):
        import numpy as np
        import pyarrow as pa

        def arrays(t):
            t = t.sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()
            if not t.num_rows:
                return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64), t
            v = t.column("v").combine_chunks()
            flat = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(t.num_rows, -1), t.column("id").to_numpy(), t.column("key").to_numpy(), t

        points, ids, keys, _ = arrays(mine)
        wanted, names, query_keys, t = arrays(theirs)
        d, i = walk(points, ids, wanted, names, k, relax, LEAF, keys, query_keys, t.column("bound").to_numpy())
        q, at = np.nonzero(np.isfinite(d))
        return pa.table({"query_id": names[q], "query_key": query_keys[q], "vec_id": i[q, at], "score": d[q, at]})

    found_columns = "query_id bigint, query_key bigint, vec_id bigint, score double"
    best = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")

    def top(found):
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(asked, first):
        """The ``k`` nearest of each query in the regions it is sent to."""
        sent = cut(asked.mapInArrow(route(first), "id bigint, v array<double>, dim int, key bigint, bound double, region int"))
        visits = {(r["dim"], r["region"]): r["n"] for r in sent.groupBy("dim", "region").agg(F.count("*").alias("n")).collect()}
        plan = [(*at, -(-sizes[at][0] // shard_rows), -(-n // block_rows)) for at, n in visits.items()]
        layout = F.broadcast(spark.createDataFrame(plan, "dim int, region int, shards int, blocks int"))

        def spread(df, own, n_own, other, n_other):
            """Every row in its own part (by hash) of its region, against all parts of the other side."""
            return (df.join(layout, ["dim", "region"])
                    .withColumn(own, F.pmod(F.xxhash64("key"), F.col(n_own)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))))

        here = spread(kept.drop("apart"), "shard", "shards", "block", "blocks").select("id", "v", "key", "dim", "region", "shard", "block")
        there = spread(sent, "block", "blocks", "shard", "shards").select("id", "v", "key", "bound", "dim", "region", "shard", "block")
        at = ["dim", "region", "shard", "block"]
        return top(here.groupBy(*at).cogroup(there.groupBy(*at)).applyInArrow(run, found_columns)).drop("rank")

    asked = cut(valid(queries).withColumn("bound", F.lit(float("inf"))))
    near = cut(search(asked, True))
    full = near.groupBy(F.col("query_id").alias("id"), F.col("query_key").alias("key")).agg(
        F.when(F.count("*") >= k, F.max("score")).alias("kth"))
    bounded = asked.join(full, ["id", "key"], "left").select(
        "id", "v", "dim", "key", F.coalesce("kth", F.col("bound")).alias("bound"))
    return top(reduce(DataFrame.unionByName, [near, search(bounded, False)])).select("query_id", "rank", "vec_id", "score")
