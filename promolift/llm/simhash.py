"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or
and bit counts. A tile holds fingerprints whose four 16-bit quarters have the
same population counts; two fingerprints within ``radius`` bits have quarter
counts that differ by ``radius`` in total at most, so all other tile pairs are
skipped without losing a link. A tile pair with more links than fingerprints
reports a spanning forest of them, which leaves the components as they are.
"""

from __future__ import annotations

from functools import partial
from itertools import product

from pyspark.sql import DataFrame, functions as F

from .common import cut, only, row_key, without
from .graph import components

TILE = 1024  # expected fingerprints of a tile at most (8 KB)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, _hash, _bytes, fp): 64-bit SimHash of every row's whole text,
    with the row's content key.

    Words are runs of characters other than ASCII white space, A-Z in lower
    case; a bit is one if set in over half of the XXH64 hashes (seed 42) of the
    word shingles, repeats included. A text of fewer words is one shingle;
    a null text or one without words has fingerprint zero.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=42)
        step = 1 << 16

        def fp(text):
            words = text.encode("utf-8", "replace").lower().split() if text else []
            if not words:
                return 0
            grams = (zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [tuple(words)])
            n = max(1, len(words) - shingle + 1)
            hashes = np.fromiter(map(digest, map(b" ".join, grams)), np.uint64, n)
            ones = np.zeros(64, np.int64)
            for at in range(0, n, step):
                part = hashes[at:at + step]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)

        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array([fp(t.as_py()) for t in batch.column(3)], pa.int64())],
                                  names=["doc_id", "_hash", "_bytes", "fp"])

    ids = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    kind = ids.schema["_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, _hash bigint, _bytes int, fp bigint")


def _signature(fp):
    """Population counts of the four 16-bit quarters as one number, base 17."""
    out = F.lit(0)
    for quarter in range(4):
        bits = F.bit_count(F.shiftrightunsigned(fp, 16 * quarter).bitwiseAND(0xFFFF))
        out = out * 17 + bits
    return out.cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that sum to ``radius`` at most, one of each
    pair of opposite differences."""
    return [d for d in product(range(-radius, radius + 1), repeat=4)
            if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct values of ``prints.fp`` that differ in
    1 to ``radius`` bits: every component of the full link graph stays
    connected."""
    distinct = prints.groupBy("fp").agg(F.count("*").alias("_rows")).select(
        "fp", _signature(F.col("fp")).alias("sig"))
    # at most 17 ** 4 signatures exist, whatever the input: small enough to broadcast
    distinct = cut(distinct)
    sizes = cut(distinct.groupBy("sig").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    tiles = cut(distinct.join(F.broadcast(sizes), "sig")
                .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
                .groupBy("sig", "chunk").agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"q{i}") for i, x in enumerate(d)]) for d in _steps(radius)])
    quarter = [F.floor(F.col("sig") / 17 ** (3 - i)) % 17 for i in range(4)]
    moved = [quarter[i] + F.col(f"d.q{i}") for i in range(4)]
    target = (((moved[0] * 17 + moved[1]) * 17 + moved[2]) * 17 + moved[3]).cast("int")
    inside = moved[0].between(0, 16) & moved[1].between(0, 16) & moved[2].between(0, 16) & moved[3].between(0, 16)
    others = (tiles.select("sig", "chunk", "fps", F.explode(steps).alias("d")).where(inside)
              .select(target.alias("to_sig"), F.col("sig").alias("other_sig"), F.col("chunk").alias("other_chunk"),
                      F.col("fps").alias("others"))
              .join(F.broadcast(sizes.select(F.col("sig").alias("to_sig"), "tiles")), "to_sig")
              .withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .where((F.col("to_sig") != F.col("other_sig")) | (F.col("to_chunk") <= F.col("other_chunk")))
              .select("to_sig", "to_chunk", "others",
                      ((F.col("to_sig") == F.col("other_sig")) & (F.col("to_chunk") == F.col("other_chunk"))).alias("same")))
    pairs = others.join(tiles.select(F.col("sig").alias("to_sig"), F.col("chunk").alias("to_chunk"), "fps"),
                        ["to_sig", "to_chunk"]).select("fps", "others", "same")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            left, right = [], []
            same = batch.column(2).to_pylist()
            mine, theirs = batch.column(0), batch.column(1)
            my_at, their_at = mine.offsets.to_numpy(), theirs.offsets.to_numpy()
            my_fps, their_fps = mine.values.to_numpy(), theirs.values.to_numpy()
            for k in range(batch.num_rows):
                a = my_fps[my_at[k]:my_at[k + 1]].view(np.uint64)
                b = their_fps[their_at[k]:their_at[k + 1]].view(np.uint64)
                near = np.empty((len(a), len(b)), bool)
                for at in range(0, len(a), 256):
                    near[at:at + 256] = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= radius
                if same[k]:
                    near = np.triu(near, 1)
                i, j = forest(near)
                if len(i):
                    left.append(a[i].view(np.int64))
                    right.append(b[j].view(np.int64))
            if left:
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def forest(near):
    """Indices (i, j) of the true cells of a matrix, or of a spanning forest of
    its row-column graph if there are more cells than rows and columns."""
    import numpy as np

    i, j = np.nonzero(near)
    if len(i) <= near.shape[0] + near.shape[1]:
        return i, j
    rows, cols, out_i, out_j = near.any(1), near.any(0), [], []
    while rows.any():
        front = np.array([rows.argmax()])
        rows[front] = False
        while len(front):
            ahead = near[front] & cols
            new = np.flatnonzero(ahead.any(0))
            out_i.append(front[ahead[:, new].argmax(0)])
            out_j.append(new)
            cols[new] = False
            back = near[:, new] & rows[:, None]
            front = np.flatnonzero(back.any(1))
            out_i.append(front)
            out_j.append(new[back[front].argmax(1)] if len(new) else new)
            rows[front] = False
    return np.concatenate(out_i), np.concatenate(out_j)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the content key (_hash, _bytes), fp,
    root (a fingerprint that stands for the component) and component_id (the
    least id reachable over links of at most ``radius`` differing bits, itself
    included).

    Null and empty texts have fingerprint zero and link like any other; rows
    with equal fingerprints always share a component; null ids are never the
    least unless a component has no other; other columns are ignored; an empty
    table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    roots = components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = cut(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = rooted.select("fp", "root").join(best, "root")
    return prints.join(owner, "fp").select("doc_id", "_hash", "_bytes", "fp", "root", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``found`` (from
    ``near_duplicates`` on the same rows): the one of the least id, nulls last;
    of equal ids the least content key; of equal rows any one."""
    found = cut(found.select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("_id"),
                                              "_hash", "_bytes").alias("key")))
    best = found.groupBy("root").agg(F.min("key").alias("best"))
    marked = found.join(best, "root").select("key", (F.col("key") == F.col("best")).alias("first"))
    keys = cut(marked.groupBy("key", "first").agg(F.count("*").alias("rows")))
    kept = without(docs, keys.where(~F.col("first")).select("key._id", "key._hash", "key._bytes"), id_col, text_col)
    again = keys.where("first AND rows > 1").select("key._id", "key._hash", "key._bytes")
    if again.isEmpty():
        return kept
    repeated = only(docs, again, id_col, text_col)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy(*row_key(text_col, id_col)).agg(F.first(whole).alias("row")).select("row.*")
    return without(kept, again, id_col, text_col).unionByName(one)
