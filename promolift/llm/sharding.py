"""Hierarchical weighted hash tree: documents descend region, rack and shard
levels; at every node the child with the smallest weighted hash draw wins.

A draw is ``-ln(u) / weight`` with ``u`` from a hash of (document id, node), so
a child wins in proportion to its weight, and raising one child's weight can
only move documents from its siblings into it. Weights of a node are the sums
below it: a change of one leaf confines movement to the path above that leaf.

Everything is column expressions; the only shuffles carry ids and digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut


@dataclass(frozen=True)
class Node:
    """A tree node: a leaf has a shard number, an inner node has children."""

    name: int
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()


def inner(name: int, children) -> Node:
    children = tuple(children)
    return Node(name, sum(c.weight for c in children), None, children)


def layout(n_shards: int, racks_per_region: int = 3, shards_per_rack: int = 4,
           weights: dict[int, float] | None = None, base: int | None = None) -> Node:
    """Tree of ``n_shards`` leaves. The first ``base`` shards (all by default)
    fill racks and regions in order; every later shard is a region of its own,
    so that growing by one shard changes no weight inside an old region and
    documents move into the new shard only."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    base = n_shards if base is None else min(base, n_shards)
    weights = weights or {}

    def leaf(s: int) -> Node:
        return Node(3_000_000 + s, float(weights.get(s, 1.0)), s)

    racks = [inner(2_000_000 + i, [leaf(s) for s in range(start, min(start + shards_per_rack, base))])
             for i, start in enumerate(range(0, base, shards_per_rack))]
    regions = [inner(1_000_000 + i, racks[start:start + racks_per_region])
               for i, start in enumerate(range(0, len(racks), racks_per_region))]
    regions += [inner(1_500_000 + s, [inner(2_500_000 + s, [leaf(s)])]) for s in range(base, n_shards)]
    return inner(0, regions)


def _levels(tree: Node) -> list[list[Node]]:
    """Inner nodes by depth. All leaves lie equally deep."""
    levels, now = [], [tree]
    while now[0].children:
        levels.append(now)
        now = [c for n in now for c in n.children]
    if any(n.children for n in now):
        raise ValueError("leaves must lie equally deep")
    return levels


def place(rows: DataFrame, key: Column, tree: Node, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the shard of ``key`` in ``tree``. One
    level after the other, the children of the node reached so far draw."""
    rows = rows.withColumn(name, F.lit(0))
    for level in _levels(tree):
        at, children = {}, []
        for node in level:
            live = [(c.name, float(c.weight), c.shard) for c in node.children if c.weight > 0]
            if node.weight > 0 and not live:
                raise ValueError("a node without weight can't take documents")
            at[node.name] = live
        deeper = [c for node in level for c in node.children]
        number = {c.name: (c.shard if c.shard is not None else i) for i, c in enumerate(deeper)}
        for node in level:
            children.append(F.array(*[
                F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight"), F.lit(number[n]).alias("next"))
                for n, w, _ in at[node.name]]) if at[node.name] else F.lit(None))

        def draw(child):
            bits = F.shiftrightunsigned(F.xxhash64(key, child["node"]), 11)
            return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / child["weight"]).alias("draw"),
                            child["node"].alias("node"), child["next"].alias("next"))

        rows = rows.withColumn(name, F.array_min(F.transform(
            F.element_at(F.array(*children), F.col(name) + 1), draw))["next"])
    return rows


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes plus 8), text_crc32,
    shard, slot (0, 1, ... within the shard, by id, then size and checksum) and,
    with ``grown``, the shard in that tree.

    Null ids hash alike and share one shard; a null text has size 8 and the
    checksum of the empty text; repeated rows take a slot each; other columns of
    ``docs`` are ignored, whatever their names; an empty table gives no rows.

    Slots need a rank within shards that each hold a fixed share of all rows, so
    none is ranked in one task: rows are range-partitioned by (shard, id, row),
    numbered within each partition, and shifted by the counts of the partitions
    before.
    """
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = place(rows, F.col("doc_id"), tree, "shard")
    rows = (place(rows, F.col("doc_id"), grown, "grown_shard") if grown
            else rows.withColumn("grown_shard", F.lit(None).cast("int")))
    order = ["shard", "doc_id", "size", "text_crc32", "_row"]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .drop("_row").withColumn("_at", F.monotonically_increasing_id())
                 .withColumn("_part", F.shiftright("_at", 33)))
    inside = ranged.withColumn(
        "_n", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")))
    before = (ranged.groupBy("_part", "shard").agg(F.count("*").alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(
                  Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_rows"))
    return inside.join(before, ["_part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_before") + F.col("_n") - 1).alias("slot"), "grown_shard")
