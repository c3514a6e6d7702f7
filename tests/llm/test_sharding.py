"""Hash tree: law of growth, gapless slots, shares by weight, confined movement."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from promolift.llm import sharding as S


def xx(doc, node):
    """Spark's xxhash64 of (bigint, int)."""
    h = 42 if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", node), h)


def shard_of(doc, node):
    while node.shard is None:
        node = min((c for c in node.children if c.weight > 0),
                   key=lambda c: -math.log(((xx(doc, c.name) >> 11) + 0.5) / 2 ** 53) / c.weight)
    return node.shard


def check(rows, out, tree, grown):
    want = Counter()
    for doc, text in rows:
        data = (text or "").encode()
        want[doc, len(data) + 8, zlib.crc32(data), shard_of(doc, tree), shard_of(doc, grown)] += 1
    assert want == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equals_a_plain_descent(tables):
    docs = tables["documents"]
    tree, grown = S.layout(24), S.layout(25, base=24)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, S.assign(docs, tree, grown).collect(), tree, grown)


def test_edge_cases(edge, nothing):
    tree, grown = S.layout(24), S.layout(25, base=24)
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    check(rows, S.assign(edge, tree, grown).collect(), tree, grown)
    assert S.assign(nothing, tree).count() == 0


def test_slots_don_t_depend_on_partitions(spark, tables):
    docs = tables["documents"]
    one, many = (sorted(tuple(r) for r in S.assign(docs.repartition(n), S.layout(24)).drop("grown_shard").collect()) for n in (1, 7))
    assert one == many


def test_weights_and_confined_movement(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = S.layout(24, weights={3: 2.0})
    after = S.layout(24, weights={3: 2.0, 13: 3.0})
    out = S.assign(ids, before, after).collect()
    counts = Counter(r.shard for r in out)
    assert abs(counts[3] / 40_000 - 2 / 25) < 0.01
    region = {s: s // 12 for s in range(24)}
    moved = [r for r in out if r.shard != r.grown_shard]
    # within the region without changed weights nothing moves; into the other one only
    assert moved and all(region[r.grown_shard] == 1 for r in moved)
    assert not [r for r in out if r.shard in region and region[r.shard] == 0 and region[r.grown_shard] == 0 and r.shard != r.grown_shard]
