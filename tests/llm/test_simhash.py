"""SimHash near-duplicates against a plain all-pairs version."""

import re

import numpy as np
import xxhash

from llm_data import frame
from promolift.llm import simhash as S
from promolift.llm.graph import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, format(prints[i], "016x"), min(ids, default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in df.collect()), key=repr)


def test_equals_all_pairs_on_documents(tables):
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    assert got(S.near_duplicates(tables["documents"])) == expected(rows)


def test_edge_cases(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert got(S.near_duplicates(edge)) == expected(rows)
    assert S.near_duplicates(nothing).count() == 0


def test_split_tiles_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2 ** 62, 2 ** 62, 40)
    values = {int(b) for b in base} | {int(b ^ (1 << int(x)) ^ (1 << int(y))) for b in base for x, y in rng.integers(0, 60, (20, 2))}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for tile in (4, 1024):
        found = {(r.node, r.root) for r in components(S.links(prints, 3, tile)).collect()}
        left = sorted(values)
        group = {v: v for v in left}

        def find(x):
            while group[x] != x:
                x = group[x]
            return x

        for i, a in enumerate(left):
            for b in left[:i]:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
        linked = {v for v in left if any(find(v) == find(w) for w in left if w != v)}
        assert found == {(v, find(v)) for v in linked}


def test_forest_keeps_components():
    near = np.ones((30, 50), bool)
    i, j = S.forest(near)
    assert len(i) <= 80 and {*i} == {*range(30)} and {*j} == {*range(50)}


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and all(out[1000 + i] == 1000 for i in range(300))


def test_keep_one(spark, edge):
    kept = S.keep_one(edge, S.near_duplicates(edge))
    assert kept.columns == edge.columns
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    groups = {(fp, c) for _, fp, c in expected([tuple(r) for r in edge.select("doc_id", "text").collect()])}
    assert len(rows) == len({c for _, c in groups})
    assert [r[0] for r in rows].count(7) == 1  # of repeated rows one stays
    clean = frame(spark, [(1, "a b c d e f g"), (2, "completely other words in this one here")])
    assert S.keep_one(clean, S.near_duplicates(clean)).count() == 2
