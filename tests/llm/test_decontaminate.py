"""Benchmark decontamination against a word-by-word version and DuckDB."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_data import SF, frame
from promolift.llm import decontaminate as D
from promolift.llm import oracle, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == v[a:a + n]:
                        hit.update(range(b, b + n))
                        found |= {str(item)} - {"None"}
        out.append((doc, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted(((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in rows), key=repr)


def case(spark):
    w = [f"t{i}" for i in range(60)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:18])), (3, "the the the the the the the the the the the the the the"), (4, "Short Item"),
             (5, ""), (6, None), (7, "!!!"), (8, " ".join(w[:20])), (None, " ".join(w[40:55])), (9, "one"), (9, "one")]
    docs = [(1, " ".join(w)), (2, "x " + " ".join(w[3:16]) + " y"), (3, " ".join(w[3:15])), (4, "the " * 30), (5, "a SHORT, item here"),
            (6, None), (7, ""), (8, " ".join(["z"] * 500 + w[5:18])), (9, "one"), (9, "one"), (None, "one two"), (10, " ".join(w[41:54])),
            (11, " ".join(w[:12] + ["q"] + w[12:20]))]
    return docs, items, spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))


@pytest.mark.parametrize("broadcast_rows", [1 << 18, 0])
def test_equals_word_by_word(spark, broadcast_rows):
    docs, items, bench = case(spark)
    out = D.decontaminate(frame(spark, docs, clash=True), bench, broadcast_rows=broadcast_rows)
    assert got(out) == expected(docs, items)


def test_no_python_on_the_main_path(spark):
    docs, items, bench = case(spark)
    plan = D.decontaminate(frame(spark, docs), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_positions_beyond_the_low_bits(spark, monkeypatch):
    monkeypatch.setattr(D, "PLACES", 16)
    docs, items, bench = case(spark)
    docs = [(i, ("pad " * 40 if i == 1 else "") + (t or "")) for i, t in docs]
    for broadcast_rows in (1 << 18, 0):
        assert got(D.decontaminate(frame(spark, docs), bench, broadcast_rows=broadcast_rows)) == expected(docs, items)


def test_edge_cases(spark, edge, nothing):
    docs, items, bench = case(spark)
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert got(D.decontaminate(edge, bench)) == expected(rows, items)
    assert got(D.decontaminate(edge, bench.limit(0))) == expected(rows, [])
    assert D.decontaminate(nothing, bench).count() == 0


def test_query_equals_duckdb(spark, tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracle.oracle_sql()["op5_decontaminate"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    have = sorted(tuple(r) for r in queries.op5_decontaminate(spark, SF).select(*names).collect())
    assert want == have
    assert hashlib.sha256(b"").hexdigest() in {r[names.index("items_sha256")] for r in have}
