"""Toxicity, quality and language: held-out accuracy, no leaks, edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import frame
from promolift.llm import language, quality, queries, toxicity
from promolift.llm.common import held_out

BIG = os.environ.get("PROMOLIFT_LLM_SF", "/root/testdata/sf0.1")
needs_big = pytest.mark.skipif(not os.path.exists(BIG), reason="test tables not present")


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@needs_big
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    p = queries.op8_toxicity(spark, BIG).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(p.score.values, p.toxic.values) > 0.93
    assert p.predicted[p.toxic == 0].mean() < 0.01
    assert (p.predicted == p.toxic).mean() > 0.93
    assert ((p.score >= 0.5) == (p.predicted == 1)).all()


@needs_big
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    p = queries.op2_quality(spark, BIG).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(p.score.values, p.quality.values) > 0.97
    assert p.predicted[p.quality == 1].mean() > 0.97 and p.predicted[p.quality == 0].mean() < 0.15
    assert ((p.score >= 0.7) == (p.predicted == 1)).all()


@needs_big
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    p = queries.op1_language(spark, BIG).join(docs, "doc_id").where("held_out").toPandas()
    right = p.lang_pred == p.lang
    assert right.mean() > 0.97 and right[p.accepted].mean() > 0.99


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    flipped = labels.select("doc_id", *[F.when(held_out(F.col("doc_id"), k, f), 1 - F.col(c)).otherwise(F.col(c)).alias(c)
                                        for c, k, f in (("toxic", 5, 0), ("quality", 4, 2))])
    a, b = (toxicity.fit(docs, x, ~held_out(F.col("doc_id"), 5, 0)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    a, b = (quality.fit(docs, x, ~held_out(F.col("doc_id"), 4, 2)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id"), 5, 0), "xx").otherwise(F.col("lang")))
    assert language.learn(docs, ~held_out(F.col("doc_id"), 5, 0)) == language.learn(other, ~held_out(F.col("doc_id"), 5, 0))


def test_dictionaries_of_copies_and_of_long_texts(spark):
    docs = spark.range(120_000).select(
        F.when(F.col("id") < 60_000, "aa").otherwise("bb").alias("lang"),
        F.when(F.col("id") % 60_000 >= 20, F.lit("copy"))
        .otherwise(F.concat(F.lit("text"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    known = language.learn(docs, F.lit(True))
    assert sorted(known) == ["aa", "bb"] and all(len(v.splitlines()) == 21 for v in known.values())
    tiny = [("cc", f"tiny {'x' * i}") for i in range(1, 5)]
    long = [("cc", " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(600)) * 4) for i in range(20)]
    assert all(len(t) > language.SAMPLE_BYTES for _, t in long)
    known = language.learn(spark.createDataFrame(tiny + long, "lang string, text string"), F.lit(True))
    assert len(known["cc"]) == language.DICTIONARY and b"tiny xxxx\n" in known["cc"]


def test_bad_labels_are_not_read_by_quality(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    learn = ~held_out(F.col("doc_id"), 4, 2)
    a, b = (quality.fit(docs, x, learn) for x in (labels, labels.where("quality = 1")))
    assert np.array_equal(a.weights, b.weights)


def test_toxicity_replaces_ids_without_a_text_that_fits(spark, monkeypatch):
    long = "long words " * 4000
    rows = [(i, f"good text {i}") for i in range(100)] + [(i, None) for i in range(100, 150)]
    rows += [(i, f"{long}{i}") for i in range(200, 300)] + [(i, f"awful text {i}") for i in range(300, 305)]
    labels = [(i, 0) for i in range(200)] + [(i, 1) for i in range(200, 400)]  # 150.. and 305.. aren't in docs
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, share: seen.append(([len(f) for f in x], sorted(y), share)))
    docs = frame(spark, rows)
    toxicity.fit(docs, labels, F.lit(True), sample=5)
    lengths, y, share = seen.pop()
    assert y == [0] * 5 + [1] * 5 and max(lengths) < 30 and share == 0.5  # short texts of both classes, although few
    toxicity.fit(docs.where("doc_id < 300"), labels, F.lit(True), sample=5)
    lengths, y, share = seen.pop()
    assert y == [0] * 5 + [1] * 4  # only long ones: 44 kB each until 5 * 32 kB are full


def test_repeated_ids_send_no_more_than_the_sample(spark, monkeypatch):
    text = F.when(F.col("id") % 3 == 0, F.expr("repeat('some word ', 1 + int(id % 500))")).otherwise(F.lit("repeated text"))
    docs = spark.range(6000).select((F.col("id") % 2).alias("doc_id"), text.alias("text"))
    labels = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "doc_id long, toxic int, quality int")
    fetched, sizes, fetch = [], [], type(docs).toLocalIterator

    def counted(df, *args, **more):
        for row in fetch(df, *args, **more):
            fetched.append(row)
            yield row

    monkeypatch.setattr(type(docs), "toLocalIterator", counted)
    toxicity.fit(docs, labels, F.lit(True), sample=10)
    assert 2 <= len(fetched) <= 20
    monkeypatch.setattr(quality, "estimated_prior", lambda p, u: sizes.append(len(p)) or 0.5)
    quality.fit(docs, labels, F.lit(True), sample=10)
    assert sizes == [10]


def test_unlabelled_sample_of_quality_counts_texts_without_copies(spark, monkeypatch):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.expr("repeat('some word ', 1 + int(id % 100))").alias("text"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "estimated_prior", lambda p, u: sizes.append((len(p), len(u))) or 0.5)
    quality.fit(docs, labels, F.lit(True), sample=100)
    assert sizes == [(20, 100)]


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, len(quality.NAMES))), rng.normal(2.5, 1, (900, len(quality.NAMES)))
    web = np.concatenate([rng.normal(0, 1, (2100, len(quality.NAMES))), bad])
    edges = np.quantile(web, np.arange(1, quality.BINS) / quality.BINS, axis=0).T
    assert abs(quality.estimated_prior(quality._binned(good, edges), quality._binned(web, edges)) - 0.7) < 0.06


def test_edge_cases(spark, tables, edge, nothing):
    labels = tables["labels"].withColumn("text", F.lit("clash")).union(spark.createDataFrame(
        [(None, 1, 1, "x"), (0, None, None, "x"), (0, 1, 1, "x")], "doc_id long, quality int, toxic int, text string"))
    always = F.lit(True)
    tox, qual = toxicity.fit(tables["documents"], labels, always), quality.fit(tables["documents"], labels, always)
    known = language.learn(tables["documents"], always)
    n = edge.count()
    for out in (toxicity.score(edge, tox), quality.score(edge, qual), language.identify(edge, known)):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    for out in (toxicity.score(nothing, tox), quality.score(nothing, qual), language.identify(nothing, known)):
        assert out.count() == 0
    und = {(r.doc_id, r.lang_pred) for r in language.identify(edge, known).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= und and (5, "und") not in und
    empty = {r.doc_id: r.score for r in toxicity.score(edge, tox).collect()}
    assert empty[1] == empty[2]


def test_without_anything_to_learn(spark, nothing, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    always = F.lit(True)
    assert {r.predicted for r in toxicity.score(edge, toxicity.fit(nothing, labels, always)).collect()} == {0}
    assert {r.score for r in quality.score(edge, quality.fit(nothing, labels, always)).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(edge, language.learn(nothing, always)).collect()} == {"und"}
    only = frame(spark, [(1, "some text here")])
    assert {r.lang_pred for r in language.identify(only, language.learn(only, always)).collect()} == {"en"}
