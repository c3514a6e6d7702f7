"""The corpus pipeline: each stage's effect on its own input, edge cases, run()."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from llm_data import SF, edge_rows, frame
from test_decontaminate import expected as contaminated
from test_packing import check_pieces
from test_simhash import expected as groups
from promolift.llm.common import KEY_ROWS, only, without  # noqa: F401


def test_names_and_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_each_stage_on_what_the_one_before_kept(spark, tables, tmp_path):
    docs = tables["documents"]
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "near_dedup":
            first = {c for _, _, c in groups(list(before.items()))}
            assert set(after) == first
        if name == "decontaminate":
            items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
            bad = {r[0] for r in contaminated(list(before.items()), items) if r[4]}
            assert set(before) - set(after) == bad
        if name != "line_dedup":
            assert all(before[i] == t for i, t in after.items())
    out = C.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(list(after.items()), out, 4096)


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    rows = tables["documents"].join(tables["labels"], "doc_id").where("toxic = 0").select(*tables["documents"].columns)
    words = "idiot stupid trash moron"
    docs = tables["documents"].union(rows.limit(20).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn(
        "text", F.concat(F.substring("text", 1, 300), F.lit(f" {words} you worthless pathetic loser scum clown disgusting {words}"))))
    left = {r.doc_id for r in C.not_toxic(spark, docs, SF).select("doc_id").collect()}
    clean = {r.doc_id for r in rows.select("doc_id").collect()}
    assert len(clean - left) <= 0.02 * len(clean)
    assert len({i for i in left if i >= 10_000}) <= 2


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_edge_cases(spark, edge, nothing, name, stage):
    for docs in (edge, nothing):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "pack":
            assert out.columns == docs.columns
            assert len(rows) <= docs.count()
        if docs is nothing:
            assert not rows
    if name == "toxicity":
        assert len(stage(spark, edge, SF).collect()) >= len(edge_rows()) - 1


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in C.run(spark, SF).collect()) == want


def test_many_keys_are_joined_by_shuffle(spark, monkeypatch):
    import promolift.llm.common as common

    monkeypatch.setattr(common, "KEY_ROWS", 0)
    docs = frame(spark, [(1, "a"), (2, None), (None, "c"), (None, None), (1, "a"), (1, "b")])
    keys = docs.where("text = 'a' OR doc_id IS NULL").select(*common.row_key())
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert key(common.without(docs, keys)) == [(1, "b"), (2, None)]
    assert key(common.only(docs, keys)) == sorted([(1, "a"), (1, "a"), (None, "c"), (None, None)], key=repr)
