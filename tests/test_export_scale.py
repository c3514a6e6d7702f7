"""The nested export and the staged texts at size: what is shuffled, gathered and written."""

import glob
import json
import os
import tempfile

import pytest

from promolift.operators import contracts as CT
from promolift.sources import export as EX
from promolift.sources import sinks as SK
from promolift.sources import testtables as tt


@pytest.fixture(scope="module")
def shop(spark):
    d = tempfile.mkdtemp(prefix="promolift-test-")
    orders = [(k, 1, "P" if k % 2 else "O", 100.0 + k, "1996-01-02 00:00:00", "2-HIGH") for k in range(60)]
    orders += [(7, 1, "O", 55.0, "1996-01-03 00:00:00", "5-LOW"), (None, 1, "O", 5.0, "1996-01-03 00:00:00", "5-LOW")]
    lines = [(k % 61, k % 5, 3, 7, 2.0, 0.10 if k % 3 else 0.06) for k in range(300)] + [(None, 1, 3, 1, 1.0, 0.0), (3, None, 3, 1, 1.0, 0.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string") \
        .selectExpr("* except (o_orderdate)", "cast(o_orderdate as timestamp_ntz) o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", 900.0 + p) for p in (0, 1, 2, 3, 4, 4)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d


def test_an_order_holds_its_flat_lines(spark, shop, monkeypatch):
    flat = {}
    for r in tt.shop_lines(spark, shop).collect():
        flat.setdefault(r.order_id, []).append((r.product_id, r.title, float(r.price), r.quantity, float(r.total_discount), r.active_campaign_id,
                                                tuple(r.active_campaign_ids), len(r.campaign_discounts)))
    assert len(flat[7]) == 2 * sum(k % 61 == 7 for k in range(300)) + sum(k % 61 == 7 and k % 5 == 4 for k in range(300)) * 2
    monkeypatch.setattr(tt, "LINES_PER_TASK", 20)
    nested = tt.shop_export_orders(spark, shop)
    rows = nested.collect()
    assert len(rows) == 62
    for r in rows:
        got = [(i.product_id, i.title, i.price, i.quantity, i.total_discount, i.active_campaign_id, tuple(i.active_campaign_ids), len(i.campaign_discounts))
               for i in r.line_items]
        assert sorted(got, key=str) == sorted(flat.get(r.id, []), key=str), r.id


def test_tasks_grow_with_the_lines(spark, shop, monkeypatch):
    """A task's lines are bounded whatever the number of shuffle partitions."""
    monkeypatch.setattr(tt, "LINES_PER_TASK", 20)
    assert tt._line_values(spark, shop).rdd.getNumPartitions() == 16
    plan = tt.shop_export_orders(spark, shop)._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list"):].split(", 0, 0)")[0]
    assert "title" in gathered and "campaignName" not in gathered   # only what differs from line to line is gathered


def test_compressed_texts_read_back(spark, shop):
    path = os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), "out")
    orders = tt.shop_export_orders(spark, shop).drop("customer_email")
    EX.write_entity(orders, path, "json", "gzip")
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")
    assert sorted((r.id or -1, len(r.line_items)) for r in EX.read_entity(spark, path, "orders").collect()) == \
        sorted((r.id or -1, len(r.line_items)) for r in orders.collect())
    SK.write_csv(orders, path + "-csv", "gzip")
    assert glob.glob(f"{path}-csv/*.csv.gz")
    assert SK.read_csv(spark, path + "-csv", SK.csv_schema(orders)).count() == 62


def test_walk_takes_no_record_out_whole():
    """Lists and objects are taken apart, not copied as maps or lists of VARIANT records."""
    order = CT.contract_of("orders").schema
    assert CT._apart(order["line_items"].dataType).startswith("array<struct<`product_id`: variant")
    source = open(CT.__file__).read()
    assert "map<string,variant>" not in source


def test_document_written_by_many_tasks(spark, monkeypatch):
    """Beyond the size of one file the document is whole, in the same order, duplicates and empty sections included."""
    monkeypatch.setattr(SK, "DOCUMENT_BYTES", 100)
    path = os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), "doc")
    rows = [(k % 40, f'l{{"[,\n{k % 40}', None if k % 2 else float("nan")) for k in range(60)]
    sections = {"a b": spark.createDataFrame(rows, "k long, s string, x double").repartition(5),
                "none": spark.createDataFrame([], "k long"), "b": spark.createDataFrame([(1, [])], "k long, l array<int>")}
    size = SK.write_document(sections, path)
    files = sorted(glob.glob(f"{path}/*/part-*"))
    text = "".join(open(f, encoding="utf-8").read() for f in files)
    found = json.loads(text)
    assert size > 100 and [*found] == ["a b", "none", "b"] and found["none"] == [] and found["b"] == [{"k": 1, "l": []}]
    texts = [json.dumps(r, separators=(",", ":")) for r in found["a b"]]
    assert texts == sorted(texts) and sorted((r["k"], r["s"]) for r in found["a b"]) == sorted((k, t) for k, t, _ in rows)
    back = SK.read_document(spark, path, {n: df.schema for n, df in sections.items()})
    assert sorted((r.k, r.s) for r in back["a b"].collect()) == sorted((k, t) for k, t, _ in rows)
    assert back["none"].count() == 0 and back["b"].collect()[0].l == []


def test_flat_lines_are_joined_once(spark, shop):
    """The order sums and the line margins read one staged table, not the lines' joins twice."""
    from promolift.plans.pipeline import PromoPipeline

    p = PromoPipeline(tt.shop_lines(spark, shop), tt.shop_orders(spark, shop), tt.shop_campaigns(spark))
    assert p.line_margin.count() == tt.shop_lines(spark, shop).count()
    assert [s for s in p.staged if "line-revenue" in s]
    assert p.observed["lines"] == p.line_margin.count()
    p.close()
