"""Export intake, personal data, validation, contracts and sinks on inline
fixtures."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from promolift.operators import flatten as FL
from promolift.operators import privacy as PV
from promolift.operators import segments as S
from promolift.operators import validate as V
from promolift.sources import export as EX
from promolift.sources import sinks as SK

def _order(number, **more):
    return {"id": 7000 + number, "shop_id": "corner-shop", "order_number": number, "currency": "EUR",
            "subtotal_price": 31.5, "total_discounts": 1.5, "total_price": 30.0, "has_active_campaign": True,
            "is_free_shipping": False, "shipping_original_price": 4.0, "shipping_price_charged": 4.0,
            "shipping_discount_amount": 0.0, "cost_total": 12.0, "revenue_with_cost": 18.0, "has_partial_cost": False,
            "createdAt": f"2022-06-{number:02d}T08:15:00Z", "customer_email": f"client{number}@mail.test", **more}


def _item(product, **more):
    return {"product_id": product, "variant_id": 10 * product, "title": f"Kettle {product}", "price": 10.5, "quantity": 3,
            "total_discount": 1.5, "compare_at_price": 12.0, **more}


SHOP = {"id": "corner-shop", "shopifyDomain": "corner.test", "country": "FR", "currency": "EUR", "planName": "grow",
        "createdAt": "2021-02-03T00:00:00Z", "ownerName": "A. Person", "ownerEmail": "person@mail.test",
        "customerEmail": "help@mail.test"}
PROMO = {"id": "p-9", "shopId": "corner-shop", "name": "Summer", "type": "volume", "status": "ended",
         "startAt": "2022-06-01T00:00:00Z", "endAt": None, "ranAt": "2022-06-01T00:00:00Z", "isDeleted": False,
         "totalRevenue": 9.5, "orderCount": 2, "marginPct": 0.25, "createdAt": "2022-05-30T00:00:00Z", "extra": [1]}
# several orders: two lines, one line with a promotion, an empty list, an absent one, a null one
MINIMAL = {"meta": {"note": "own test data"}, "shop": SHOP, "campaigns": [PROMO], "orders": [
    _order(1, line_items=[_item(31), _item(32, price=0.0, total_discount=0.0)]),
    _order(2, line_items=[_item(31, active_campaign_id="p-9", active_campaign_ids=["p-9"], campaign_discounts=[
        {"campaignId": "p-9", "campaignName": "Summer", "campaignType": "volume", "discountAmount": 1.5}])]),
    _order(3, line_items=[]), _order(4), _order(5, line_items=None, order_campaigns=None)]}


def _write(doc) -> str:
    d = tempfile.mkdtemp(prefix="promolift-test-")
    path = os.path.join(d, "export.json")
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    return path


@pytest.fixture(scope="module")
def doc(spark):
    return EX.read_export_document(spark, _write(MINIMAL))


def test_minimal_document_shapes(doc):
    clean = PV.minimize_document(doc)
    orders = EX.document_orders(clean)
    assert FL.to_orders(orders).count() == 5
    items = FL.to_lineitems(orders).orderBy("order_id", "product_id")
    assert items.count() == 3
    camps = FL.to_campaigns(EX.document_campaigns(clean))
    assert camps.count() == 1
    li = items.first()
    assert (li.order_id, li.product_id, li.variant_id, li.title, li.price, li.quantity) == \
        (7001, 31, 310, "Kettle 31", 10.5, 3)
    assert li.active_campaign_id is None and li.active_campaign_ids == [] and li.campaign_discounts == []
    assert items.collect()[2].active_campaign_ids == ["p-9"]
    c = camps.first()
    assert c.endAt is None and c.campaign_pos == 0


def test_personal_data_removed(spark, doc):
    clean = PV.minimize_document(doc)
    shop = PV.minimize_shop(EX.document_shop(clean))
    orders = FL.to_orders(EX.document_orders(clean))
    items = FL.to_lineitems(EX.document_orders(clean))
    frames = {"shop": shop, "orders": orders, "lineitems": items}
    PV.assert_no_pii(frames)
    assert PV.pii_column_audit(spark, frames).count() == 0
    raw = {"doc": doc}
    hits = {(r.column, r.fragment) for r in PV.pii_column_audit(spark, raw).collect()}
    assert ("orders[].customer_email", "customer_email") in hits and ("shop.ownerEmail", "email") in hits
    with pytest.raises(ValueError, match="personal data"):
        PV.assert_no_pii({"orders": EX.document_orders(doc)})


def test_value_scan_counts_every_row(spark):
    df = spark.createDataFrame([("a@b.co", "x"), ("none", None), ("c@d.org and more", "y")], "s string, t string")
    got = {r.column: (r.n_values, r.n_matches) for r in PV.pii_value_scan(df, "t").collect()}
    assert got == {"s": (3, 2), "t": (2, 0)}


def test_missing_top_level_key_raises(spark):
    bad = dict(MINIMAL)
    bad.pop("campaigns")
    with pytest.raises(ValueError, match="campaigns"):
        EX.read_export_document(spark, _write(bad))


def test_missing_file_raises(spark):
    with pytest.raises(FileNotFoundError):
        EX.read_export_document(spark, "/tmp/promolift-no-such-file.json")


def test_validation_flags_missing_required_field(spark):
    bad = json.loads(json.dumps(MINIMAL))
    del bad["orders"][0]["cost_total"]
    del bad["orders"][0]["line_items"][0]["price"]
    orders = EX.document_orders(EX.read_export_document(spark, _write(bad)))
    oc = {r.rule: r.n_violations for r in V.validate_orders(orders).collect()}
    assert oc["required:cost_total"] == 1 and oc["unique:id"] == 0
    lc = {r.rule: r.n_violations for r in V.validate_lineitems(orders).collect()}
    assert lc["required:price"] == 1
    with pytest.raises(ValueError, match="cost_total"):
        V.raise_on_violations(V.validate_orders(orders))
    rows = V.violations(orders, "orders", V.order_rules(), key=["id"]).collect()
    assert [(r.id, r.rule) for r in rows] == [(7001, "required:cost_total")]


def test_contract_violations(spark):
    seg = spark.createDataFrame([("Nope", 1, 3, "s1", "l", "r"), ("BXGY", 6, 2, "s2", None, "r"), (None, 2, 1, None, "l", "r")],
                                "discount_mechanic string, priority int, n_products long, segment_id string, "
                                "segment_label string, rationale string")
    c = {r.rule: r.n_violations for r in V.violation_counts(seg, "segments", V.segment_rules()).collect()}
    assert c == {"domain:discount_mechanic": 2, "range:priority": 1, "non_empty:segment": 0, "required:segment_id": 1,
                 "required:segment_label": 1, "required:rationale": 0}
    recs = spark.createDataFrame([(1, "t", "BXGY", 1.1, 0.5, "r", "e"), (2, "t", "BXGY", 0.6, float("nan"), "r", "e"),
                                  (None, None, None, 0.5, 0.5, "r", "e")],
                                 "product_id long, title string, recommended_mechanic string, confidence double, "
                                 "priority_score double, rationale string, expected_effect string")
    c = {r.rule: r.n_violations for r in
         V.violation_counts(recs, "recommendations", V.recommendation_rules()).collect()}
    assert c["range:confidence"] == 1 and c["finite:priority_score"] == 1
    assert c["domain:recommended_mechanic"] == 1 and c["required:product_id"] == 1 and c["required:title"] == 1


def test_csv_and_json_roundtrips(spark):
    title = 'two\nlines, "quoted" and \\ back'
    df = spark.createDataFrame([(1, ["a", "b/c"], 2.5, float("nan"), title, (float("nan"), [1.0, float("nan")]))],
                               "id long, refs array<string>, x double, y double, title string, "
                               "nested struct<a: double, b: array<double>>")
    d = tempfile.mkdtemp(prefix="promolift-test-")
    SK.write_csv(df, os.path.join(d, "csv"))
    back = SK.read_csv(spark, os.path.join(d, "csv"), SK.csv_schema(df)).first()
    assert json.loads(back.refs) == ["a", "b/c"] and back.x == 2.5 and back.title == title
    import csv
    import glob
    read = [row["title"] for name in glob.glob(os.path.join(d, "csv", "*.csv")) for row in csv.DictReader(open(name, newline=""))]
    assert read == [title]
    rec = SK.json_records(df).first().record
    assert json.loads(rec)["y"] is None and json.loads(rec)["nested"] == {"a": None, "b": [1.0, None]}
    restored = SK.restore_records(SK.json_records(df), df.schema).first()
    assert restored.refs == ["a", "b/c"] and restored.y is None


def test_nested_order_revenue_matches_shuffle_path(spark, doc):
    from promolift.operators import metrics as M
    orders = EX.document_orders(PV.minimize_document(doc))
    folded = FL.to_lineitems(orders, with_order_net=True)
    def costs(items):
        rows = M.allocate_order_cost_to_lines(M.compute_line_revenue(items)).collect()
        return sorted((r.order_id, r.product_id, float(r.allocated_cost)) for r in rows)
    assert costs(folded) == costs(FL.to_lineitems(orders)) == [(7001, 31, 12.0), (7001, 32, 0.0), (7002, 31, 12.0)]


def test_column_value_audit(spark, doc):
    orders = EX.document_orders(doc)
    rows = {(r.table, r.column, r.fragment): (r.n_values, r.n_matches)
            for r in PV.pii_column_value_audit({"raw": orders, "clean": PV.minimize_orders(orders)}).collect()}
    assert rows == {("raw", "customer_email", "customer_email"): (5, 5), ("raw", "customer_email", "email"): (5, 5)}
    nested = orders.withColumn("line_items", F.transform("line_items", lambda x: x.withField("buyer_email", F.lit("b@mail.test"))))
    rows = {(r.column, r.fragment): r.n_matches for r in PV.pii_column_value_audit({"raw": nested.drop("customer_email")}).collect()}
    assert rows == {("line_items[].buyer_email", "email"): 2}
    assert PV.pii_column_value_audit({"clean": PV.minimize_orders(orders)}).count() == 0


def test_campaign_validation(spark, doc):
    camps = EX.document_campaigns(doc)
    counts = {r.rule: r.n_violations for r in V.validate_campaigns(camps).collect()}
    assert counts["required:id"] == 0 and counts["end_after_start"] == 0   # null endAt is allowed
    bad = json.loads(json.dumps(MINIMAL))
    del bad["campaigns"][0]["type"]
    camps = EX.document_campaigns(EX.read_export_document(spark, _write(bad)))
    counts = {r.rule: r.n_violations for r in V.validate_campaigns(camps).collect()}
    assert counts["required:type"] == 1


def _lines(records) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), "records.jsonl")
    with open(path, "w") as fh:
        fh.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
    return path


def _frames(spark, orders, campaigns=(PROMO,), **more):
    from promolift.plans.intake import build_clean_frames
    return build_clean_frames(EX.read_entity(spark, _lines(orders), "orders"),
                              EX.read_entity(spark, _lines(campaigns), "campaigns"),
                              EX.read_entity(spark, _lines([SHOP]), "shop"), **more)


def test_clean_frames_of_good_records(spark):
    clean = _frames(spark, MINIMAL["orders"])
    assert {n: df.count() for n, df in clean.frames().items()} == {"orders": 5, "lineitems": 3, "campaigns": 1, "shop": 1}
    assert {r.rule: r.n_violations for r in clean.rule_counts.collect() if r.rule.startswith(("type:", "required:"))
            and r.n_violations} == {}
    audited = {(r.table, r.column) for r in clean.audit_counts.collect()}
    assert ("lineitems", "title") in audited and ("lineitems", "campaign_discounts") in audited
    assert not any(r.n_matches for r in clean.audit_counts.collect())
    staged = list(clean.staged)
    clean.close()
    assert staged and not any(os.path.exists(p.replace("file:", "", 1)) for p in staged)


@pytest.mark.parametrize("bad,rule", [
    (_order(8, line_items="not a list"), "type:record"),
    ("{broken", "type:record"),
    (_order(8, line_items=[_item(5, quantity="three")]), "type:record"),
    (_order(8, cost_total=None), "required:cost_total"),
    (_order(8, line_items=[_item(5, price=None)]), "required:price"),
    (_order(8, order_campaigns=[{"campaignName": "no id"}]), "required:campaignId"),
])
def test_bad_records_are_not_lost_silently(spark, bad, rule):
    with pytest.raises(ValueError, match=rule.split(":")[1]):
        _frames(spark, [*MINIMAL["orders"], bad])
    counts = {}
    for r in _frames(spark, [*MINIMAL["orders"], bad], strict=False).rule_counts.collect():
        counts[r.rule] = counts.get(r.rule, 0) + r.n_violations
    assert counts[rule] == 1


def test_warnings_don_t_raise(spark):
    odd = _order(1, total_price=-1.0, line_items=[_item(31, quantity=0)])
    late = dict(PROMO, endAt="2020-01-01T00:00:00Z")
    clean = _frames(spark, [*MINIMAL["orders"], odd], [late])
    counts = {(r.table, r.rule): r.n_violations for r in clean.rule_counts.collect()}
    assert counts["orders", "unique:id"] == 2 and counts["orders", "non_negative:total_price"] == 1
    assert counts["lineitems", "positive:quantity"] == 1 and counts["campaigns", "end_after_start"] == 1


def test_personal_data_in_lines_and_campaigns_raises(spark):
    with pytest.raises(ValueError, match="lineitems"):
        _frames(spark, [_order(1, line_items=[_item(31, title="write to someone@mail.test")])])
    with pytest.raises(ValueError, match="campaigns"):
        _frames(spark, MINIMAL["orders"], [dict(PROMO, name="ask me@mail.test")])
    with pytest.raises(ValueError, match="type:record|record"):
        _frames(spark, MINIMAL["orders"], [dict(PROMO, orderCount="many")])


@pytest.mark.parametrize("n_files, split", [(1, 1 << 27), (1, 600), (9, 1 << 27), (9, 600)])
def test_input_positions(spark, n_files, split):
    """Places in the input don't depend on files, splits or partitions."""
    folder = tempfile.mkdtemp(prefix="promolift-test-")
    rows = [dict(PROMO, id=f"p-{(7 * k) % 60}") for k in range(60)]
    for n in range(n_files):
        part = rows[n * 60 // n_files:(n + 1) * 60 // n_files]
        with open(os.path.join(folder, f"part-{n:03d}.json"), "w") as fh:
            fh.write("".join(json.dumps(r) + "\n" for r in part))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, split)
        staged = []
        read = EX.read_entity(spark, folder, "campaigns", position="campaign_pos", staged=staged)
        got = [r.id for r in read.orderBy("campaign_pos").collect()]
        places = sorted(r.campaign_pos for r in read.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [r["id"] for r in rows] and places == list(range(60)) and len(staged) == 1
    assert "campaign_pos" in FL.to_campaigns(read).columns and read.where("record_ok").count() == 60


def test_positions_drop_personal_fields(spark):
    read = EX.read_entity(spark, _lines(MINIMAL["orders"]), "orders", position="pos")
    assert "customer_email" not in read.columns
    assert [r.id for r in read.orderBy("pos").collect()] == [o["id"] for o in MINIMAL["orders"]]


def test_stream_sets_bad_orders_aside(spark):
    from promolift.streaming.incremental import start_line_margin_ingest, start_quarantine_ingest
    source = os.path.dirname(_lines([*MINIMAL["orders"], _order(8, line_items="no list"), "{broken",
                                     _order(9, line_items=[_item(4, price=None)])]))
    sink, aside = (os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), n) for n in ("lines", "aside"))
    start_line_margin_ingest(spark, source, sink).awaitTermination()
    start_quarantine_ingest(spark, source, aside).awaitTermination()
    assert sorted(r.order_id for r in spark.read.parquet(sink).collect()) == [7001, 7001, 7002]
    assert sorted((r.id or 0) for r in spark.read.parquet(aside).collect()) == [0, 7008, 7009]


def test_pipeline_writes_and_removes(spark):
    from promolift.plans.pipeline import PromoPipeline
    read = lambda rows, kind: EX.read_entity(spark, _lines(rows), kind)
    out = tempfile.mkdtemp(prefix="promolift-test-")
    with PromoPipeline.from_export(read(MINIMAL["orders"], "orders"), read([PROMO], "campaigns"), read([SHOP], "shop"),
                                   min_units=1) as p:
        paths = p.write_outputs(out)
        staged = list(p.staged)
        schemas = {n: SK.csv_schema(df) for n, df in p.outputs().items()}
        counts = {n: SK.read_csv(spark, path, schemas[n]).count() for n, path in paths.items()}
    assert counts == {"orders_clean": 5, "lineitems_clean": 3, "campaigns_clean": 1, "product_metrics": 2,
                      "product_classification": 2, "campaign_eval": 1, "recommendations": 2}
    assert staged and not any(os.path.exists(p.replace("file:", "", 1)) for p in staged)


def test_cluster_without_a_shared_folder_is_refused():
    from promolift.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="shared folder"):
        ensure_checkpoint_dir(Session())
