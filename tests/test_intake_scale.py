"""What the intake and the flattening work out once a record, and not once a line or again."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from promolift.operators import contracts as CT
from promolift.operators import flatten as FL
from promolift.operators import metrics as M
from promolift.operators import validate as V
from promolift.schemas import ORDER


def _line(product, price, quantity, discount, discounts=None):
    return {"product_id": product, "variant_id": 1, "title": f"p{product}", "price": price, "quantity": quantity, "total_discount": discount,
            "compare_at_price": price, "active_campaign_id": None, "active_campaign_ids": [], "campaign_discounts": discounts}


def _order(key, lines, **more):
    row = dict.fromkeys(ORDER.names) | {"id": key, "shop_id": "s", "order_number": key, "currency": "EUR", "cost_total": 5.0, "line_items": lines}
    row |= dict.fromkeys(("subtotal_price", "total_discounts", "total_price", "shipping_original_price", "shipping_price_charged",
                          "shipping_discount_amount", "revenue_with_cost"), 1.0)
    return row | dict.fromkeys(("has_active_campaign", "is_free_shipping", "has_partial_cost"), False) | {"createdAt": NOW, **more}


NOW = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
FULL = ("c", "n", "t", 1.0)
ORDERS = [
    _order(1, [_line(1, 10.1, 3, 0.3), _line(2, 5.0, 1, 9.0), _line(1, 10.1, 3, 0.3)], order_campaigns=[(*FULL, None, None)]),
    _order(2, [_line(3, None, 1, 0.0), _line(4, 2.0, 2, 0.0, [FULL])]),
    _order(3, [_line(5, 2.0, None, 0.0, [FULL, (None, "n", None, 2.0), None])], applied_campaigns=[FULL, (None, None, "t", 1.0)]),
    _order(4, [], order_campaigns=[None, ("c", None, "t", None, 1, 2.0)]),
    _order(5, None, applied_campaigns=[]), _order(6, [None], currency=None), _order(None, [_line(1, 1.0, 1, 0.0)], createdAt=None),
]


def _orders(spark):
    return spark.createDataFrame([tuple(o[c] for c in ORDER.names) for o in ORDERS], ORDER).drop("customer_email")


def test_order_revenue_is_folded_once_an_order(spark):
    lines = FL.to_lineitems(_orders(spark), with_order_net=True)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode", 1)
    assert "aggregate(" in below and "aggregate(" not in above
    assert "line_items" not in above   # an order's list isn't copied to its lines
    got = sorted(((r.order_id, r.product_id, r.order_net_revenue, r.first_line) for r in lines.collect()), key=str)
    want = [(1, 1, Decimal("60.000000"), False), (1, 1, Decimal("60.000000"), True), (1, 2, Decimal("60.000000"), False), (2, 3, None, True),
            (2, 4, None, False), (3, 5, None, True), (6, None, None, True), (None, 1, Decimal("1.000000"), True)]
    assert got == sorted(want, key=str)
    flat = M.order_net_revenue(M.compute_line_revenue(FL.to_lineitems(_orders(spark)).where("order_id = 1")))
    assert flat.first().order_net_revenue == Decimal("60.000000")


def test_whole_records_are_not_walked(spark):
    """Only records that lack something are walked, and what is found stays the same."""
    df = _orders(spark).withColumn("record_ok", F.when(F.col("id") != 2, F.col("id") != 5))
    for frame in (df, df.drop("record_ok")):
        walked = CT._missing_in("", "''", CT.contract_of("orders"), 0)
        if "record_ok" in frame.columns:
            walked = f"concat({walked}, CASE WHEN record_ok THEN {CT._NONE} ELSE {CT._one(chr(39) * 2, 'syntax')} END)"
        rows = frame.select(F.expr(walked).alias("want"), CT._row_found(frame, "orders").alias("got")).collect()
        assert all(r.want == r.got for r in rows) and sum(not r.got for r in rows) == (1 if "record_ok" in frame.columns else 2)
    assert str(CT._row_found(df, "orders")).index("forall") < str(CT._row_found(df, "orders")).index("missing")


def test_listed_breaches_are_not_looked_for_again(spark):
    df = _orders(spark).withColumn("record_ok", F.lit(True))
    kept = CT.listed(df, "orders")
    counts = V.validate_nested(kept.select("id", CT.FOUND))   # the list is all that is read
    assert sorted(counts.collect()) == sorted(V.validate_nested(df).collect())
    assert {(r.table, r.rule): r.n_violations for r in counts.collect()} == {
        ("campaign_discounts", "required:campaignId"): 1, ("campaign_discounts", "required:campaignType"): 1,
        ("applied_campaigns", "required:campaignId"): 1, ("applied_campaigns", "required:campaignName"): 1,
        ("order_campaigns", "required:campaignName"): 1, ("order_campaigns", "required:discountAmount"): 1}
