"""The record contract at every depth, on VARIANT records and typed rows, and
the root of single documents."""

import json
import os
import tempfile

import pytest

from promolift.operators import contracts as CT
from promolift.plans.intake import build_clean_frames
from promolift.sources import export as EX
from test_intake import MINIMAL, PROMO, SHOP, _item, _lines, _order

DISCOUNT = {"campaignId": "p-9", "campaignName": "Summer", "campaignType": "volume", "discountAmount": 1.5}


def records(spark, rows):
    return EX.read_records(spark, _lines(rows))


def found(df):
    return {(r.row_id, r.path, r.reason) for r in df.collect()}


def without(record, key):
    return {k: v for k, v in record.items() if k != key}


def test_good_records_have_no_breach(spark):
    good = [o for o in MINIMAL["orders"] if o.get("line_items", []) is not None]
    full = _order(6, line_items=[_item(3, campaign_discounts=[DISCOUNT], active_campaign_ids=[], active_campaign_id=None)],
                  applied_campaigns=[DISCOUNT], order_campaigns=[dict(DISCOUNT, shippingDiscountType=1, shippingDiscountValue=None)])
    assert found(CT.record_breaches(records(spark, [*good, full]), "orders")) == set()
    assert found(CT.record_breaches(records(spark, [PROMO]), "campaigns")) == set()
    assert found(CT.record_breaches(records(spark, [SHOP]), "shop")) == set()


@pytest.mark.parametrize("table", ["orders", "campaigns", "shop"])
def test_every_required_field(spark, table):
    """Each required field absent, null and of another type; optional ones of another type."""
    whole = {"orders": _order(1), "campaigns": PROMO, "shop": SHOP}[table]
    contract = CT.contract_of(table)
    rows, want = [], set()
    for f in contract.schema.fields:
        if f.name == "id" or f.name in contract.nested:
            continue
        key = f"{f.name}-{{}}" if table != "orders" else None
        for k, reason in enumerate(("absent", "null", "type")):
            row_id = key.format(k) if key else 10 * len(rows)
            row = dict(whole, id=row_id)
            row = without(row, f.name) if reason == "absent" else dict(row, **{f.name: None if reason == "null" else [1]})
            rows.append(row)
            if reason == "type" or f.name in contract.required:
                want.add((str(row_id), f.name, reason))
    assert found(CT.record_breaches(records(spark, rows), table)) == want


def test_nested_paths(spark):
    bad = [
        _order(1, line_items=[_item(3), without(_item(4), "title"), 5, None]),
        _order(2, line_items=[_item(3, campaign_discounts=[DISCOUNT, without(DISCOUNT, "campaignType"), dict(DISCOUNT, discountAmount="x")])]),
        _order(3, applied_campaigns=[{"campaignId": "only"}], order_campaigns=[dict(DISCOUNT, shippingDiscountType=1.5)]),
        _order(4, line_items={"not": "a list"}, applied_campaigns=None),
        _order(5, line_items=[_item(3, active_campaign_ids=["a", 7], active_campaign_id=9)]),
    ]
    assert found(CT.record_breaches(records(spark, bad), "orders")) == {
        ("7001", "line_items[1].title", "absent"), ("7001", "line_items[2]", "type"), ("7001", "line_items[3]", "null"),
        ("7002", "line_items[0].campaign_discounts[1].campaignType", "absent"),
        ("7002", "line_items[0].campaign_discounts[2].discountAmount", "type"),
        ("7003", "applied_campaigns[0].campaignName", "absent"), ("7003", "applied_campaigns[0].campaignType", "absent"),
        ("7003", "applied_campaigns[0].discountAmount", "absent"), ("7003", "order_campaigns[0].shippingDiscountType", "type"),
        ("7004", "line_items", "type"), ("7004", "applied_campaigns", "null"),
        ("7005", "line_items[0].active_campaign_ids[1]", "type"), ("7005", "line_items[0].active_campaign_id", "type")}


def test_scalars(spark):
    """Whole numbers in any spelling are integers; text, booleans and times are strict."""
    rows = ['{"quantity": 2.0}', '{"quantity": 2e0}', '{"quantity": 2.5}', '{"quantity": "2"}', '{"quantity": true}',
            '{"quantity": 123456789012345678901234567890}', '{"price": 3}', '{"price": 1e400}', '{"price": "3"}']
    orders = [json.dumps(_order(k, line_items=[_item(1)])).replace(f'"{key}": {old}', text[1:-1])
              for k, text in enumerate(rows, 1) for key, old in ((("quantity", "3") if "quantity" in text else ("price", "10.5")),)]
    got = found(CT.record_breaches(records(spark, orders), "orders"))
    assert {int(i) - 7000 for i, _, reason in got if reason == "type"} >= {3, 4, 5, 6, 9}
    assert {int(i) - 7000 for i, _, _ in got if i}.isdisjoint({1, 2, 7})
    times = [dict(PROMO, id=str(k), startAt=t) for k, t in enumerate(("2022-06-01T00:00:00+02:00", "2022-06-01", "soon", 5))]
    assert found(CT.record_breaches(records(spark, times), "campaigns")) == {("2", "startAt", "type"), ("3", "startAt", "type")}
    first = CT.typed_records(records(spark, times), "campaigns").where("id = '0'").first()
    assert first.startAt.isoformat() == "2022-05-31T22:00:00" and first.endAt is None


def test_roots_of_records(spark):
    rows = ["[1, 2]", "7", '"text"', "null", "{broken", json.dumps(_order(1))]
    assert found(CT.record_breaches(records(spark, rows), "orders")) == {(None, "", "type"), (None, "", "syntax")}
    counts = {r.rule: r.n_violations for r in CT.breach_counts(CT.record_breaches(records(spark, rows), "orders")).collect()}
    assert counts == {"type:": 4, "syntax:": 1}
    assert CT.record_breaches(records(spark, []), "orders").count() == 0


def test_typed_records_and_typed_rows_agree(spark):
    """What is missing in typed rows is what VARIANT records breach, lists aside."""
    bad = [_order(1, line_items=[without(_item(4), "title"), _item(5, campaign_discounts=[without(DISCOUNT, "campaignName")])]),
           without(_order(2), "currency"), _order(3, order_campaigns=[without(DISCOUNT, "discountAmount")])]
    variant = records(spark, bad)
    typed = EX.read_entity(spark, _lines(bad), "orders")
    assert ({(i, p) for i, p, _ in found(CT.record_breaches(variant, "orders"))}
            == {(i, p) for i, p, _ in found(CT.row_breaches(typed.drop("customer_email"), "orders"))})
    assert ({(i, p) for i, p, _ in found(CT.row_breaches(CT.typed_records(variant, "orders"), "orders"))}
            == {(i, p) for i, p, _ in found(CT.record_breaches(variant, "orders"))})
    assert "customer_email" not in CT.typed_records(variant, "orders").columns


def _strict(spark, orders, shop=(SHOP,), campaigns=(PROMO,), variant=True):
    read = records if variant else None
    if variant:
        return build_clean_frames(read(spark, orders), read(spark, campaigns), read(spark, shop))
    return build_clean_frames(*(EX.read_entity(spark, _lines(rows), name) for rows, name in
                                ((orders, "orders"), (campaigns, "campaigns"), (shop, "shop"))))


GOOD = [o for o in MINIMAL["orders"] if o.get("line_items", []) is not None]


@pytest.mark.parametrize("variant", [True, False])
@pytest.mark.parametrize("orders, shop, match", [
    ([_order(8, applied_campaigns=[{"campaignId": "x"}])], [SHOP], "campaignName|campaignType|discountAmount"),
    (GOOD, ['{"id":"a"}', '{"id":"a"}', "no json"], "shop"),
    (GOOD, [SHOP, SHOP], "single:record"),
    (GOOD, [without(SHOP, "planName")], "planName"),
    (["[1]"], [SHOP], "type:|record"),
])
def test_strict_intake_raises(spark, orders, shop, match, variant):
    with pytest.raises(ValueError, match=match):
        _strict(spark, [*GOOD, *orders], shop, variant=variant)


def test_strict_intake_of_variant_records(spark):
    clean = _strict(spark, GOOD)
    assert {n: df.count() for n, df in clean.frames().items()} == {"orders": 4, "lineitems": 3, "campaigns": 1, "shop": 1}
    assert clean.observed["orders"] == {"records": 4, "rejected": 0} and clean.breaches.count() == 0
    item = clean.lineitems.where("active_campaign_id IS NOT NULL").first()
    assert item.active_campaign_ids == ["p-9"] and item.campaign_discounts[0].discountAmount == 1.5
    typed = _strict(spark, GOOD, variant=False)
    for name, df in clean.frames().items():
        other = typed.frames()[name].select(*df.columns)
        assert df.schema.simpleString() == other.schema.simpleString()
        assert sorted(map(repr, df.collect())) == sorted(map(repr, other.collect()))
    clean.close()
    typed.close()


@pytest.mark.parametrize("text, root", [
    ('[{"shop": {}, "campaigns": [], "orders": []}]', "array"), ("7", "scalar"), ("", "empty"), (" \n", "empty"),
    ('{"shop": {}, "campaigns": [], "orders": []} {"shop": 1}', "text"), ('{"shop"', "text"),
])
def test_documents_that_are_no_object(spark, text, root):
    path = os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), "export.json")
    with open(path, "w") as fh:
        fh.write(text)
    with pytest.raises(ValueError, match=root):
        EX.read_export_document(spark, path)


def test_folder_with_one_empty_document(spark):
    folder = tempfile.mkdtemp(prefix="promolift-test-")
    for name, text in (("a b.json", json.dumps(MINIMAL)), ("empty.json", "")):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    assert {os.path.basename(r.file): r.root for r in EX.document_roots(spark, folder).collect()} == {
        "a%20b.json": "object", "empty.json": "empty"}
    with pytest.raises(ValueError, match="empty.json"):
        EX.read_export_document(spark, folder)
