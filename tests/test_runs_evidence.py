"""Baseline runs, order without windows per group, segment evidence, the single
result document, and counts observed in the writing pass."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from promolift.functions.ordered import with_previous
from promolift.operators import campaigns as CE
from promolift.operators import segments as S
from promolift.operators import validate as V
from promolift.sources import sinks as SK

LINES = "order_id long, product_id long, quantity long, line_margin_alloc decimal(28,6), createdAt timestamp, active_campaign_id string"


@pytest.mark.parametrize("parts", [1, 7])
def test_previous_in_a_hot_group(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", v) for v in rng.sample(range(5000), 900)] + [(f"g{i % 40}", v) for i, v in enumerate(rng.sample(range(5000), 200))]
    rows += [(None, 5), (None, 9)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "g string, v long").repartition(parts)
        got = sorted((r.g or "", r.v, r.p) for r in with_previous(df, ["g"], "v", "p").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = [], {}
    for g, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.append((g or "", v, last.get(g)))
        last[g] = v
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_expand_to_the_baseline(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        order = rng.randrange(90)
        rows.append((order, rng.choice([1, 1, 1, 1, 2, 3, 4]), rng.randrange(1, 4), None, f"2024-01-{1 + order % 27:02d} 00:00:00",
                     rng.choice([None, None, None, "a", "b"])))
    lines = spark.createDataFrame(rows, LINES.replace("decimal(28,6)", "string").replace("timestamp", "string")).select(
        *[F.col(c).cast(t) for c, t in (x.split(" ") for x in LINES.split(", "))])
    lines = lines.withColumn("line_margin_alloc", F.col("quantity").cast("decimal(28,6)"))
    attributed = lines.where("active_campaign_id IS NOT NULL").withColumn("campaign_id", F.col("active_campaign_id"))
    ranked = CE.ranked_organic(lines)
    runs = CE.baseline_runs(attributed, ranked)
    def listed(df):
        return sorted(repr(tuple(r)) for r in df.select("campaign_id", *CE.LINE_COLS).collect())
    assert listed(CE.expand_runs(runs, ranked, lines)) == listed(CE.baseline_lines(attributed, lines)) != []
    found = sorted((r.campaign_id, r.product_id, r.first_rank, r.last_rank) for r in runs.collect())
    for a, b in zip(found, found[1:]):   # runs of one product don't touch
        assert a[:2] != b[:2] or a[3] + 1 < b[2]
    assert all(a <= b for _, _, a, b in found)


def test_segment_evidence_is_bounded(spark):
    recs = spark.createDataFrame(
        [(i, f"t{i}", "fast", "high", "BXGY", float(i % 3), 1 if i % 2 else 2) for i in range(40)]
        + [(100, "x", "slow", "low", "Collect more data", 0.3, None)],
        "product_id long, title string, movement_class string, margin_band string, recommended_mechanic string, "
        "priority_score double, policy_id int")
    refs = spark.createDataFrame([(1, 3, "campaign:c"), (1, 1, "campaign:a"), (2, 2, "campaign:b"), (2, 3, "campaign:c"), (9, 0, "campaign:z")],
                                 "policy_id int, pos long, ref string")
    out = S.segment_evidence(recs, refs, 2)
    got = {r.segment_id: (r.product_ids, r.evidence_refs) for r in out.collect()}
    assert got == {"fast/high/BXGY": ([2, 5], ["product:2:2.0", "product:5:2.0", "campaign:a", "campaign:b"]),
                   "slow/low/Collect more data": ([100], ["product:100:0.3"])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2   # ranks are limited before the shuffle


def test_segment_evidence_contract(spark):
    rows = [("BXGY", 1, 3, "s1", "l", "r", "impact", [1], ["x"]), ("BXGY", 1, 3, "s1", "l", "r", None, [], None),
            ("BXGY", 1, 3, "s1", "l", "r", "impact", [None], ["a", None])]
    seg = spark.createDataFrame(rows, "discount_mechanic string, priority int, n_products long, segment_id string, segment_label string, "
                                      "rationale string, expected_impact string, product_ids array<long>, supporting_evidence_refs array<string>")
    c = {r.rule: r.n_violations for r in V.violation_counts(seg, "segments", V.segment_evidence_rules()).collect() if r.n_violations}
    assert c == {"required:expected_impact": 1, "non_empty:product_ids": 2, "non_empty:supporting_evidence_refs": 2}


def test_document_of_checked_size(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="promolift-test-"), "doc")
    sections = {"a": spark.createDataFrame([(2, 'q"uote\n', float("nan")), (1, "é", 1.5)], "k long, s string, x double"),
                "none": spark.createDataFrame([], "k long")}
    size = SK.write_document(sections, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    text = open(os.path.join(path, files[0]), encoding="utf-8").read()
    assert len(files) == 1 and size >= len(text.encode()) - 1
    assert json.loads(text) == {"a": [{"k": 1, "s": "é", "x": 1.5}, {"k": 2, "s": 'q"uote\n', "x": None}], "none": []}
    back = SK.read_document(spark, path, {n: df.schema for n, df in sections.items()})
    assert sorted((r.k, r.s) for r in back["a"].collect()) == [(1, "é"), (2, 'q"uote\n')] and back["none"].count() == 0
    other = path + "-other"
    with pytest.raises(ValueError, match="bundle"):
        SK.write_document(sections, other, max_bytes=20)
    assert not os.path.exists(other)


def test_observed_counts_of_both_intakes(spark):
    from promolift.operators import flatten as FL
    from promolift.plans.pipeline import PromoPipeline
    from promolift.schemas import CAMPAIGN, ORDER
    from test_intake import _item, _lines, _order
    from promolift.sources import export as EX

    orders = [_order(1, line_items=[_item(1), _item(2, total_discount=99.0)]), _order(2, line_items=[_item(1, total_discount=31.5)]),
              _order(3, line_items=[_item(1, total_discount=50.0), _item(2, total_discount=50.0)]), _order(4)]
    nested = EX.read_entity(spark, _lines(orders), "orders").drop("record_ok")
    camps = spark.createDataFrame([], CAMPAIGN)
    assert nested.columns == ORDER.names
    runs = [PromoPipeline.from_nested_orders(nested, camps),
            PromoPipeline(FL.to_lineitems(nested.drop("customer_email")), FL.to_orders(nested.drop("customer_email")), camps)]
    for p in runs:
        assert p.line_margin.count() == 5
        assert p.observed == {"lines": 5, "clipped_lines": 3, "orders": 3, "zero_revenue_orders": 2}
        assert "first_line" not in p.outputs()["lineitems_clean"].columns if p is runs[0] else True
        p.close()
