"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's test tables through the stand-in adapter and
runs the library operators on the whole tables. ``present`` only fixes output
types (exact decimals -> DOUBLE, zoned timestamps -> wall-clock) so results
compare cleanly with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import campaigns as CE
from ..operators import contracts as CT
from ..operators import flatten as FL
from ..operators import privacy as PV
from ..operators import validate as V
from ..operators import classify as C
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import segments as S
from ..session import staging_path
from ..sources import export as EX
from ..sources import sinks as SK
from ..sources import testtables as tt
from .intake import build_clean_frames
from .pipeline import PromoPipeline

MIN_UNITS_DEFAULT = 500

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    """Register a query. Timestamps are UTC instants, days are UTC days, and
    ``present`` shows UTC wall clock: results don't depend on the session's zone."""
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def present(df: DataFrame) -> DataFrame:
    """DECIMAL -> DOUBLE, TIMESTAMP -> TIMESTAMP_NTZ (UTC wall clock)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast(T.DoubleType())
        elif isinstance(f.dataType, T.TimestampType):
            seconds = (F.unix_micros(c).cast(T.DecimalType(18, 0)) * F.lit(Decimal("0.000001"))).cast(T.DecimalType(18, 6))
            c = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# -- shared building blocks ---------------------------------------------------

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.shop_lines(spark, sf_dir)


def affinity_input(spark, sf_dir) -> DataFrame:
    """Stand-in affinity table: products whose part type is PROMO."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    return part.where(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("product_id"))


def pipe(spark: SparkSession, sf_dir: str, with_affinity: bool = False) -> PromoPipeline:
    """A fresh pipeline over the whole stand-in shop (stages computed once per query)."""
    aff = affinity_input(spark, sf_dir) if with_affinity else None
    return PromoPipeline(tt.shop_lines(spark, sf_dir), tt.shop_orders(spark, sf_dir),
                         tt.shop_campaigns(spark), min_units=MIN_UNITS_DEFAULT, affinity=aff)


# -- D: metrics ---------------------------------------------------------------

@register("line_revenue")
def q_line_revenue(spark, sf_dir):
    return present(M.compute_line_revenue(lines(spark, sf_dir)).select(
        "order_id", "product_id", "quantity", "price", "total_discount", "line_gross_revenue",
        "line_net_revenue", "net_clipped"))


@register("order_net_revenue")
def q_order_net_revenue(spark, sf_dir):
    return present(M.order_net_revenue(M.compute_line_revenue(lines(spark, sf_dir))))


@register("allocated_cost")
def q_allocated_cost(spark, sf_dir):
    alloc = M.allocate_order_cost_to_lines(M.compute_line_revenue(lines(spark, sf_dir)))
    return present(alloc.select("order_id", "product_id", "quantity", "cost_total", "line_net_revenue",
                                "allocated_cost"))


@register("zero_revenue_orders")
def q_zero_revenue_orders(spark, sf_dir):
    return present(M.zero_revenue_orders(M.compute_line_revenue(lines(spark, sf_dir))))


def clearance_lines(spark, sf_dir) -> DataFrame:
    """Stand-in lines in which orders of status P are given away: their discounts
    are twice the gross, so revenue is clipped and whole orders have none."""
    free = (spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").where("o_orderstatus = 'P'")
            .select(F.col("o_orderkey").alias("order_id"), F.lit(True).alias("_free")))
    gross = (F.col("quantity").cast(T.DecimalType(6, 0)) * F.col("price") * 2).cast(T.DecimalType(18, 4))
    return lines(spark, sf_dir).join(free, "order_id", "left").withColumn(
        "total_discount", F.when(F.col("_free"), gross).otherwise(F.col("total_discount"))).drop("_free")


@register("clearance_line_revenue")
def q_clearance_line_revenue(spark, sf_dir):
    """Line revenue where discounts exceed the gross and the clip applies."""
    return present(M.compute_line_revenue(clearance_lines(spark, sf_dir)).select(
        "order_id", "product_id", "quantity", "total_discount", "line_gross_revenue", "line_net_revenue", "net_clipped"))


@register("clearance_zero_revenue_orders")
def q_clearance_zero_revenue_orders(spark, sf_dir):
    return present(M.zero_revenue_orders(M.compute_line_revenue(clearance_lines(spark, sf_dir))))


@register("clearance_allocated_cost")
def q_clearance_allocated_cost(spark, sf_dir):
    """Cost allocation with orders that have no revenue to share it by."""
    alloc = M.allocate_order_cost_to_lines(M.compute_line_revenue(clearance_lines(spark, sf_dir)))
    return present(alloc.select("order_id", "product_id", "quantity", "line_net_revenue", "allocated_cost"))


@register("observed_counts")
def q_observed_counts(spark, sf_dir):
    """Lines, clipped lines, orders and orders without revenue, observed while
    the line margins of the clearance shop are written."""
    p = PromoPipeline(clearance_lines(spark, sf_dir), tt.shop_orders(spark, sf_dir), tt.shop_campaigns(spark))
    p.line_margin.schema   # the pass that counts
    return spark.createDataFrame(sorted(p.observed.items()), "metric string, n bigint")


@register("line_margin")
def q_line_margin(spark, sf_dir):
    lm = M.prepare_line_margin(lines(spark, sf_dir))
    return present(lm.select("order_id", "product_id", "quantity", "line_net_revenue", "allocated_cost",
                             "line_margin_alloc", "active_campaign_id"))


@register("dataset_window")
def q_dataset_window(spark, sf_dir):
    return present(M.dataset_window(lines(spark, sf_dir)))


@register("product_metrics")
def q_product_metrics(spark, sf_dir):
    return present(pipe(spark, sf_dir).products_plan)


@register("products_by_velocity")
def q_products_by_velocity(spark, sf_dir):
    ranked = M.products_by_velocity(pipe(spark, sf_dir).products_plan)
    return present(ranked.select("product_id", "title", "units_sold", "velocity_per_day"))


# -- E: classification ----------------------------------------------------------

def classified(spark, sf_dir) -> DataFrame:
    return pipe(spark, sf_dir).classified


def sufficient_products(spark, sf_dir) -> DataFrame:
    return C.with_sufficiency(pipe(spark, sf_dir).products, MIN_UNITS_DEFAULT).where(F.col("data_sufficient"))


@register("classify_products")
def q_classify_products(spark, sf_dir):
    return present(pipe(spark, sf_dir).classified_plan)


@register("class_counts")
def q_class_counts(spark, sf_dir):
    return C.class_counts(classified(spark, sf_dir))


@register("classify_rank_fallback")
def q_classify_rank_fallback(spark, sf_dir):
    """The rank-based tertile method applied to all sufficient products."""
    return present(C.assign_tertiles_rank(sufficient_products(spark, sf_dir)))


@register("classify_identical")
def q_classify_identical(spark, sf_dir):
    """Branch chooser: counts, identical/repeated-edge flags and chosen method."""
    return C.classification_plan(sufficient_products(spark, sf_dir))


@register("classify_few")
def q_classify_few(spark, sf_dir):
    """Arg-max used when fewer than three products are sufficient."""
    return C.top_velocity_product(sufficient_products(spark, sf_dir))


# -- F: campaign evaluation ------------------------------------------------------

def campaign_eval(spark, sf_dir) -> DataFrame:
    return pipe(spark, sf_dir).campaign_eval


def campaign_measures(spark, sf_dir) -> DataFrame:
    p = pipe(spark, sf_dir)
    return CE.with_verdicts(CE.campaign_measures(p.line_margin, p.orders, p.campaigns))


@register("order_campaign_pairs")
def q_order_campaign_pairs(spark, sf_dir):
    return CE.order_campaign_pairs(tt.shop_orders(spark, sf_dir))


@register("attributed_lines")
def q_attributed_lines(spark, sf_dir):
    p = pipe(spark, sf_dir)
    return present(CE.attributed_lines(p.line_margin, p.orders, p.campaigns))


@register("baseline_lines")
def q_baseline_lines(spark, sf_dir):
    p = pipe(spark, sf_dir)
    return present(CE.baseline_lines(CE.attributed_lines(p.line_margin, p.orders, p.campaigns), p.line_margin))


@register("baseline_runs")
def q_baseline_runs(spark, sf_dir):
    """Every campaign's baseline as runs of time ranks within products."""
    p = pipe(spark, sf_dir)
    return CE.baseline_runs(CE.attributed_lines(p.line_margin, p.orders, p.campaigns), CE.ranked_organic(p.line_margin))


@register("baseline_expanded")
def q_baseline_expanded(spark, sf_dir):
    """The runs of two campaigns expanded to their baseline lines."""
    p = pipe(spark, sf_dir)
    ranked = CE.ranked_organic(p.line_margin)
    runs = CE.baseline_runs(CE.attributed_lines(p.line_margin, p.orders, p.campaigns), ranked)
    return present(CE.expand_runs(runs.where(F.col("campaign_id").isin("k4", "k7")), ranked, p.line_margin))


@register("campaign_windows")
def q_campaign_windows(spark, sf_dir):
    return campaign_measures(spark, sf_dir).select("campaign_id", "window_days", "baseline_days")


@register("campaign_aggregates")
def q_campaign_aggregates(spark, sf_dir):
    return present(campaign_measures(spark, sf_dir).select(
        "campaign_id", "attributed_orders", "campaign_units", "baseline_units",
        "campaign_margin_total", "baseline_margin_total"))


@register("shipping_impact")
def q_shipping_impact(spark, sf_dir):
    p = pipe(spark, sf_dir)
    att = CE.attributed_lines(p.line_margin, p.orders, p.campaigns)
    return present(CE.shipping_impact(att, p.orders, p.campaigns))


@register("campaign_rates")
def q_campaign_rates(spark, sf_dir):
    return campaign_measures(spark, sf_dir).select(
        "campaign_id", "campaign_margin_per_day", "baseline_margin_per_day", "campaign_velocity",
        "baseline_velocity", "units_lift")


@register("campaign_sufficiency")
def q_campaign_sufficiency(spark, sf_dir):
    return campaign_measures(spark, sf_dir).select(
        "campaign_id", F.array_join("sufficiency_failures", "|").alias("sufficiency_failures"),
        (F.size("sufficiency_failures") == 0).alias("is_sufficient"))


@register("campaign_eval")
def q_campaign_eval(spark, sf_dir):
    return present(pipe(spark, sf_dir).campaign_eval_plan)


@register("verdict_counts")
def q_verdict_counts(spark, sf_dir):
    return CE.verdict_counts(campaign_eval(spark, sf_dir))


# -- G: recommendation rules -------------------------------------------------------

def recommendations(spark, sf_dir, with_affinity: bool = False) -> DataFrame:
    return pipe(spark, sf_dir, with_affinity).recommendations


def present_recs(df: DataFrame) -> DataFrame:
    return present(df.withColumn("evidence_refs", F.array_join("evidence_refs", ";")))


def banded(spark, sf_dir) -> DataFrame:
    return pipe(spark, sf_dir).banded


def policy_table(spark, sf_dir) -> DataFrame:
    return pipe(spark, sf_dir).policy


@register("recommendations")
def q_recommendations(spark, sf_dir):
    return present_recs(recommendations(spark, sf_dir))


@register("recommend_with_affinity")
def q_recommend_with_affinity(spark, sf_dir):
    return present_recs(recommendations(spark, sf_dir, with_affinity=True))


@register("campaign_evidence")
def q_campaign_evidence(spark, sf_dir):
    ev = R.campaign_evidence(campaign_eval(spark, sf_dir))
    return ev.select(*[F.array_join(c, "|").alias(c) for c in
                       ("success_types", "flop_types", "inconclusive_types")],
                     "shipping_roi_positive", "order_discount_flopped", "volume_lift_margin_eroded",
                     "n_success", "n_flop")


@register("margin_bands")
def q_margin_bands(spark, sf_dir):
    return banded(spark, sf_dir).select("product_id", "title", "margin_pct", "margin_band",
                                        "_margin_p33", "_margin_p67")


@register("policy_matrix")
def q_policy_matrix(spark, sf_dir):
    """Step A cells with the number of sufficient products falling in each."""
    p = pipe(spark, sf_dir)
    b, ev = p.banded, p.evidence
    counts = (b.where(F.col("data_sufficient")).groupBy("margin_band", "movement_class")
              .agg(F.count(F.lit(1)).alias("n_products")))
    base = R.base_policy(spark, ev)
    return (base.join(counts, ["margin_band", "movement_class"], "left")
            .select("margin_band", "movement_class", "base_mechanic", "margin_opportunity",
                    "base_confidence", "rationale_code",
                    F.coalesce(F.col("n_products"), F.lit(0)).cast("bigint").alias("n_products")))


@register("mechanic_vetoes")
def q_mechanic_vetoes(spark, sf_dir):
    """Veto status of every mechanic and how many products had it vetoed."""
    p = pipe(spark, sf_dir)
    ev_df = p.evidence
    policy = R.resolve_policy(R.base_policy(spark, ev_df)).where(~F.col("affinity"))
    b = p.banded.where(F.col("data_sufficient"))
    hits = (b.join(F.broadcast(policy.where(F.col("vetoed"))), ["margin_band", "movement_class"])
            .groupBy(F.col("start_mechanic").alias("mechanic")).agg(F.count(F.lit(1)).alias("n")))
    ev = R.as_scalar(ev_df)
    mechs = spark.createDataFrame([(m,) for m in R.MECHANIC_EFFORT], "mechanic string")
    return (mechs.join(hits, "mechanic", "left")
            .select("mechanic", R.mechanic_type(F.col("mechanic")).alias("campaign_type"),
                    R.is_vetoed(F.col("mechanic"), ev).alias("vetoed"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_products_vetoed")))


@register("policy_resolved")
def q_policy_resolved(spark, sf_dir):
    return policy_table(spark, sf_dir).select(
        "policy_id", "margin_band", "movement_class", "affinity", "start_mechanic", "vetoed", "recommended_mechanic",
        "margin_opportunity", "confidence_label", "confidence", "priority_score",
        F.array_join("tags", ";").alias("tags"))


@register("policy_campaign_refs")
def q_policy_campaign_refs(spark, sf_dir):
    return pipe(spark, sf_dir).policy_campaign_refs


@register("evidence_refs")
def q_evidence_refs(spark, sf_dir):
    """Each product's whole evidence, its campaigns joined on request."""
    p = pipe(spark, sf_dir)
    return R.with_campaign_refs(p.recommendations, p.policy_campaign_refs).select(
        "product_id", "title", F.array_join("evidence_refs", ";").alias("evidence_refs"),
        F.size("evidence_refs").alias("n_refs"))


@register("priority_scores")
def q_priority_scores(spark, sf_dir):
    return recommendations(spark, sf_dir).select(
        "product_id", "title", "recommended_mechanic", "margin_opportunity", "confidence_label",
        "priority_score")


@register("mechanic_counts")
def q_mechanic_counts(spark, sf_dir):
    return R.mechanic_counts(recommendations(spark, sf_dir))


@register("top_recommendations")
def q_top_recommendations(spark, sf_dir):
    return present_recs(R.top_recommendations(recommendations(spark, sf_dir), 20))


@register("campaign_mechanics")
def q_campaign_mechanics(spark, sf_dir):
    return R.campaign_mechanics(campaign_eval(spark, sf_dir))


@register("pipeline_summary")
def q_pipeline_summary(spark, sf_dir):
    """End-to-end run (ingest-flat -> metrics -> classes -> verdicts -> recommendations)."""
    return pipe(spark, sf_dir).summary()


@register("segment_proposals")
def q_segment_proposals(spark, sf_dir):
    seg = pipe(spark, sf_dir).segments()
    return seg.withColumn("supporting_evidence_refs", F.array_join("supporting_evidence_refs", ";"))


@register("segment_evidence")
def q_segment_evidence(spark, sf_dir):
    """Best products and campaigns of each segment."""
    p = pipe(spark, sf_dir)
    found = S.segment_evidence(p.kept_recommendations, p.policy_campaign_refs, 5)
    return found.select("segment_id", F.array_join("product_ids", "|").alias("product_ids"),
                        F.array_join("evidence_refs", ";").alias("evidence_refs"))


@register("segment_members")
def q_segment_members(spark, sf_dir):
    return S.segment_members(pipe(spark, sf_dir).kept_recommendations)


# -- A/B/C: intake, personal data, validation, flattening, sinks ----------------------

def export_orders(spark, sf_dir) -> DataFrame:
    """Stand-in nested export orders (ORDER schema, personal e-mail included)."""
    return tt.shop_export_orders(spark, sf_dir)


def _ids(col: str) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x["campaignId"]), "|")


@register("flatten_orders")
def q_flatten_orders(spark, sf_dir):
    orders = FL.to_orders(PV.minimize_orders(export_orders(spark, sf_dir)))
    return present(orders.withColumn("applied_campaigns", _ids("applied_campaigns"))
                   .withColumn("order_campaigns", _ids("order_campaigns")))


@register("flatten_lineitems")
def q_flatten_lineitems(spark, sf_dir):
    items = FL.to_lineitems(PV.minimize_orders(export_orders(spark, sf_dir)))
    return present(items.withColumn("active_campaign_ids", F.array_join("active_campaign_ids", "|"))
                   .withColumn("campaign_discounts", _ids("campaign_discounts")))


@register("src_export")
def q_src_export(spark, sf_dir):
    """Export orders written as JSON Lines, read back with the declared schema,
    minimized and flattened to line items."""
    path = staging_path(spark, "export-orders")
    EX.write_entity(PV.minimize_orders(export_orders(spark, sf_dir)), path, "json", "gzip")   # no e-mails on shared storage
    back = EX.read_entity(spark, path, "orders", "json")
    items = FL.to_lineitems(PV.minimize_orders(back))
    return present(items.select("order_id", "product_id", "quantity", "price", "total_discount",
                                "createdAt", "active_campaign_id"))


@register("input_positions")
def q_input_positions(spark, sf_dir):
    """Export orders written in the order of their ids as JSON Lines in many
    files, and the place of each found again while they are read in splits."""
    path = staging_path(spark, "ordered-orders")
    EX.write_entity(PV.minimize_orders(export_orders(spark, sf_dir)).orderBy("id"), path, "json", "gzip")
    return EX.read_entity(spark, path, "orders", position="pos").select(F.col("id").alias("order_id"), "pos")


@register("pii_minimize")
def q_pii_minimize(spark, sf_dir):
    """E-mail scan of every text-bearing column, nested ones as JSON text, of the
    orders before and after minimization and of the line items."""
    raw = export_orders(spark, sf_dir)
    clean = PV.minimize_orders(raw)
    return (PV.pii_value_scan(raw, "orders_raw").unionByName(PV.pii_value_scan(FL.to_orders(clean), "orders_clean"))
            .unionByName(PV.pii_value_scan(FL.to_lineitems(clean), "lineitems_clean")))


@register("pii_column_audit")
def q_pii_column_audit(spark, sf_dir):
    """Personal-data column names in the raw and cleaned order frames, with the
    value counts of each flagged column (clean frames yield no rows)."""
    raw = export_orders(spark, sf_dir)
    clean = PV.minimize_orders(raw)
    return PV.pii_column_value_audit({"orders_raw": raw,
                                      "orders_clean": FL.to_orders(clean),
                                      "lineitems_clean": FL.to_lineitems(clean)})


@register("pii_value_scan")
def q_pii_value_scan(spark, sf_dir):
    """Full e-mail scan of every text column of documents, conversations, pages."""
    out = None
    for t in ("documents", "conversations", "pages"):
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
        df = df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
        scan = PV.pii_value_scan(df, t)
        out = scan if out is None else out.unionByName(scan)
    return out


@register("validate_orders")
def q_validate_orders(spark, sf_dir):
    return V.validate_orders(PV.minimize_orders(export_orders(spark, sf_dir)))


@register("validate_lineitems")
def q_validate_lineitems(spark, sf_dir):
    return V.validate_lineitems(export_orders(spark, sf_dir))


@register("validate_breaches")
def q_validate_breaches(spark, sf_dir):
    """Order and line-item rules on stand-in records that break some of them."""
    item = lambda li: (li.withField("price", F.when(li["quantity"] != 1, li["price"]))
                       .withField("quantity", F.when(li["quantity"] == 2, F.lit(0).cast("bigint")).otherwise(li["quantity"])))
    orders = (PV.minimize_orders(export_orders(spark, sf_dir))
              .withColumn("cost_total", F.when(~F.col("is_free_shipping"), F.col("cost_total")))
              .withColumn("total_price", F.when(F.col("has_active_campaign"), -F.col("total_price")).otherwise(F.col("total_price")))
              .withColumn("line_items", F.transform("line_items", item)))
    return V.validate_orders(orders).unionByName(V.validate_lineitems(orders))


@register("ingest_clean")
def q_ingest_clean(spark, sf_dir):
    """Composite intake: minimize -> validate (strict) -> flatten -> audit of
    every frame. Returns one row per clean frame."""
    frames = build_clean_frames(export_orders(spark, sf_dir), tt.shop_campaigns(spark), tt.shop_record(spark)).frames()
    out = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("frame"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def _records(spark, text: DataFrame, name: str) -> DataFrame:
    """JSON Lines text written to a folder and read back as VARIANT records."""
    path = staging_path(spark, name)
    text.write.text(path, compression="gzip")
    return EX.read_records(spark, path)


def _breached_intake(spark, sf_dir):
    """Intake, not strict, of stand-in records that breach the contract at every level."""
    return build_clean_frames(_records(spark, tt.breached_order_text(spark, sf_dir), "breached-orders"),
                              _records(spark, tt.record_text(tt.shop_campaigns(spark).drop("campaign_pos")), "campaigns"),
                              _records(spark, tt.breached_shop_text(spark), "breached-shop"), strict=False)


@register("intake_breaches")
def q_intake_breaches(spark, sf_dir):
    """Breaches of the record contract per field and reason, found by walking
    VARIANT records: absent, null, of another type, no object, no JSON."""
    return CT.breach_counts(_breached_intake(spark, sf_dir).breaches)


@register("intake_breach_rows")
def q_intake_breach_rows(spark, sf_dir):
    """Every breach of the orders, by record and path."""
    found = _breached_intake(spark, sf_dir).breaches
    return found.where("table = 'orders' AND path LIKE 'line_items[%].%'").select("row_id", "path", "reason")


@register("ingest_report")
def q_ingest_report(spark, sf_dir):
    """What an intake reports: records read and rejected (counted while they are
    written), rows per clean frame, violated rules, text values scanned for e-mails."""
    clean = _breached_intake(spark, sf_dir)
    seen = spark.createDataFrame(
        [("observed", t, name, n) for t, counts in clean.observed.items() for name, n in counts.items()],
        "section string, table string, item string, n bigint")
    rules = clean.rule_counts.where("n_violations > 0").select(
        F.lit("rule").alias("section"), "table", F.col("rule").alias("item"), F.col("n_violations").alias("n"))
    audit = clean.audit_counts.select(
        F.lit("audit").alias("section"), "table", F.col("column").alias("item"), F.col("n_values").alias("n"))
    out = seen.unionByName(rules).unionByName(audit)
    for name, df in clean.frames().items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("frame").alias("section"), F.lit(name).alias("table"), F.lit("rows").alias("item"), "n"))
    return out


@register("product_profiles")
def q_product_profiles(spark, sf_dir):
    prof = V.product_profiles(pipe(spark, sf_dir).classified, MIN_UNITS_DEFAULT)
    ev = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")),
                                  lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return prof.withColumn("evidence", ev)


@register("contract_profiles")
def q_contract_profiles(spark, sf_dir):
    prof = V.product_profiles(pipe(spark, sf_dir).classified, MIN_UNITS_DEFAULT)
    return V.violation_counts(prof, "profiles", V.profile_rules())


@register("contract_classes")
def q_contract_classes(spark, sf_dir):
    return V.violation_counts(pipe(spark, sf_dir).classified, "classified", V.class_rules())


@register("contract_verdicts")
def q_contract_verdicts(spark, sf_dir):
    return V.violation_counts(pipe(spark, sf_dir).campaign_eval, "campaign_eval", V.verdict_rules())


@register("contract_recommendations")
def q_contract_recommendations(spark, sf_dir):
    return V.violation_counts(pipe(spark, sf_dir).kept_recommendations, "recommendations",
                              V.recommendation_rules())


@register("contract_breaches")
def q_contract_breaches(spark, sf_dir):
    """The recommendation contract on recommendations that break it by class and band."""
    moves, recs = F.col("movement_class"), pipe(spark, sf_dir).kept_recommendations
    broken = (recs.withColumn("recommended_mechanic", F.when(moves != "slow", F.col("recommended_mechanic")))
              .withColumn("confidence", F.when(moves == "fast", F.lit(1.5)).otherwise(F.col("confidence")))
              .withColumn("priority_score", F.when(moves == "medium", F.lit(float("nan"))).otherwise(F.col("priority_score")))
              .withColumn("title", F.when(F.col("margin_band") != "low", F.col("title"))))
    return V.violation_counts(broken, "recommendations", V.recommendation_rules())


@register("contract_breaches_derived")
def q_contract_breaches_derived(spark, sf_dir):
    """The profile, class, verdict and segment contracts on rows that break them."""
    p = pipe(spark, sf_dir)
    pid, kind = F.col("product_id"), F.col("type")
    classes = p.classified.withColumns({
        "movement_class": F.when(pid % 5 != 0, F.col("movement_class")).otherwise("steady"),
        "data_sufficient": F.when(pid % 7 != 0, F.col("data_sufficient"))})
    profiles = V.product_profiles(classes.withColumns({
        "title": F.when(pid % 3 != 0, F.col("title")), "margin_pct": F.when(pid % 11 != 0, F.col("margin_pct"))}), MIN_UNITS_DEFAULT)
    verdicts = p.campaign_eval.withColumns({
        "verdict": F.when(kind == "volume", "maybe").otherwise(F.col("verdict")),
        "confidence": F.when(kind == "shipping", 1.5).otherwise(F.col("confidence")),
        "reason_code": F.when(kind != "general", F.col("reason_code")),
        "window_days": F.when(kind == "order", -1).otherwise(F.col("window_days"))})
    fast, high = F.col("movement_class") == "fast", F.col("margin_band") == "high"
    segments = p.segments_with_evidence().withColumns({
        "expected_impact": F.when(~fast, F.col("expected_impact")), "priority": F.when(high, 9).otherwise(F.col("priority")),
        "product_ids": F.when(~high, F.col("product_ids")).otherwise(F.array().cast("array<bigint>")),
        "supporting_evidence_refs": F.when(fast, F.array(F.lit(None).cast("string"))).otherwise(F.col("supporting_evidence_refs")),
        "segment_label": F.when(fast | high, F.col("segment_label"))})
    return (V.violation_counts(classes, "classified", V.class_rules())
            .unionByName(V.violation_counts(profiles, "profiles", V.profile_rules()))
            .unionByName(V.violation_counts(verdicts, "campaign_eval", V.verdict_rules()))
            .unionByName(V.violation_counts(segments, "segments", V.segment_evidence_rules())))


@register("contract_segments")
def q_contract_segments(spark, sf_dir):
    return V.violation_counts(pipe(spark, sf_dir).segments(), "segments", V.segment_rules())


@register("sink_csv_roundtrip")
def q_sink_csv_roundtrip(spark, sf_dir):
    """Recommendations written as header CSV (lists as JSON text) and read back."""
    recs = pipe(spark, sf_dir).kept_recommendations
    path = staging_path(spark, "csv-recommendations")
    SK.write_csv(recs, path)
    return present(SK.read_csv(spark, path, SK.csv_schema(recs)))


@register("flatten_complex_to_json")
def q_flatten_complex_to_json(spark, sf_dir):
    orders = tt.shop_orders(spark, sf_dir).select("order_id", "applied_campaigns", "order_campaigns")
    return SK.flatten_complex_to_json(orders)


@register("json_records")
def q_json_records(spark, sf_dir):
    """Campaign evaluation serialized to JSON records and restored."""
    ce = pipe(spark, sf_dir).campaign_eval
    return present(SK.restore_records(SK.json_records(ce), ce.schema))


@register("bundle_sections")
def q_bundle_sections(spark, sf_dir):
    """Result bundle written as one JSON Lines dataset per section; counts read back."""
    p = pipe(spark, sf_dir)
    sections = {"recommendations": p.kept_recommendations, "campaign_eval": p.campaign_eval,
                "segments": p.segments()}
    paths = SK.write_bundle(sections, staging_path(spark, "bundle"))
    back = SK.read_bundle(spark, paths, {k: v.schema for k, v in sections.items()})
    out = None
    for name, df in back.items():
        row = df.agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(name).alias("section"), "n_records")
        out = row if out is None else out.unionByName(row)
    return out


@register("bundle_document")
def q_bundle_document(spark, sf_dir):
    """The results as one JSON document, read back record by record."""
    p = pipe(spark, sf_dir)
    sections = {"recommendations": p.kept_recommendations, "campaign_eval": p.campaign_eval, "segments": p.segments()}
    path = staging_path(spark, "document")
    SK.write_document(sections, path)
    back = SK.read_document(spark, path, {k: v.schema for k, v in sections.items()})

    def records(name, key, label, amount):
        return back[name].select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"),
                                 F.col(label).alias("label"), F.col(amount).cast("double").alias("amount"))

    return (records("recommendations", "product_id", "recommended_mechanic", "priority_score")
            .unionByName(records("campaign_eval", "campaign_id", "verdict", "units_lift_ratio"))
            .unionByName(records("segments", "segment_id", "discount_mechanic", "avg_confidence")))


@register("export_outputs")
def q_export_outputs(spark, sf_dir):
    """The whole run behind the strict intake, its seven tables written as CSV and
    read back: rows and a total of each."""
    p = PromoPipeline.from_export(export_orders(spark, sf_dir), tt.shop_campaigns(spark), tt.shop_record(spark),
                                  min_units=MIN_UNITS_DEFAULT)
    paths = p.write_outputs(staging_path(spark, "outputs"), "gzip")
    totals = {"orders_clean": "total_price", "lineitems_clean": "quantity", "campaigns_clean": "orderCount",
              "product_metrics": "units_sold", "product_classification": "units_sold", "campaign_eval": "attributed_orders",
              "recommendations": "priority_score"}
    out = None
    for name, df in p.outputs().items():
        back = SK.read_csv(spark, paths[name], SK.csv_schema(df))
        row = back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(totals[name]).cast("decimal(20,4)")).cast("double").alias("total"))
        row = row.select(F.lit(name).alias("table"), "n_rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


@register("stream_line_margin")
def q_stream_line_margin(spark, sf_dir):
    """Export orders as JSON Lines files, ingested by a Structured Streaming run
    (available-now trigger) into a Parquet line-margin table, read back."""
    from ..streaming.incremental import start_line_margin_ingest
    source = staging_path(spark, "stream-orders")
    EX.write_entity(PV.minimize_orders(export_orders(spark, sf_dir)), source, "json", "gzip")
    sink = staging_path(spark, "stream-line-margin")
    start_line_margin_ingest(spark, source, sink).awaitTermination()
    lm = spark.read.parquet(sink)
    return present(lm.select("order_id", "product_id", "quantity", "line_net_revenue", "allocated_cost",
                             "line_margin_alloc", "active_campaign_id"))


@register("pipeline_from_export")
def q_pipeline_from_export(spark, sf_dir):
    """End to end from nested export orders through the strict intake: minimize ->
    validate -> flatten (order revenue folded before exploding) -> audit -> metrics
    -> classes -> verdicts -> recommendations."""
    p = PromoPipeline.from_export(export_orders(spark, sf_dir), tt.shop_campaigns(spark), tt.shop_record(spark),
                                  min_units=MIN_UNITS_DEFAULT)
    return present_recs(p.recommendations)
