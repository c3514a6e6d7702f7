"""Campaign evaluation against an organic baseline, for all campaigns at once.

Per campaign c (one plan for every campaign, no per-campaign loop):

* attributed lines: lines whose active_campaign_id = c; only for campaigns
  with no such line, all lines of orders whose order_campaigns name c.
* baseline lines: lines of the products attributed to c, with no active
  campaign, in orders not attributed to c (not time-bounded).
* totals: distinct attributed orders, units, margin, first/last time; the
  day span is whole 24 h periods between first and last, plus one.
* shipping campaigns subtract the shipping discount of their distinct
  attributed orders from their margin.
* per-day rates, units-lift ratio, sufficiency failures and a verdict tree.

Scale notes: attribution is an equi-join on campaign id (campaign table is
small; Spark broadcasts it by size) and an order-id join for the order-level
fallback. The evaluation never materializes the baseline line set (one row
per campaign and organic line of a touched product, i.e. campaigns x lines
for shop-wide campaigns): ``baseline_totals`` gets the same sums by
subtraction and the first/last times from within-product ranks, in work
linear in organic plus attributed lines. ``baseline_lines`` (the explicit set)
remains for inspection; ``baseline_runs`` is the same set as runs of ranks, in
linear size. Every aggregate is a hash aggregate with map-side
partial sums, and count-distinct of orders shuffles on (campaign, order), so a
hot campaign never lands its raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.ordered import with_previous
from ..functions.columns import MONEY, as_double, elapsed_day_span, round_money
from ..session import materialize
from ..schemas import (CAP_SHIPPING_BELOW, CAP_SHIPPING_FLOP, CAP_SHIPPING_SUCCESS, CONF_BASELINE_ZERO,
                       CONF_BELOW_THRESHOLD, CONF_FLOP, CONF_INSUFFICIENT, CONF_MARGIN,
                       CONF_MARGIN_AND_VOLUME, CONF_MARGIN_NO_VOLUME, FAIL_BASELINE_RATE,
                       FAIL_BASELINE_VELOCITY, FAIL_CAMPAIGN_RATE, FAIL_NO_ORDERS, MIN_BASELINE_DAYS,
                       MIN_BASELINE_UNITS, MIN_CAMPAIGN_DAYS, MIN_CAMPAIGN_UNITS, PROFIT_LIFT,
                       REASON_BASELINE_ZERO, REASON_BELOW_THRESHOLD, REASON_EROSION, REASON_INSUFFICIENT,
                       REASON_MARGIN, REASON_MARGIN_AND_VOLUME, REASON_MARGIN_NO_VOLUME,
                       REASON_SHIPPING_SUFFIX, REASON_VOLUME_ERODED, UNITS_LIFT)

LINE_COLS = ("order_id", "product_id", "quantity", "line_margin_alloc", "createdAt",
             "active_campaign_id")


def _campaign_keys(campaigns: DataFrame) -> DataFrame:
    # only used on the right of semi-joins, where duplicate keys are harmless
    return campaigns.select(F.col("id").alias("campaign_id"), F.col("type").alias("campaign_type"))


def order_campaign_pairs(orders: DataFrame) -> DataFrame:
    """Distinct (campaign_id, order_id) from each order's order_campaigns list."""
    return (orders.select("order_id", F.explode("order_campaigns").alias("oc"))
            .select(F.col("oc.campaignId").alias("campaign_id"), "order_id")
            .where(F.col("campaign_id").isNotNull())
            .distinct())


def line_level_hits(line_margin: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Lines whose active_campaign_id names a campaign of the table (F1)."""
    keys = _campaign_keys(campaigns).select("campaign_id")
    return (line_margin.select(*LINE_COLS).where(F.col("active_campaign_id").isNotNull())
            .withColumn("campaign_id", F.col("active_campaign_id"))
            .join(keys, "campaign_id", "left_semi"))


def attributed_lines(line_margin: DataFrame, orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(campaign_id, line columns) for every attributed line (F1 + F3)."""
    lines = line_margin.select(*LINE_COLS)
    keys = _campaign_keys(campaigns).select("campaign_id")
    by_line = line_level_hits(line_margin, campaigns)
    with_line_hits = by_line.select("campaign_id").distinct()
    fallback = (order_campaign_pairs(orders)
                .join(keys, "campaign_id", "left_semi")
                .join(with_line_hits, "campaign_id", "left_anti"))
    by_order = lines.join(fallback, "order_id")
    cols = ["campaign_id", *LINE_COLS]
    return by_line.select(*cols).unionByName(by_order.select(*cols))


def baseline_lines(attributed: DataFrame, line_margin: DataFrame) -> DataFrame:
    """(campaign_id, line columns) of each campaign's organic baseline (F4)."""
    products = attributed.select("campaign_id", "product_id").distinct()
    orders = attributed.select("campaign_id", "order_id").distinct()
    organic = line_margin.select(*LINE_COLS).where(F.col("active_campaign_id").isNull())
    return (organic.join(products, "product_id")
            .join(orders, ["campaign_id", "order_id"], "left_anti")
            .select("campaign_id", *LINE_COLS))


def rank_within_product(organic_po: DataFrame, staged: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (1-based, by createdAt then order_id) within each product.

    One global range sort on (product_id, createdAt, order_id): a hot product
    spreads over many range partitions. Row ids are increasing in sort order;
    a small table of (partition, product) first ids and counts turns them
    into ranks (no window partitioned by product, so no single-task product).
    """
    # ids are stamped once and written, so both reads below see the same ids
    ordered = materialize(organic_po.orderBy("product_id", "createdAt", "order_id")
                          .withColumn("_rid", F.monotonically_increasing_id())
                          .withColumn("_part", F.spark_partition_id()), "organic-sorted", staged)
    runs = ordered.groupBy("_part", "product_id").agg(F.min("_rid").alias("_first"),
                                                     F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("product_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (ordered.join(runs.select("_part", "product_id", "_first", "_offset"), ["_part", "product_id"])
            .withColumn("rank", (F.col("_offset") + F.col("_rid") - F.col("_first") + 1).cast(T.LongType()))
            .drop("_rid", "_part", "_first", "_offset"))


def ranked_organic(line_margin: DataFrame, staged: list[str] | None = None) -> DataFrame:
    """Organic lines added up by (product, order, time): units u, margin m, lines
    k, and the rank in time within the product. Written once."""
    organic_po = (line_margin.where(F.col("active_campaign_id").isNull())
                  .groupBy("product_id", "order_id", "createdAt")
                  .agg(F.sum("quantity").alias("u"), F.sum("line_margin_alloc").alias("m"),
                       F.count(F.lit(1)).alias("k")))
    return materialize(rank_within_product(organic_po, staged), "organic-ranked", staged)


def baseline_runs(attributed: DataFrame, ranked: DataFrame, staged: list[str] | None = None) -> DataFrame:
    """(campaign_id, product_id, first_rank, last_rank): each campaign's baseline
    as runs of ranks in ``ranked`` (``ranked_organic``). A run ends where an order
    of the campaign's own interrupts it.

    There are at most as many runs as touched products plus attributed organic
    rows, whatever the number of baseline lines: linear where ``baseline_lines``
    is campaigns x lines. Gaps are found with the previous excluded rank in a
    global sort, so a product that a campaign sold very often is no one task's."""
    cp = ["campaign_id", "product_id"]
    touched = attributed.select(*cp).distinct().join(
        ranked.groupBy("product_id").agg(F.max("rank").alias("n_rank")), "product_id")
    own = attributed.select("campaign_id", "order_id").distinct()
    excluded = (ranked.select("product_id", "order_id", "rank").join(own, "order_id")
                .join(attributed.select(*cp).distinct(), cp, "left_semi").select(*cp, "rank"))
    marked = with_previous(excluded, cp, "rank", "previous_rank", staged)
    between = marked.select(*cp, (F.coalesce("previous_rank", F.lit(0)) + 1).alias("first_rank"), (F.col("rank") - 1).alias("last_rank"))
    after = (touched.join(marked.groupBy(*cp).agg(F.max("rank").alias("_last")), cp, "left")
             .select(*cp, (F.coalesce("_last", F.lit(0)) + 1).alias("first_rank"), F.col("n_rank").alias("last_rank")))
    runs = between.unionByName(after).where(F.col("first_rank") <= F.col("last_rank"))
    return runs.select(*cp, F.col("first_rank").cast(T.LongType()), F.col("last_rank").cast(T.LongType()))


def expand_runs(runs: DataFrame, ranked: DataFrame, line_margin: DataFrame) -> DataFrame:
    """The baseline lines behind ``runs`` (of the campaigns asked for), as
    ``baseline_lines`` gives them."""
    ranks = runs.select("campaign_id", "product_id", F.explode(F.sequence("first_rank", "last_rank")).alias("rank"))
    at = ranks.join(ranked.select("product_id", "rank", "order_id", "createdAt"), ["product_id", "rank"]).select(
        "campaign_id", F.col("product_id").alias("_p"), F.col("order_id").alias("_o"), F.col("createdAt").alias("_t"))
    organic = line_margin.select(*LINE_COLS).where(F.col("active_campaign_id").isNull())
    same = (F.col("product_id").eqNullSafe(F.col("_p")) & F.col("order_id").eqNullSafe(F.col("_o"))
            & F.col("createdAt").eqNullSafe(F.col("_t")))
    return organic.join(at, same).select("campaign_id", *LINE_COLS)


def baseline_totals(attributed: DataFrame, line_margin: DataFrame, staged: list[str] | None = None) -> DataFrame:
    """Per campaign: baseline units, margin, line count, first/last time --
    the same numbers as aggregating ``baseline_lines`` -- without emitting one
    row per (campaign, organic line).

    * sums: organic totals of the campaign's products minus the organic lines
      of those products inside the campaign's own orders;
    * first/last: organic (product, order, time) rows ranked by time within
      product, so that an order id with several times counts at each of them;
      for each (campaign, product) the first surviving rank is the smallest
      positive integer not among the excluded ranks (candidates 1 and r+1,
      minus the excluded set), the last one symmetrically from the end; the
      time is looked up at that rank.
    Work is linear in organic lines plus attributed lines.
    """
    ranked = ranked_organic(line_margin, staged)   # read three times below
    pairs_cp = attributed.select("campaign_id", "product_id").distinct()
    # totals of the products of each campaign; read twice below
    per_product = materialize(pairs_cp.join(ranked.groupBy("product_id").agg(
        F.sum("u").alias("u"), F.sum("m").alias("m"), F.sum("k").alias("k"),
        F.max("rank").alias("n_rank")), "product_id"), "campaign-products", staged)
    pairs_co = attributed.select("campaign_id", "order_id").distinct()
    # organic (product, order) rows of touched products inside the campaign's own orders
    # (read three times below)
    excluded = materialize(ranked.join(pairs_co, "order_id")
                           .join(pairs_cp, ["campaign_id", "product_id"], "left_semi")
                           .select("campaign_id", "product_id", "rank", "u", "m", "k"), "campaign-excluded", staged)

    zero = F.lit(0).cast(MONEY)
    gross = per_product.groupBy("campaign_id").agg(
        F.sum("u").alias("gu"), F.sum("m").alias("gm"), F.sum("k").alias("gk"))
    minus = excluded.groupBy("campaign_id").agg(
        F.sum("u").alias("xu"), F.sum("m").alias("xm"), F.sum("k").alias("xk"))
    sums = gross.join(minus, "campaign_id", "left").select(
        "campaign_id",
        (F.col("gu") - F.coalesce(F.col("xu"), F.lit(0))).cast(T.LongType()).alias("baseline_units"),
        (F.col("gm") - F.coalesce(F.col("xm"), zero)).alias("baseline_margin"),
        (F.col("gk") - F.coalesce(F.col("xk"), F.lit(0))).cast(T.LongType()).alias("baseline_lines"))

    ex_ranks = excluded.select("campaign_id", "product_id", "rank")
    cp = ["campaign_id", "product_id"]

    def either(first: Column, last: Column) -> Column:
        """Two rows from one: a rank for the first time (lo) and one for the last."""
        return F.inline(F.array(F.struct(first.cast(T.LongType()).alias("rank"), F.lit(True).alias("lo")),
                                F.struct(last.cast(T.LongType()).alias("rank"), F.lit(False).alias("lo"))))

    # candidates for the first surviving rank (lo: 1 and r+1) and the last (hi: n and r-1),
    # searched together: drop excluded ranks, then min over lo / max over hi
    candidates = (per_product.select(*cp, either(F.lit(1), F.col("n_rank")))
                  .unionByName(ex_ranks.select(*cp, either(F.col("rank") + 1, F.col("rank") - 1))))
    bounds = (candidates.join(ex_ranks, [*cp, "rank"], "left_anti").groupBy(*cp)
              .agg(F.min(F.when(F.col("lo"), F.col("rank"))).alias("r_lo"),
                   F.max(F.when(~F.col("lo"), F.col("rank"))).alias("r_hi")))
    targets = bounds.select(*cp, either(F.col("r_lo"), F.col("r_hi")))
    times = ranked.select("product_id", "rank", "createdAt")
    # a rank past the product's end (all excluded) or 0 finds no row
    ends = (targets.join(times, ["product_id", "rank"]).groupBy("campaign_id")
            .agg(F.min(F.when(F.col("lo"), F.col("createdAt"))).alias("baseline_first"),
                 F.max(F.when(~F.col("lo"), F.col("createdAt"))).alias("baseline_last")))
    return sums.join(ends, "campaign_id", "left")


def _totals(df: DataFrame, prefix: str, with_orders: bool) -> DataFrame:
    aggs = [F.sum("quantity").cast(T.LongType()).alias(f"{prefix}_units"),
            F.sum("line_margin_alloc").alias(f"{prefix}_margin"),
            F.min("createdAt").alias(f"{prefix}_first"),
            F.max("createdAt").alias(f"{prefix}_last"),
            F.count(F.lit(1)).alias(f"{prefix}_lines")]
    if with_orders:
        aggs.insert(0, F.countDistinct("order_id").alias("attributed_orders"))
    return df.groupBy("campaign_id").agg(*aggs)


def shipping_impact(attributed: DataFrame, orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(campaign_id, shipping_cost_impact) for shipping campaigns: the shipping
    discount summed over distinct attributed orders (order grain, each order
    once; duplicate order rows resolved to the earliest, then smallest)."""
    shipping = _campaign_keys(campaigns).where(F.col("campaign_type") == "shipping").select("campaign_id")
    pairs = attributed.select("campaign_id", "order_id").distinct().join(shipping, "campaign_id", "left_semi")
    one_per_order = (orders.groupBy("order_id")
                     .agg(F.min(F.struct(F.col("createdAt"), F.col("shipping_discount_amount").cast(MONEY)
                                         .alias("amt"))).alias("o"))
                     .select("order_id", F.col("o.amt").alias("shipping_discount_amount")))
    return (pairs.join(one_per_order, "order_id")
            .groupBy("campaign_id").agg(F.sum("shipping_discount_amount").alias("shipping_cost_impact")))


def _fmt_fail(name: str, value: Column, limit: int) -> Column:
    return F.when(value < limit, F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(f"<{limit}")))


def sufficiency_failures(cdays: Column, bdays: Column, cunits: Column, bunits: Column,
                         n_orders: Column) -> Column:
    """Failed sufficiency conditions in fixed order (array<string>)."""
    return F.array_compact(F.array(
        _fmt_fail("campaign_days", cdays, MIN_CAMPAIGN_DAYS),
        _fmt_fail("baseline_days", bdays, MIN_BASELINE_DAYS),
        _fmt_fail("campaign_units", cunits, MIN_CAMPAIGN_UNITS),
        _fmt_fail("baseline_units", bunits, MIN_BASELINE_UNITS),
        F.when(n_orders <= 0, F.lit(FAIL_NO_ORDERS)),
        F.when(bdays == 0, F.lit(FAIL_BASELINE_RATE)),
        F.when(cdays == 0, F.lit(FAIL_CAMPAIGN_RATE)),
    ))


def verdict_struct(failures: Column, cmpd: Column, bmpd: Column, units_lift: Column,
                   ctype: Column) -> Column:
    """struct(verdict, confidence, reason_code) from unrounded rates."""
    lift = F.try_divide(cmpd, bmpd)
    ship = ctype == "shipping"
    suffix = F.when(ship, F.lit(REASON_SHIPPING_SUFFIX)).otherwise(F.lit(""))

    def capped(conf: float, cap: float) -> Column:
        return F.when(ship, F.lit(min(conf, cap))).otherwise(F.lit(conf))

    def out(verdict: str, conf: Column, reason: Column) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), conf.alias("confidence"),
                        reason.alias("reason_code"))

    insufficient = F.size(failures) > 0
    return (
        F.when(insufficient, out("inconclusive", F.lit(CONF_INSUFFICIENT),
                                 F.concat(F.lit(REASON_INSUFFICIENT), F.array_join(failures, "|"))))
        .when(bmpd == 0, out("inconclusive", F.lit(CONF_BASELINE_ZERO), F.lit(REASON_BASELINE_ZERO)))
        .when(lift >= PROFIT_LIFT,
              F.when(units_lift > UNITS_LIFT,
                     out("success", capped(CONF_MARGIN_AND_VOLUME, CAP_SHIPPING_SUCCESS),
                         F.concat(F.lit(REASON_MARGIN_AND_VOLUME), suffix)))
              .when(units_lift <= 1.0,
                    out("success", capped(CONF_MARGIN_NO_VOLUME, CAP_SHIPPING_SUCCESS),
                        F.concat(F.lit(REASON_MARGIN_NO_VOLUME), suffix)))
              .otherwise(out("success", capped(CONF_MARGIN, CAP_SHIPPING_SUCCESS),
                                  F.concat(F.lit(REASON_MARGIN), suffix))))
        .when(lift <= 1.0,
              F.when(units_lift > UNITS_LIFT,
                     out("flop", capped(CONF_FLOP, CAP_SHIPPING_FLOP), F.concat(F.lit(REASON_VOLUME_ERODED), suffix)))
              .otherwise(out("flop", capped(CONF_FLOP, CAP_SHIPPING_FLOP), F.concat(F.lit(REASON_EROSION), suffix))))
        .otherwise(out("inconclusive", capped(CONF_BELOW_THRESHOLD, CAP_SHIPPING_BELOW),
                       F.concat(F.lit(REASON_BELOW_THRESHOLD), suffix)))
    )


def campaign_measures(line_margin: DataFrame, orders: DataFrame, campaigns: DataFrame,
                      staged: list[str] | None = None) -> DataFrame:
    """One row per campaign (campaign table order kept in ``campaign_pos``) with
    unrounded totals, spans and rates (F5-F8)."""
    # attributed lines feed four consumers (totals, both baseline pair sets,
    # shipping); write them once instead of re-deriving them for each
    attributed = materialize(attributed_lines(line_margin, orders, campaigns), "attributed", staged)
    camp = _totals(attributed, "campaign", True)
    base = baseline_totals(attributed, line_margin, staged)
    ship = shipping_impact(attributed, orders, campaigns)
    # without an input position the start stands in (refs of equal positions go by
    # their text): unlike a row number it doesn't depend on partitions
    pos = F.lit(0).cast(T.LongType())
    if "campaign_pos" in campaigns.columns:
        pos = F.col("campaign_pos")
    elif "startAt" in campaigns.columns:
        pos = F.coalesce(F.unix_micros("startAt"), pos)
    c = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"),
                         "type", "status", F.col("totalRevenue").alias("reported_totalRevenue"),
                         F.col("marginPct").alias("reported_marginPct"), pos.alias("campaign_pos"))
    df = c.join(camp, "campaign_id", "left").join(base, "campaign_id", "left").join(ship, "campaign_id", "left")
    has_att = F.coalesce(F.col("campaign_lines"), F.lit(0)) > 0
    has_base = F.coalesce(F.col("baseline_lines"), F.lit(0)) > 0
    cdays = F.when(has_att, elapsed_day_span(F.col("campaign_first"), F.col("campaign_last"))).otherwise(F.lit(0))
    bdays = F.when(has_base, elapsed_day_span(F.col("baseline_first"), F.col("baseline_last"))).otherwise(F.lit(0))
    zero = F.lit(0).cast(MONEY)
    impact = F.when((F.col("type") == "shipping") & has_att,
                    F.coalesce(F.col("shipping_cost_impact"), zero))
    df = df.select(
        "campaign_id", "campaign_name", "type", "status", "campaign_pos",
        "reported_totalRevenue", "reported_marginPct",
        cdays.cast(T.LongType()).alias("window_days"),
        bdays.cast(T.LongType()).alias("baseline_days"),
        F.coalesce(F.col("attributed_orders"), F.lit(0)).cast(T.LongType()).alias("attributed_orders"),
        F.coalesce(F.col("campaign_units"), F.lit(0)).cast(T.LongType()).alias("campaign_units"),
        F.coalesce(F.col("baseline_units"), F.lit(0)).cast(T.LongType()).alias("baseline_units"),
        (F.coalesce(F.col("campaign_margin"), zero) - F.coalesce(impact, zero)).alias("campaign_margin_total"),
        F.coalesce(F.col("baseline_margin"), zero).alias("baseline_margin_total"),
        impact.alias("shipping_cost_impact"),
    )
    cd, bd = F.col("window_days"), F.col("baseline_days")
    cv = F.when(cd > 0, as_double("campaign_units") / as_double(cd)).otherwise(F.lit(0.0))
    bv = F.when(bd > 0, as_double("baseline_units") / as_double(bd)).otherwise(F.lit(0.0))
    return df.select(
        "*",
        F.when(cd > 0, as_double("campaign_margin_total") / as_double(cd)).otherwise(F.lit(0.0))
         .alias("campaign_margin_per_day"),
        F.when(bd > 0, as_double("baseline_margin_total") / as_double(bd)).otherwise(F.lit(0.0))
         .alias("baseline_margin_per_day"),
        cv.alias("campaign_velocity"), bv.alias("baseline_velocity"),
        F.when(bv > 0, cv / bv).otherwise(F.lit(0.0)).alias("units_lift"),
    )


def with_verdicts(measures: DataFrame) -> DataFrame:
    """Sufficiency failures and the verdict tree (F9, F10) on unrounded rates."""
    fails = sufficiency_failures(F.col("window_days"), F.col("baseline_days"), F.col("campaign_units"),
                                 F.col("baseline_units"), F.col("attributed_orders"))
    fails = F.when((F.size(fails) == 0) & (F.col("baseline_velocity") == 0),
                   F.array(F.lit(FAIL_BASELINE_VELOCITY))).otherwise(fails)
    df = measures.withColumn("sufficiency_failures", fails)
    v = verdict_struct(F.col("sufficiency_failures"), F.col("campaign_margin_per_day"),
                       F.col("baseline_margin_per_day"), F.col("units_lift"), F.col("type"))
    return df.withColumn("_v", v)


def evaluate_campaigns(orders: DataFrame, line_margin: DataFrame, campaigns: DataFrame,
                       staged: list[str] | None = None) -> DataFrame:
    """One row per campaign: the 19 evaluation columns plus campaign_pos and
    baseline_days (F12). Paths of staged tables are added to ``staged``."""
    df = with_verdicts(campaign_measures(line_margin, orders, campaigns, staged))
    return df.select(
        "campaign_id", "campaign_name", "type", "status", "window_days", "attributed_orders",
        "campaign_units", "baseline_units",
        round_money(F.col("campaign_margin_total"), 2).alias("campaign_margin_total"),
        round_money(F.col("baseline_margin_total"), 2).alias("baseline_margin_total"),
        F.round("campaign_margin_per_day", 4).alias("margin_per_day_campaign"),
        F.round("baseline_margin_per_day", 4).alias("margin_per_day_baseline"),
        F.round("units_lift", 4).alias("units_lift_ratio"),
        round_money(F.col("shipping_cost_impact"), 2).alias("shipping_cost_impact"),
        F.col("_v.verdict").alias("verdict"),
        F.round(F.col("_v.confidence"), 2).alias("confidence"),
        F.col("_v.reason_code").alias("reason_code"),
        "reported_totalRevenue", "reported_marginPct", "campaign_pos", "baseline_days",
    )


def verdict_counts(evaluation: DataFrame) -> DataFrame:
    """Number of campaigns per verdict."""
    return evaluation.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_campaigns"))
