"""Line- and product-level metrics.

Grain rule: order-grain columns (cost_total, shipping_*, order totals) repeat on
every line of an order and are never summed across lines. Order cost reaches
lines only through revenue-share allocation.

Money is exact DECIMAL until the final projection, so totals do not depend on
partitioning or the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import (MONEY, as_double, calendar_day_span, money, round_money,
                                 safe_div)


def _require(df: DataFrame, cols, step: str) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{step}: input is missing required columns {missing}")


def compute_line_revenue(lines: DataFrame) -> DataFrame:
    """Add ``line_gross_revenue`` = quantity x price and ``line_net_revenue`` =
    gross - total_discount, clipped at 0 (``net_clipped`` marks clipped lines)."""
    _require(lines, ("quantity", "price", "total_discount"), "compute_line_revenue")
    gross = (F.col("quantity").cast(T.DecimalType(20, 0)) * money("price")).cast(MONEY)
    raw_net = (gross - money("total_discount")).cast(MONEY)
    return (lines
            .withColumn("line_gross_revenue", gross)
            .withColumn("net_clipped", raw_net < 0)
            .withColumn("line_net_revenue",
                        F.when(raw_net < 0, F.lit(0).cast(MONEY)).otherwise(raw_net)))


def order_net_revenue(lines_with_net: DataFrame) -> DataFrame:
    """One row per order: ``order_net_revenue`` = sum of its lines' net revenue.

    A plain hash aggregate: partial sums are combined map-side, so an order
    with very many lines never gathers its raw rows in one task.
    """
    _require(lines_with_net, ("order_id", "line_net_revenue"), "order_net_revenue")
    return (lines_with_net.groupBy("order_id")
            .agg(F.sum("line_net_revenue").alias("order_net_revenue")))


def with_order_net_revenue(lines_with_net: DataFrame) -> DataFrame:
    """Lines with their order's ``order_net_revenue`` (null without an order id)
    and ``first_line``, true for one line of each order.

    ``order_net_revenue`` on the lines themselves: lines that come from a join on
    order_id are not shuffled again. An order's lines meet in one task, which
    spills beyond its memory; lines without an order id are dealt out."""
    _require(lines_with_net, ("order_id", "line_net_revenue"), "with_order_net_revenue")
    known = F.col("order_id").isNotNull()
    others = [c for c in ("product_id", "createdAt") if c in lines_with_net.columns]
    spread = F.when(~known, F.xxhash64(*others) if others else F.rand())
    order = Window.partitionBy("order_id", "_spread").orderBy("_spread")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (lines_with_net.withColumn("_spread", spread)
            .withColumn("order_net_revenue", F.when(known, F.sum("line_net_revenue").over(whole)))
            .withColumn("first_line", known & (F.row_number().over(order) == 1))
            .drop("_spread"))


def allocate_order_cost_to_lines(lines_with_net: DataFrame) -> DataFrame:
    """Add ``allocated_cost`` = cost_total x line_net / order_net (0 when the
    order's net revenue is 0), rounded to 6 places.

    If the input already carries ``order_net_revenue`` (computed from the nested
    line array before exploding, which needs no shuffle) it is used as is;
    otherwise the order sums are aggregated and joined back on order_id; lines
    without an order id stay, with cost 0. The
    join is shuffle-based (AQE may broadcast it when the sums are small, and
    splits a skewed order partition)."""
    _require(lines_with_net, ("order_id", "line_net_revenue", "cost_total"),
             "allocate_order_cost_to_lines")
    df = lines_with_net
    if "order_net_revenue" not in df.columns:
        # left: a line without an order id keeps its row and gets no cost
        df = df.join(order_net_revenue(df), "order_id", "left")
    share = F.when(F.col("order_net_revenue") > 0,
                   as_double("line_net_revenue") / as_double("order_net_revenue")
                   ).otherwise(F.lit(0.0))
    allocated = F.round(as_double("cost_total") * share, 6).cast(MONEY)
    return df.withColumn("allocated_cost", allocated).drop("order_net_revenue")


def prepare_line_margin(lines: DataFrame) -> DataFrame:
    """Lines with gross, net, allocated cost and ``line_margin_alloc`` =
    net - allocated (one shared implementation for metrics and campaigns)."""
    df = lines
    if "line_net_revenue" not in df.columns:
        df = compute_line_revenue(df)
    if "allocated_cost" not in df.columns:
        df = allocate_order_cost_to_lines(df)
    return df.withColumn("line_margin_alloc",
                         F.round(F.col("line_net_revenue") - F.col("allocated_cost"), 6).cast(MONEY))


# What downstream stages (product metrics, campaign evaluation) read from the
# line-margin table; nested attribution lists and order-grain extras are left out.
LINE_MARGIN_COLUMNS = ("order_id", "product_id", "title", "quantity", "createdAt", "active_campaign_id",
                       "cost_total", "line_net_revenue", "allocated_cost", "line_margin_alloc")


def zero_revenue_orders(lines_with_net: DataFrame) -> DataFrame:
    """Orders whose lines sum to zero net revenue (their cost is not allocated)."""
    return order_net_revenue(lines_with_net).where(F.col("order_net_revenue") == 0)


def dataset_window(lines: DataFrame, ts: str = "createdAt") -> DataFrame:
    """One row: first/last timestamp and inclusive calendar-day span (min 1)."""
    return lines.agg(F.min(ts).alias("dataset_first"), F.max(ts).alias("dataset_last")).select(
        "dataset_first", "dataset_last",
        F.greatest(calendar_day_span(F.col("dataset_first"), F.col("dataset_last")),
                   F.lit(1)).cast(T.LongType()).alias("window_days"))


def window_days_scalar(lines: DataFrame, ts: str = "createdAt") -> Column:
    """The dataset window as a scalar subquery (evaluated once, inlined)."""
    return dataset_window(lines, ts).select("window_days").scalar()


def compute_product_metrics(lines_alloc: DataFrame, window_days: Column | int | None = None) -> DataFrame:
    """Per (product_id, title): units, revenue, allocated cost, first/last order
    time, gross margin, margin_pct and velocity over the shared dataset window.

    margin_pct is computed from unrounded totals and then rounded to 4 places;
    velocity = units / window_days rounded to 6 places.
    """
    _require(lines_alloc, ("product_id", "title", "quantity", "line_net_revenue",
                           "allocated_cost", "createdAt"), "compute_product_metrics")
    if window_days is None:
        window_days = window_days_scalar(lines_alloc)
    elif isinstance(window_days, int):
        window_days = F.lit(window_days)
    agg = lines_alloc.groupBy("product_id", "title").agg(
        F.sum("quantity").cast(T.LongType()).alias("units_sold"),
        F.sum("line_net_revenue").alias("_revenue"),
        F.sum("allocated_cost").alias("_cost"),
        F.min("createdAt").alias("product_first_order_date"),
        F.max("createdAt").alias("product_last_order_date"),
    )
    margin = F.col("_revenue") - F.col("_cost")
    return agg.select(
        "product_id", "title", "units_sold",
        round_money(F.col("_revenue"), 4).alias("revenue"),
        round_money(F.col("_cost"), 4).alias("allocated_cost"),
        "product_first_order_date", "product_last_order_date",
        round_money(margin, 4).alias("gross_margin_alloc"),
        F.round(F.when(F.col("_revenue") != 0, as_double(margin) / as_double(F.col("_revenue")))
                .otherwise(F.lit(0.0)), 4).alias("margin_pct"),
        F.round(safe_div(F.col("units_sold"), window_days), 6).alias("velocity_per_day"),
        window_days.cast(T.LongType()).alias("window_days"),
    )


def run_product_metrics(lines: DataFrame) -> DataFrame:
    """Composite: line revenue -> cost allocation -> product metrics."""
    return compute_product_metrics(allocate_order_cost_to_lines(compute_line_revenue(lines)))


def products_by_velocity(products: DataFrame) -> DataFrame:
    """Products sorted by velocity descending; ties by product_id, title."""
    return products.orderBy(F.desc("velocity_per_day"), "product_id", "title")
