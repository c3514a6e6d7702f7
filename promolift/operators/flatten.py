"""Flatten nested orders / campaigns into the clean tables.

* orders: one row per order (``id`` -> ``order_id``), 18 columns, campaign
  lists kept nested (absent lists -> []).
* line items: ``explode`` of line_items (inner: an order without lines gives
  no row) carrying 13 order columns; ``total_price`` -> ``order_total_price``
  and ``total_discounts`` -> ``order_total_discounts``.
* campaigns: 12 columns plus ``campaign_pos`` (input order).

Exploding is a narrow, per-row operation: no shuffle. The order's net revenue
can be folded from the nested line array before exploding (also no shuffle),
which lets cost allocation skip its order-level aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import MONEY
from ..schemas import (CAMPAIGN_COLUMNS, LINE_ITEM, LINEITEM_COLUMNS, ORDER, ORDER_COLUMNS)


def _list_or_empty(name: str, dtype: T.DataType) -> Column:
    return F.coalesce(F.col(name), F.array().cast(dtype)).alias(name)


def to_orders(orders: DataFrame) -> DataFrame:
    """Nested orders (ORDER schema) -> orders_clean (18 columns)."""
    cols = []
    for c in ORDER_COLUMNS:
        if c == "order_id":
            cols.append(F.col("id").alias("order_id"))
        elif c in ("applied_campaigns", "order_campaigns"):
            cols.append(_list_or_empty(c, ORDER[c].dataType))
        else:
            cols.append(F.col(c))
    return orders.select(*cols)


PARENT = {
    "order_id": "id", "order_number": "order_number", "shop_id": "shop_id", "createdAt": "createdAt",
    "currency": "currency", "order_total_price": "total_price", "order_total_discounts": "total_discounts",
    "cost_total": "cost_total", "revenue_with_cost": "revenue_with_cost",
    "shipping_original_price": "shipping_original_price", "shipping_price_charged": "shipping_price_charged",
    "shipping_discount_amount": "shipping_discount_amount", "is_free_shipping": "is_free_shipping",
}


def order_net_from_items(items: Column) -> Column:
    """Sum over an order's nested lines of max(quantity x price - discount, 0),
    computed inside the row (no shuffle)."""
    zero = F.lit(0).cast(MONEY)

    def raw(li: Column) -> Column:
        gross = (li["quantity"].cast(T.DecimalType(20, 0)) * li["price"].cast(MONEY)).cast(MONEY)
        return (gross - li["total_discount"].cast(MONEY)).cast(MONEY)

    # the inner list binds a line's value: lambdas have no common subexpressions
    return F.aggregate(F.transform(items, raw), F.lit(0).cast(T.DecimalType(38, 6)),
                       lambda acc, net: (acc + F.when(net < 0, zero).otherwise(net)).cast(T.DecimalType(38, 6)))


def to_lineitems(orders: DataFrame, with_order_net: bool = False) -> DataFrame:
    """Nested orders -> lineitems_clean (23 columns), one row per line item.

    ``with_order_net`` also carries ``order_net_revenue`` folded from the
    nested array, so cost allocation needs no order-level aggregation, and
    ``first_line``, which marks one line of each order."""
    parent = [F.col(src).alias(dst) for dst, src in PARENT.items()]
    extra = [order_net_from_items(F.col("line_items")).alias("order_net_revenue")] if with_order_net else []
    # a projection of its own: beside posexplode, the fold would be made for every line, of all the order's lines
    orders = orders.select(*parent, *extra, "line_items")
    exploded = orders.select(*[c for c in orders.columns if c != "line_items"], F.posexplode("line_items").alias("_at", "li"))
    item_cols = []
    for c in LINEITEM_COLUMNS:
        if c in PARENT:
            continue
        if c in ("active_campaign_ids", "campaign_discounts"):
            item_cols.append(F.coalesce(F.col(f"li.{c}"), F.array().cast(LINE_ITEM[c].dataType)).alias(c))
        else:
            item_cols.append(F.col(f"li.{c}").alias(c))
    more = [F.col("order_net_revenue"), (F.col("_at") == 0).alias("first_line")] if with_order_net else []
    out = exploded.select(*[F.col(c) for c in PARENT], *item_cols, *more)
    return out.select(*LINEITEM_COLUMNS, *(["order_net_revenue", "first_line"] if with_order_net else []))


def to_campaigns(campaigns: DataFrame) -> DataFrame:
    """Campaign records -> campaigns_clean (12 columns + campaign_pos)."""
    pos = ["campaign_pos"] if "campaign_pos" in campaigns.columns else []
    return campaigns.select(*CAMPAIGN_COLUMNS, *pos)
