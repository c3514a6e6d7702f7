"""Stand-in shop input built from the driver's TPC-H-like test tables.

This module only produces rows in the schema the analytics expect (orders,
line items, campaigns, a shop record, and the nested export form of orders).
It computes no metric, attribution, verdict or recommendation: those run in
``promolift.operators`` on whatever rows arrive here.

Mapping (fixed, see the project's FIXTURES notes):

* line item  <- lineitem joined to its order and part: order_id = l_orderkey,
  product_id = l_partkey, variant_id = l_suppkey, title = p_name,
  quantity = l_quantity, price = p_retailprice (2 places),
  total_discount = quantity x price x l_discount (4 places),
  createdAt = o_orderdate, cost_total = 0.2 x o_totalprice (order grain).
* active_campaign_id from the discount percent p = round(l_discount x 100):
  0 -> none; 1-5 -> k1; 6,7 -> k2; 8 -> k3; 9 -> k5;
  10 -> k4 when l_linenumber = 7 and o_orderstatus = 'P', else none.
* order_campaigns from o_orderpriority: 1-URGENT -> k6, 2-HIGH -> k7,
  4-NOT SPECIFIED -> k1, 3-MEDIUM with o_orderkey % 500 = 0 -> k8, else none;
  shipping_discount_amount 9.99 on k6 and k8 orders, else 0.
* nine campaigns k1..k9 with fixed types (k9 has no hits).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import CAMPAIGN, LINE_ITEM, ORDER, ORDER_CAMPAIGN, SHOP

# FIXED VALUES: the stand-in campaign list (position, id, type).
CAMPAIGNS = (
    (0, "k1", "buy_one_get_one"),
    (1, "k2", "volume"),
    (2, "k3", "general"),
    (3, "k4", "volume"),
    (4, "k5", "general"),
    (5, "k6", "shipping"),
    (6, "k7", "order"),
    (7, "k8", "shipping"),
    (8, "k9", "general"),
)
SHOP_ID = "shop-test"
SHIPPING_DISCOUNT = "9.99"
STAND_IN_TIME = dt.datetime(1995, 1, 1, tzinfo=dt.timezone.utc)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _campaign_type(cid: Column) -> Column:
    expr = F.lit(None).cast(T.StringType())
    for _, key, ctype in reversed(CAMPAIGNS):
        expr = F.when(cid == key, F.lit(ctype)).otherwise(expr)
    return expr


def _order_campaign_id() -> Column:
    prio = F.col("o_orderpriority")
    return (F.when(prio == "1-URGENT", F.lit("k6"))
            .when(prio == "2-HIGH", F.lit("k7"))
            .when(prio == "4-NOT SPECIFIED", F.lit("k1"))
            .when((prio == "3-MEDIUM") & (F.col("o_orderkey") % 500 == 0), F.lit("k8")))


def _utc(wall: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session's time zone."""
    return F.make_timestamp(F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall), F.minute(wall),
                            F.extract(F.lit("SECOND"), wall), F.lit("UTC"))


def _orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc_id = _order_campaign_id()
    shipping = oc_id.isin("k6", "k8")
    total = F.col("o_totalprice").cast(T.DecimalType(14, 2))
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderstatus"),
        _utc(F.col("o_orderdate")).alias("createdAt"),
        total.alias("total_price"),
        (total * F.lit(0.2).cast(T.DecimalType(2, 1))).cast(T.DecimalType(16, 3)).alias("cost_total"),
        oc_id.alias("_oc_id"),
        F.when(shipping, F.lit(SHIPPING_DISCOUNT)).otherwise(F.lit("0"))
         .cast(T.DecimalType(4, 2)).alias("shipping_discount_amount"),
    )


def _order_campaigns(oc_id: Column) -> Column:
    ctype = _campaign_type(oc_id)
    is_ship = ctype == "shipping"
    entry = F.struct(
        oc_id.alias("campaignId"),
        F.concat(F.lit("Campaign "), oc_id).alias("campaignName"),
        ctype.alias("campaignType"),
        F.lit(0.0).alias("discountAmount"),
        F.when(is_ship, F.lit(1)).cast(T.IntegerType()).alias("shippingDiscountType"),
        F.when(is_ship, F.lit(float(SHIPPING_DISCOUNT))).alias("shippingDiscountValue"),
    )
    return F.when(oc_id.isNull(), F.array().cast(T.ArrayType(ORDER_CAMPAIGN))).otherwise(
        F.array(entry).cast(T.ArrayType(ORDER_CAMPAIGN)))


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat orders (orders_clean columns), one row per test order."""
    o = _orders_base(spark, sf_dir)
    return o.select(
        "order_id",
        F.lit(SHOP_ID).alias("shop_id"),
        F.col("order_id").alias("order_number"),
        F.lit("USD").alias("currency"),
        F.col("total_price").alias("subtotal_price"),
        F.lit(0).cast(T.DecimalType(14, 2)).alias("total_discounts"),
        "total_price",
        F.col("_oc_id").isNotNull().alias("has_active_campaign"),
        (F.col("shipping_discount_amount") > 0).alias("is_free_shipping"),
        F.col("shipping_discount_amount").alias("shipping_original_price"),
        F.lit(0).cast(T.DecimalType(4, 2)).alias("shipping_price_charged"),
        "shipping_discount_amount",
        F.array().cast(T.ArrayType(LINE_ITEM["campaign_discounts"].dataType.elementType)).alias(
            "applied_campaigns"),
        _order_campaigns(F.col("_oc_id")).alias("order_campaigns"),
        "cost_total",
        (F.col("total_price") - F.col("cost_total")).alias("revenue_with_cost"),
        F.lit(False).alias("has_partial_cost"),
        "createdAt",
    )


def _active_campaign_id() -> Column:
    p = F.round(F.col("l_discount") * 100).cast(T.IntegerType())
    return (F.when(p.between(1, 5), F.lit("k1"))
            .when(p.isin(6, 7), F.lit("k2"))
            .when(p == 8, F.lit("k3"))
            .when(p == 9, F.lit("k5"))
            .when((p == 10) & (F.col("l_linenumber") == 7) & (F.col("o_orderstatus") == "P"),
                  F.lit("k4")))


# so many lines go to a task at most (an order's lines stay together), whatever the session's number of shuffle partitions
LINES_PER_TASK = 250_000


def _line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test lines with what their part gives them, dealt out by order."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    tasks = -(-li.count() // LINES_PER_TASK)   # counted from the files' footers
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    # the part first: then all steps by order share one shuffle
    lines = li.join(part, li.l_partkey == part.p_partkey)
    return lines.repartition(tasks, "l_orderkey") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines


def _line_money() -> tuple[Column, Column]:
    """Price and total discount of a line."""
    price = F.col("p_retailprice").cast(T.DecimalType(12, 2))
    gross = (F.col("l_quantity").cast(T.DecimalType(6, 0)) * price).cast(T.DecimalType(14, 2))
    return price, (gross * F.col("l_discount").cast(T.DecimalType(4, 2))).cast(T.DecimalType(18, 4))


def _campaign_ids(acid: Column) -> Column:
    return F.when(acid.isNull(), F.array().cast(T.ArrayType(T.StringType()))).otherwise(F.array(acid))


def _campaign_discounts(acid: Column, discount: Column) -> Column:
    return (F.when(acid.isNull(), F.array().cast(LINE_ITEM["campaign_discounts"].dataType))
            .otherwise(F.array(F.struct(
                acid.alias("campaignId"),
                F.concat(F.lit("Campaign "), acid).alias("campaignName"),
                _campaign_type(acid).alias("campaignType"),
                discount.cast(T.DoubleType()).alias("discountAmount")))))


def shop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat line items (lineitems_clean columns), one row per test line."""
    li, o = _line_values(spark, sf_dir), _orders_base(spark, sf_dir)
    price, discount = _line_money()
    acid = _active_campaign_id()
    return li.join(o, li.l_orderkey == o.order_id).select(
        "order_id",
        F.col("order_id").alias("order_number"),
        F.lit(SHOP_ID).alias("shop_id"),
        "createdAt",
        F.lit("USD").alias("currency"),
        F.col("total_price").alias("order_total_price"),
        F.lit(0).cast(T.DecimalType(14, 2)).alias("order_total_discounts"),
        "cost_total",
        (F.col("total_price") - F.col("cost_total")).alias("revenue_with_cost"),
        F.col("shipping_discount_amount").alias("shipping_original_price"),
        F.lit(0).cast(T.DecimalType(4, 2)).alias("shipping_price_charged"),
        "shipping_discount_amount",
        (F.col("shipping_discount_amount") > 0).alias("is_free_shipping"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("variant_id"),
        F.col("p_name").alias("title"),
        price.alias("price"),
        F.col("l_quantity").cast(T.LongType()).alias("quantity"),
        discount.alias("total_discount"),
        price.alias("compare_at_price"),
        acid.alias("active_campaign_id"),
        _campaign_ids(acid).alias("active_campaign_ids"),
        _campaign_discounts(acid, discount).alias("campaign_discounts"),
    )


def shop_campaigns(spark: SparkSession) -> DataFrame:
    """The nine stand-in campaigns (campaigns_clean columns + createdAt), in
    input order (``campaign_pos``)."""
    rows = [(cid, SHOP_ID, f"Campaign {cid}", ctype, "active", STAND_IN_TIME, None,
             STAND_IN_TIME, False, 0.0, 0, 0.0, STAND_IN_TIME)
            for _, cid, ctype in CAMPAIGNS]
    df = spark.createDataFrame(rows, CAMPAIGN)
    pos = F.lit(None).cast(T.IntegerType())
    for p, cid, _ in reversed(CAMPAIGNS):
        pos = F.when(F.col("id") == cid, F.lit(p)).otherwise(pos)
    return df.withColumn("campaign_pos", pos)


def shop_record(spark: SparkSession) -> DataFrame:
    """One shop row, personal fields included (they must be removed on ingest)."""
    return spark.createDataFrame(
        [(SHOP_ID, "test.example", "US", "USD", "basic", STAND_IN_TIME,
          "Owner Name", "owner@example.com", "customer@example.com")], SHOP)


def _export_item(li: Column) -> Column:
    """A line item (LINE_ITEM schema) from what is gathered of a line."""
    acid, price = li["active_campaign_id"], li["price"].cast(T.DoubleType())
    values = {"product_id": li["product_id"], "variant_id": li["variant_id"], "title": li["title"], "price": price,
              "quantity": li["quantity"], "total_discount": li["total_discount"].cast(T.DoubleType()),
              "compare_at_price": price, "active_campaign_id": acid, "active_campaign_ids": _campaign_ids(acid),
              "campaign_discounts": _campaign_discounts(acid, li["total_discount"])}
    return F.struct(*[values[f.name].alias(f.name) for f in LINE_ITEM.fields])


def shop_export_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the nested export form (ORDER schema): flat lines gathered back
    into ``line_items`` per order, money as DOUBLE, plus a personal
    ``customer_email`` that ingest must drop. Orders without lines keep an
    empty array.

    Only the values that differ from line to line are shuffled and gathered; the
    nested records are made from them in the order's row."""
    li = _line_values(spark, sf_dir)
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus")
    price, discount = _line_money()
    gathered = F.struct(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("variant_id"),
                        F.col("p_name").alias("title"), price.alias("price"),
                        F.col("l_quantity").cast(T.LongType()).alias("quantity"), discount.alias("total_discount"),
                        _active_campaign_id().alias("active_campaign_id"))
    items = (li.join(o, li.l_orderkey == o.order_id).groupBy("order_id")
             .agg(F.collect_list(gathered).alias("_lines"))
             .select("order_id", F.transform("_lines", _export_item).alias("line_items")))
    orders = shop_orders(spark, sf_dir)
    nested = orders.join(items, "order_id", "left")
    cols = []
    for f in ORDER.fields:
        if f.name == "id":
            cols.append(F.col("order_id").alias("id"))
        elif f.name == "line_items":
            cols.append(F.coalesce(F.col("line_items").cast(f.dataType),
                                   F.array().cast(f.dataType)).alias("line_items"))
        elif f.name == "customer_email":
            cols.append(F.concat(F.lit("buyer"), F.col("order_id").cast("string"),
                                 F.lit("@example.com")).alias("customer_email"))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return nested.select(*cols)


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("value")


def record_text(df: DataFrame) -> DataFrame:
    """Records as JSON Lines text (column ``value``); null fields are absent."""
    return df.select(_json(df))


# FIXED VALUES: breaches put into the stand-in order records, as (order ids of
# which multiple, pattern in the JSON text, replacement).
ORDER_BREACHES = (
    (7, '"currency":"USD",', ""),                                        # absent:currency
    (11, '"total_price":([0-9.E]+)', '"total_price":"$1"'),              # type:total_price
    (13, '"has_partial_cost":false', '"has_partial_cost":null'),         # null:has_partial_cost
    (17, '"applied_campaigns":\\[\\]', '"applied_campaigns":null'),        # null:applied_campaigns
    (19, '"quantity":[0-9]+,', ""),                                      # absent:line_items[].quantity
    (23, '"variant_id":([0-9]+)', '"variant_id":$1.5'),                  # type:line_items[].variant_id
    (2, '"campaignName":"Campaign k6",', ""),                            # absent:order_campaigns[].campaignName
    (3, '("campaignType":"volume","discountAmount":)[0-9.E-]+', "$1null"),  # null:line_items[].campaign_discounts[]...
    (31, "^.*$", "[1]"),                                                 # type: (no object)
    (37, "^(.*).$", "$1"),                                               # syntax:
)
SHOP_BREACHES = ('{"id":"shop-test"}', '{"id":"shop-test","country":7,"currency":null}', "no json")


def breached_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export orders as JSON Lines text, without e-mails, with ``ORDER_BREACHES``."""
    orders = (shop_export_orders(spark, sf_dir).drop("customer_email")
              .withColumn("line_items", F.sort_array("line_items")))   # a fixed order, so that paths are
    text = orders.select("id", _json(orders))
    for every, pattern, new in ORDER_BREACHES:
        text = text.withColumn("value", F.when(F.col("id") % every == 0, F.regexp_replace("value", pattern, new))
                               .otherwise(F.col("value")))
    return text.select("value")


def breached_shop_text(spark: SparkSession) -> DataFrame:
    """Shop records that breach the contract, as JSON Lines text."""
    return spark.createDataFrame([(r,) for r in SHOP_BREACHES], "value string")
