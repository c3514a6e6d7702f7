"""Declared schemas of the export document and the fixed rule values.

Everything under "FIXED VALUES" must equal the values of the original analytics
for results to agree; it is data, listed plainly, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Nested export document (one JSON object: meta, shop, campaigns[], orders[]).
# FIXED VALUES: field names, types and required fields of the wire format.
# ---------------------------------------------------------------------------

CAMPAIGN_DISCOUNT = T.StructType([
    T.StructField("campaignId", T.StringType()),
    T.StructField("campaignName", T.StringType()),
    T.StructField("campaignType", T.StringType()),
    T.StructField("discountAmount", T.DoubleType()),
])

ORDER_CAMPAIGN = T.StructType(CAMPAIGN_DISCOUNT.fields + [
    T.StructField("shippingDiscountType", T.IntegerType()),
    T.StructField("shippingDiscountValue", T.DoubleType()),
])

LINE_ITEM = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("variant_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("total_discount", T.DoubleType()),
    T.StructField("compare_at_price", T.DoubleType()),
    T.StructField("active_campaign_id", T.StringType()),
    T.StructField("active_campaign_ids", T.ArrayType(T.StringType())),
    T.StructField("campaign_discounts", T.ArrayType(CAMPAIGN_DISCOUNT)),
])

ORDER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("shop_id", T.StringType()),
    T.StructField("order_number", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("subtotal_price", T.DoubleType()),
    T.StructField("total_discounts", T.DoubleType()),
    T.StructField("total_price", T.DoubleType()),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
    T.StructField("has_active_campaign", T.BooleanType()),
    T.StructField("is_free_shipping", T.BooleanType()),
    T.StructField("shipping_original_price", T.DoubleType()),
    T.StructField("shipping_price_charged", T.DoubleType()),
    T.StructField("shipping_discount_amount", T.DoubleType()),
    T.StructField("applied_campaigns", T.ArrayType(CAMPAIGN_DISCOUNT)),
    T.StructField("order_campaigns", T.ArrayType(ORDER_CAMPAIGN)),
    T.StructField("cost_total", T.DoubleType()),
    T.StructField("revenue_with_cost", T.DoubleType()),
    T.StructField("has_partial_cost", T.BooleanType()),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("customer_email", T.StringType()),
])

CAMPAIGN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("shopId", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("startAt", T.TimestampType()),
    T.StructField("endAt", T.TimestampType()),
    T.StructField("ranAt", T.TimestampType()),
    T.StructField("isDeleted", T.BooleanType()),
    T.StructField("totalRevenue", T.DoubleType()),
    T.StructField("orderCount", T.LongType()),
    T.StructField("marginPct", T.DoubleType()),
    T.StructField("createdAt", T.TimestampType()),
])

SHOP = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("shopifyDomain", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("planName", T.StringType()),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("ownerName", T.StringType()),
    T.StructField("ownerEmail", T.StringType()),
    T.StructField("customerEmail", T.StringType()),
])

EXPORT = T.StructType([
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("shop", SHOP),
    T.StructField("campaigns", T.ArrayType(CAMPAIGN)),
    T.StructField("orders", T.ArrayType(ORDER)),
])

# Required (non-nullable in the source contract) fields per entity; the
# remaining ones are optional (absent key == null) or default to [].
REQUIRED_FIELDS: dict[str, tuple[str, ...]] = {
    "orders": ("id", "shop_id", "order_number", "currency", "subtotal_price",
               "total_discounts", "total_price", "has_active_campaign",
               "is_free_shipping", "shipping_original_price", "shipping_price_charged",
               "shipping_discount_amount", "cost_total", "revenue_with_cost",
               "has_partial_cost", "createdAt"),
    "lineitems": ("product_id", "variant_id", "title", "price", "quantity",
                  "total_discount", "compare_at_price"),
    "campaigns": ("id", "shopId", "name", "type", "status", "startAt", "ranAt",
                  "isDeleted", "totalRevenue", "orderCount", "marginPct", "createdAt"),
    # records of line_items[].campaign_discounts, applied_campaigns and order_campaigns
    "discounts": ("campaignId", "campaignName", "campaignType", "discountAmount"),
    "shop": ("id", "shopifyDomain", "country", "currency", "planName", "createdAt"),
}

# Clean output column orders.
ORDER_COLUMNS = (
    "order_id", "shop_id", "order_number", "currency", "subtotal_price",
    "total_discounts", "total_price", "has_active_campaign", "is_free_shipping",
    "shipping_original_price", "shipping_price_charged", "shipping_discount_amount",
    "applied_campaigns", "order_campaigns", "cost_total", "revenue_with_cost",
    "has_partial_cost", "createdAt",
)
LINEITEM_COLUMNS = (
    "order_id", "order_number", "shop_id", "createdAt", "currency",
    "order_total_price", "order_total_discounts", "cost_total", "revenue_with_cost",
    "shipping_original_price", "shipping_price_charged", "shipping_discount_amount",
    "is_free_shipping", "product_id", "variant_id", "title", "price", "quantity",
    "total_discount", "compare_at_price", "active_campaign_id", "active_campaign_ids",
    "campaign_discounts",
)
CAMPAIGN_COLUMNS = (
    "id", "shopId", "name", "type", "status", "startAt", "endAt", "ranAt",
    "totalRevenue", "orderCount", "marginPct", "isDeleted",
)
SHOP_COLUMNS = ("id", "shopifyDomain", "country", "currency", "planName", "createdAt")

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original analytics)
# ---------------------------------------------------------------------------

# Personal data: column-name fragments, shop keys and order key to remove, and
# the e-mail pattern searched in values.
PII_COLUMN_FRAGMENTS = ("customer_email", "owneremail", "ownername", "customeremail", "email")
SHOP_PII_KEYS = ("ownerName", "ownerEmail", "customerEmail")
ORDER_PII_KEY = "customer_email"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# Product classification.
MIN_UNITS = 20
MOVEMENT_CLASSES = ("fast", "medium", "slow")

# Campaign evaluation thresholds.
MIN_CAMPAIGN_DAYS = 3
MIN_BASELINE_DAYS = 3
MIN_CAMPAIGN_UNITS = 20
MIN_BASELINE_UNITS = 20
PROFIT_LIFT = 1.2          # 1 + 0.20
UNITS_LIFT = 1.10
VERDICTS = ("success", "flop", "inconclusive")

# Campaign type -> mechanic label.
CAMPAIGN_TYPE_TO_MECHANIC = {
    "shipping": "Free Shipping",
    "buy_one_get_one": "BXGY",
    "volume": "Volume/Bundle",
    "order": "Order-level Discount",
    "general": "Generic Discount",
}
MECHANIC_TO_CAMPAIGN_TYPE = {m: t for t, m in CAMPAIGN_TYPE_TO_MECHANIC.items()}

# Mechanic -> implementation effort (priority denominator).
MECHANIC_EFFORT = {
    "Leave/minimal discount": 1.0,
    "Free Shipping": 2.0,
    "BXGY": 3.0,
    "Volume/Bundle": 3.0,
    "Bundle/Cross-sell": 4.0,
    "Collect more data": 1.0,
    "Avoid deeper discounts": 1.0,
    "Order-level Discount": 2.0,
    "Generic Discount": 2.0,
}
MECHANICS = tuple(MECHANIC_EFFORT)

# Margin opportunity -> value; confidence label -> weight.
OPPORTUNITY_VALUE = {"high": 3.0, "medium": 2.0, "low": 1.0}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3}

# Order in which a vetoed mechanic is replaced.
FALLBACK_ORDER = ("Volume/Bundle", "BXGY", "Free Shipping", "Avoid deeper discounts",
                  "Leave/minimal discount")

# Step A matrix: (margin_band, movement_class) -> (mechanic, opportunity, base
# confidence). "low"/"fast" is Free Shipping only when shipping ROI is positive,
# else Leave/minimal discount.
POLICY_MATRIX = (
    ("high", "fast", "Leave/minimal discount", "medium", "high"),
    ("high", "medium", "Volume/Bundle", "medium", "medium"),
    ("high", "slow", "BXGY", "high", "high"),
    ("mid", "fast", "Leave/minimal discount", "medium", "medium"),
    ("mid", "medium", "Leave/minimal discount", "low", "medium"),
    ("mid", "slow", "Volume/Bundle", "medium", "medium"),
    ("low", "fast", "Free Shipping", "medium", "medium"),
    ("low", "medium", "Avoid deeper discounts", "medium", "medium"),
    ("low", "slow", "Avoid deeper discounts", "low", "medium"),
)
SHIPPING_GATED_FALLBACK = "Leave/minimal discount"

# Mechanic domain of segment proposals.
SEGMENT_MECHANICS = MECHANICS

# Verdict reason codes, shipping suffix and sufficiency failure texts.
REASON_INSUFFICIENT = "low_n:"
REASON_BASELINE_ZERO = "baseline_margin_per_day_zero"
REASON_MARGIN_AND_VOLUME = "margin_lift|volume_lift"
REASON_MARGIN_NO_VOLUME = "margin_gain_without_volume_lift"
REASON_MARGIN = "margin_lift"
REASON_VOLUME_ERODED = "volume_lift_margin_eroded"
REASON_EROSION = "margin_erosion"
REASON_BELOW_THRESHOLD = "margin_lift_below_threshold"
REASON_SHIPPING_SUFFIX = "|shipping_order_level_attribution_coarse"
FAIL_NO_ORDERS = "attributed_orders=0"
FAIL_BASELINE_RATE = "baseline_margin_per_day_invalid"
FAIL_CAMPAIGN_RATE = "campaign_margin_per_day_invalid"
FAIL_BASELINE_VELOCITY = "baseline_velocity_zero"

# Verdict confidences (and caps for shipping campaigns).
CONF_INSUFFICIENT = 0.2
CONF_BASELINE_ZERO = 0.3
CONF_MARGIN_AND_VOLUME = 0.85
CONF_MARGIN_NO_VOLUME = 0.60
CONF_MARGIN = 0.75
CONF_FLOP = 0.80
CONF_BELOW_THRESHOLD = 0.50
CAP_SHIPPING_SUCCESS = 0.70
CAP_SHIPPING_FLOP = 0.65
CAP_SHIPPING_BELOW = 0.45

# Evidence tags on recommendations.
TAG_VETOED = "base_mechanic_vetoed:"
TAG_VETOED_FALLBACK = "->fallback:"
TAG_ALL_VETOED = "all_fallbacks_vetoed:terminal_safe"
TAG_SUCCESS = "campaign_success_evidence:"
TAG_FLOP = "campaign_flop_evidence:"
TAG_SHIPPING_COARSE = "shipping_attribution_coarse"
TAG_ERODED_RISK = "volume_lift_margin_eroded_risk"
TAG_AFFINITY = "affinity_override_applied"
TAG_RULE0 = "rule0_insufficient_data"
