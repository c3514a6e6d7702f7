"""Record validation and output contracts as data.

Strict rules are the source contract: a record that doesn't parse (``type:``,
``syntax:``), lacks a required field (``required:``, ``missing:``, ``absent:``,
``null:``), or isn't the only one of its kind (``single:``). Everything else (signs, order of
dates, duplicate ids) is a warning: counted, never raised.

A rule is a named boolean Column that is TRUE when a row violates it. Checks
run as one aggregate pass (counts per rule) or as a filter returning the
offending rows; strict mode raises on any violation. This replaces per-row
model validation with set-based checks that scale with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import contracts
from ..schemas import (MECHANICS, MIN_UNITS, MOVEMENT_CLASSES, REQUIRED_FIELDS, SEGMENT_MECHANICS,
                       VERDICTS)

Rules = dict[str, Column]


def _bad(c: Column) -> Column:
    """NULL-safe: a rule that evaluates to NULL counts as not violated."""
    return F.coalesce(c, F.lit(False))


def violation_counts(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    """(table, rule, n_rows, n_violations) for every rule, from one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    names = list(rules)
    for i, n in enumerate(names):
        aggs.append(F.count(F.when(_bad(rules[n]), 1)).alias(f"r{i}"))
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(table).alias("table"), F.lit(n).alias("rule"),
                        F.col("_n").alias("n_rows"), F.col(f"r{i}").alias("n_violations"))
               for i, n in enumerate(names)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def violations(df: DataFrame, table: str, rules: Rules, key: list[str] | None = None) -> DataFrame:
    """Offending rows: (table, rule, key...) per violated rule."""
    key = key or []
    names = list(rules)
    failed = F.filter(F.array(*[F.when(_bad(rules[n]), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return (df.select(*key, failed.alias("_failed")).where(F.size("_failed") > 0)
            .select(F.lit(table).alias("table"), *key, F.explode("_failed").alias("rule")))


STRICT = ("type:", "required:", "missing:", "absent:", "null:", "syntax:", "single:")


def raise_on_violations(counts: DataFrame) -> None:
    """Strict mode: raise ValueError for the first strict rule with violations;
    warnings don't raise."""
    strict = F.lit(False)
    for prefix in STRICT:
        strict |= F.col("rule").startswith(prefix)
    bad = counts.where(strict & (F.col("n_violations") > 0)).first()
    if bad is not None:
        raise ValueError(f"{bad['table']}: {bad['n_violations']} row(s) violate '{bad['rule']}'")


# -- source records ---------------------------------------------------------------

def required_rules(fields, prefix: str = "") -> Rules:
    """One null check per required field."""
    return {f"required:{f}": F.col(f"{prefix}{f}").isNull() for f in fields}


def order_rules() -> Rules:
    """Required fields and non-negative money of an order."""
    r = required_rules(REQUIRED_FIELDS["orders"])
    for f in ("subtotal_price", "total_price", "cost_total", "shipping_discount_amount"):
        r[f"non_negative:{f}"] = F.col(f) < 0
    return r


def lineitem_rules() -> Rules:
    """Required fields, positive quantity and non-negative money of a line item."""
    r = required_rules(REQUIRED_FIELDS["lineitems"])
    r["positive:quantity"] = F.col("quantity") <= 0
    r["non_negative:price"] = F.col("price") < 0
    r["non_negative:total_discount"] = F.col("total_discount") < 0
    return r


def campaign_rules() -> Rules:
    """Required fields of a campaign; endAt may be null but not before startAt."""
    r = required_rules(REQUIRED_FIELDS["campaigns"])
    r["end_after_start"] = F.col("endAt") < F.col("startAt")
    return r


def validate_orders(orders: DataFrame) -> DataFrame:
    """Counts per rule over nested orders (ORDER schema); also flags duplicate ids."""
    dup = (orders.where(F.col("id").isNotNull()).groupBy("id").count().where(F.col("count") > 1)
           .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")))
    counts = violation_counts(orders, "orders", {**record_rules(orders), **order_rules()})
    dup_row = dup.select(F.lit("orders").alias("table"), F.lit("unique:id").alias("rule"),
                         F.lit(None).cast("bigint").alias("n_rows"), F.col("n").cast("bigint").alias("n_violations"))
    return counts.unionByName(dup_row)


def validate_lineitems(orders: DataFrame) -> DataFrame:
    """Counts per rule over every nested line item (exploded, no shuffle)."""
    items = orders.select(F.explode("line_items").alias("li")).select("li.*")
    return violation_counts(items, "lineitems", lineitem_rules())


def record_rules(df: DataFrame) -> Rules:
    """The parse rule of records read with ``record_ok`` (``sources.export``)."""
    return {"type:record": ~F.col("record_ok")} if "record_ok" in df.columns else {}


def validate_campaigns(campaigns: DataFrame) -> DataFrame:
    """Counts per rule over campaign records."""
    return violation_counts(campaigns, "campaigns", {**record_rules(campaigns), **campaign_rules()})


def validate_nested(orders: DataFrame) -> DataFrame:
    """Counts per list and required field that campaign records nested in orders
    and line items lack (one walk of the contract, see ``contracts``; orders that
    come with their list of breaches aren't walked again). Fields that no record
    lacks have no row."""
    if contracts.FOUND in orders.columns:
        found = contracts.listed_breaches(orders, "orders")
    else:
        found = contracts.row_breaches(orders.drop("record_ok"), "orders")
    parts = F.regexp_extract_all("path", F.lit(r"(\w+)(?:\[\d+\])?"), F.lit(1))
    inner = (found.select(F.try_element_at(parts, F.lit(-2)).alias("table"), F.concat(F.lit("required:"), F.try_element_at(parts, F.lit(-1))).alias("rule"))
             .where(F.col("table").isin("applied_campaigns", "order_campaigns", "campaign_discounts")))
    return counts_as_rules(inner.groupBy("table", "rule").agg(F.count("*").alias("n_violations")))


def counts_as_rules(counts: DataFrame) -> DataFrame:
    """Breach counts in the columns of ``violation_counts``."""
    return counts.select("table", "rule", F.lit(None).cast("bigint").alias("n_rows"), "n_violations")


def single_record(df: DataFrame, table: str) -> DataFrame:
    """The rule that there is exactly one record; with another number, that many
    (one at least) count as violations."""
    return df.agg(F.count("*").alias("n")).select(
        F.lit(table).alias("table"), F.lit("single:record").alias("rule"), F.col("n").alias("n_rows"),
        F.when(F.col("n") == 1, F.lit(0)).otherwise(F.greatest("n", F.lit(1))).cast("bigint").alias("n_violations"))


# -- derived frames ------------------------------------------------------------------

def class_rules() -> Rules:
    """Movement class in its domain; sufficiency flag present."""
    return {"domain:movement_class": ~F.col("movement_class").isin(*MOVEMENT_CLASSES)
            | F.col("movement_class").isNull(),
            "required:data_sufficient": F.col("data_sufficient").isNull()}


def profile_rules() -> Rules:
    """Product-profile contract: required fields and class domain."""
    r = {f"required:{c}": F.col(c).isNull() for c in
         ("product_id", "title", "units_sold", "revenue", "gross_margin_alloc", "margin_pct",
          "velocity_per_day", "data_sufficient")}
    r.update(class_rules())
    return r


def verdict_rules() -> Rules:
    """Campaign-verdict contract: verdict domain, confidence in [0, 1]."""
    return {"domain:verdict": ~F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull(),
            "range:confidence": ~F.col("confidence").between(0.0, 1.0) | F.col("confidence").isNull(),
            "required:reason_code": F.col("reason_code").isNull(),
            "non_negative:window_days": F.col("window_days") < 0}


def recommendation_rules() -> Rules:
    """Recommendation contract: mechanic domain, confidence range, finite priority."""
    score = F.col("priority_score")
    return {"domain:recommended_mechanic": ~F.col("recommended_mechanic").isin(*MECHANICS)
            | F.col("recommended_mechanic").isNull(),
            "required:product_id": F.col("product_id").isNull(),
            "required:title": F.col("title").isNull(),
            "range:confidence": ~F.col("confidence").between(0.0, 1.0) | F.col("confidence").isNull(),
            "finite:priority_score": score.isNull() | F.isnan(score)
            | (F.abs(score) == F.lit(float("inf"))),
            "required:rationale": F.col("rationale").isNull(),
            "required:expected_effect": F.col("expected_effect").isNull()}


def segment_rules() -> Rules:
    """Segment contract: mechanic domain, priority 1-5, non-empty."""
    return {"domain:discount_mechanic": ~F.col("discount_mechanic").isin(*SEGMENT_MECHANICS)
            | F.col("discount_mechanic").isNull(),
            "required:segment_id": F.col("segment_id").isNull(),
            "required:segment_label": F.col("segment_label").isNull(),
            "required:rationale": F.col("rationale").isNull(),
            "range:priority": ~F.col("priority").between(1, 5) | F.col("priority").isNull(),
            "non_empty:segment": F.col("n_products") <= 0}


def segment_evidence_rules() -> Rules:
    """The segment contract with evidence: products, impact and refs are given."""
    def none_in(name):
        return F.col(name).isNull() | (F.size(name) == 0) | F.exists(name, lambda x: x.isNull())

    return {**segment_rules(), "required:expected_impact": F.col("expected_impact").isNull(),
            "non_empty:product_ids": none_in("product_ids"),
            "non_empty:supporting_evidence_refs": none_in("supporting_evidence_refs")}


MARGIN_METHOD = "line net revenue less order cost allocated by revenue share"
CLASS_METHOD = "tertiles of velocity over products with enough units"


def product_profiles(classified: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """Typed product profiles with an evidence map of the supporting numbers and
    methods."""
    def stamp(name: str) -> Column:
        # UTC text, whatever the session's zone
        seconds = F.floor(F.unix_micros(F.col(name)) / F.lit(1_000_000))
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
        return F.coalesce(day.cast("string"), F.lit(""))

    ev = F.create_map(
        F.lit("units_sold"), F.col("units_sold").cast("string"),
        F.lit("revenue"), F.col("revenue").cast(T.DecimalType(20, 4)).cast("string"),
        F.lit("allocated_cost"), F.col("allocated_cost").cast(T.DecimalType(20, 4)).cast("string"),
        F.lit("window_days"), F.col("window_days").cast("string"),
        F.lit("data_sufficient"), F.col("data_sufficient").cast("string"),
        F.lit("velocity_per_day"), F.col("velocity_per_day").cast(T.DecimalType(20, 6)).cast("string"),
        F.lit("margin_method"), F.lit(MARGIN_METHOD),
        F.lit("classification_method"), F.lit(CLASS_METHOD),
        F.lit("min_units"), F.lit(str(min_units)),
        F.lit("first_order_date"), stamp("product_first_order_date"),
        F.lit("last_order_date"), stamp("product_last_order_date"),
        F.lit("insufficiency_note"), F.when(F.col("data_sufficient"), F.lit("")).otherwise(
            F.concat(F.col("units_sold").cast("string"), F.lit(f" of {min_units} units"))),
        F.lit("truth_caveat"), F.lit("structural per-line fields; indicative only"),
    )
    return classified.select("product_id", "title", "units_sold", "revenue", "gross_margin_alloc",
                             "margin_pct", "velocity_per_day", "movement_class", "data_sufficient",
                             ev.alias("evidence"))
