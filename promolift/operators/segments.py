"""Segment proposals: products grouped by (movement_class, margin_band,
recommended_mechanic), ranked into priorities 1-5.

The grouping rule follows the original strategy step; the ranking rule is ours
(the original leaves it to a language model): segments are ordered by their
best priority_score, then size, and the ranks spread evenly over 1 to 5.

A segment can hold any number of products, so membership is a separate table
(``segment_members``: one row per product) instead of an id list gathered into
one row. The segment table itself has at most 3 x 3 x 9 rows (fixed domains),
so ordering it in one partition is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

KEYS = ("movement_class", "margin_band", "recommended_mechanic")


def segment_key() -> F.Column:
    """Segment id: movement_class/margin_band/recommended_mechanic."""
    return F.concat_ws("/", *[F.col(k) for k in KEYS])


def segment_members(recs: DataFrame) -> DataFrame:
    """(segment_id, product_id, title, priority_score) per recommendation."""
    return recs.select(segment_key().alias("segment_id"), "product_id", "title", "priority_score")


def segment_proposals(recs: DataFrame) -> DataFrame:
    """One row per segment: label, mechanic, size, priority 1-5, evidence."""
    agg = recs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_products"),
        F.max("priority_score").alias("max_priority_score"),
        F.sum(F.col("confidence").cast(T.DecimalType(6, 2))).alias("_conf_sum"),
        F.min("product_id").alias("first_product_id"),
        F.sum("units_sold").cast(T.LongType()).alias("units_sold"),
    )
    # at most 81 segments: the two windows without partitions are bounded
    order = Window.orderBy(F.desc("max_priority_score"), F.desc("n_products"), *KEYS)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    label = F.concat(F.col("margin_band"), F.lit("-margin "), F.col("movement_class"), F.lit(" movers"))
    return agg.select(
        segment_key().alias("segment_id"),
        label.alias("segment_label"),
        F.col("recommended_mechanic").alias("discount_mechanic"),
        "movement_class", "margin_band", "n_products", "units_sold", "first_product_id",
        "max_priority_score",
        F.round(F.col("_conf_sum").cast(T.DoubleType()) / F.col("n_products").cast(T.DoubleType()), 4)
         .alias("avg_confidence"),
        F.row_number().over(order).alias("segment_rank"),
        F.ceil(F.lit(5) * F.row_number().over(order) / F.count(F.lit(1)).over(everything))
         .cast(T.IntegerType()).alias("priority"),
        F.concat(F.lit("Apply "), F.col("recommended_mechanic"), F.lit(" to "), label, F.lit(".")).alias("rationale"),
        F.concat(F.lit("Qualitative: "), F.col("recommended_mechanic"), F.lit(" expected to suit "),
                 F.col("n_products").cast("string"), F.lit(" products.")).alias("expected_impact"),
        F.array(F.concat(F.lit("segment_products:"), F.col("n_products").cast("string")),
                F.concat(F.lit("max_priority_score:"), F.col("max_priority_score").cast("string")),
                F.concat(F.lit("mechanic:"), F.col("recommended_mechanic"))).alias("supporting_evidence_refs"),
    )


def segment_evidence(recs: DataFrame, campaign_refs: DataFrame, k: int = 5) -> DataFrame:
    """(segment_id, product_ids, evidence_refs): of each segment the ``k`` products
    with the highest priority score (ties: smaller id, then title), with their
    scores, and the first ``k`` campaigns behind its recommendations, in input
    order. ``campaign_refs`` are the campaigns of each policy
    (``rules.policy_campaign_refs``).

    The limit on the rank is applied in every task before the shuffle, so a
    segment with most of the products sends ``k`` rows per task, never its
    members; the lists hold at most 2 ``k`` entries."""
    def first(df: DataFrame, *order) -> DataFrame:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("segment_id").orderBy(*order)))
        return ranked.where(F.col("_rank") <= k)

    keyed = recs.select(segment_key().alias("segment_id"), "product_id", "title", "priority_score", "policy_id")
    products = first(keyed, F.desc("priority_score"), "product_id", "title").select(
        "segment_id", F.lit(0).alias("_kind"), "_rank", "product_id",
        F.concat(F.lit("product:"), F.col("product_id").cast("string"), F.lit(":"), F.col("priority_score").cast("string")).alias("ref"))
    policies = keyed.where(F.col("policy_id").isNotNull()).select("segment_id", "policy_id").distinct()
    campaigns = first(policies.join(campaign_refs, "policy_id").select("segment_id", "pos", "ref").distinct(), "pos", "ref").select(
        "segment_id", F.lit(1).alias("_kind"), "_rank", F.lit(None).cast("bigint").alias("product_id"), "ref")
    listed = products.unionByName(campaigns).groupBy("segment_id").agg(
        F.array_sort(F.collect_list(F.struct("_kind", "_rank", "product_id", "ref"))).alias("_e"))
    return listed.select(
        "segment_id", F.transform(F.filter("_e", lambda e: e["_kind"] == 0), lambda e: e["product_id"]).alias("product_ids"),
        F.transform("_e", lambda e: e["ref"]).alias("evidence_refs"))


def with_evidence(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals with ``product_ids`` and the evidence added to their own refs."""
    out = proposals.join(evidence, "segment_id", "left")
    return out.withColumn("supporting_evidence_refs", F.concat(
        "supporting_evidence_refs", F.coalesce("evidence_refs", F.array().cast("array<string>")))).drop("evidence_refs")
