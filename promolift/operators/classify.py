"""Product movement classification: fast / medium / slow velocity tertiles.

Branches (decided from one stats row, never by collecting data to the driver):

* units_sold < min_units            -> insufficient, class "slow"
* 0 sufficient products             -> all slow
* 1-2 sufficient                    -> highest velocity "fast" (tie: smallest
                                       product_id, title), others slow
* >= 3, all velocities identical    -> all slow
* >= 3, tertile edges repeat        -> rank fallback: average ascending rank r,
                                       r <= n/3 slow, r <= 2n/3 medium, else fast
* >= 3 otherwise                    -> v <= q(1/3) slow, v <= q(2/3) medium, else fast

Classes never fall as velocity rises, so two thresholds from one row of exact
order statistics (``functions.quantiles``) decide every product's class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import as_scalar, edges_repeated, tertile_stats
from ..schemas import MIN_UNITS

VELOCITY = "velocity_per_day"
REQUIRED = ("product_id", "title", "units_sold", VELOCITY, "revenue",
            "gross_margin_alloc", "margin_pct")


def require_columns(df: DataFrame, cols=REQUIRED) -> None:
    """Raise ValueError naming any required product column that is missing."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"classify: products are missing required columns {missing}")


def with_sufficiency(products: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """Add ``data_sufficient`` = units_sold >= min_units."""
    return products.withColumn("data_sufficient", F.col("units_sold") >= F.lit(min_units))


def classification_plan(sufficient: DataFrame) -> DataFrame:
    """One row describing the branch the classifier takes for these velocities."""
    distinct = sufficient.agg(F.count_distinct(VELOCITY).alias("d")).scalar()
    stats = tertile_stats(sufficient, VELOCITY).withColumn("n_distinct", distinct)
    s = F.struct(*[F.col(c) for c in stats.columns])
    method = (F.when(F.col("n") == 0, F.lit("none_sufficient"))
              .when(F.col("n") < 3, F.lit("top_one_fast"))
              .when(F.col("n_distinct") == 1, F.lit("all_identical"))
              .when(edges_repeated(s), F.lit("rank_fallback"))
              .otherwise(F.lit("quantile_tertiles")))
    return stats.select(
        "n", "n_distinct",
        (F.col("n_distinct") == 1).alias("all_identical"),
        F.coalesce(edges_repeated(s), F.lit(False)).alias("edges_repeated"),
        method.alias("method"),
        F.col("q1").alias("edge_low"), F.col("q2").alias("edge_high"))


def top_velocity_product(sufficient: DataFrame) -> DataFrame:
    """One row: the product with the highest velocity (tie: smallest id, title)."""
    best = F.min(F.struct(F.negative(F.col(VELOCITY)).alias("neg_v"),
                          F.col("product_id").alias("product_id"),
                          F.col("title").alias("title")))
    return sufficient.agg(best.alias("top")).select(
        F.col("top.product_id").alias("product_id"), F.col("top.title").alias("title"),
        F.negative(F.col("top.neg_v")).alias(VELOCITY))


def _class_by(slow: Column, medium: Column) -> Column:
    """Class of a velocity from the greatest slow and the greatest medium one."""
    v = F.col(VELOCITY)
    return F.when(v <= slow, F.lit("slow")).when(v <= medium, F.lit("medium")).otherwise(F.lit("fast"))


def assign_tertiles_rank(sufficient: DataFrame) -> DataFrame:
    """The rank-based tertile method applied directly (used as the fallback)."""
    stats = as_scalar(tertile_stats(sufficient, VELOCITY))
    by = _class_by(stats["rank_slow"], stats["rank_medium"])
    return sufficient.select(VELOCITY, *[c for c in sufficient.columns if c != VELOCITY],
                             F.when(F.col(VELOCITY).isNotNull(), by).alias("rank_class"))


def classify_products(products: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """Add ``data_sufficient`` and ``movement_class`` to product metrics."""
    require_columns(products)
    df = with_sufficiency(products, min_units)
    sufficient = df.where(F.col("data_sufficient"))
    top = as_scalar(top_velocity_product(sufficient))
    stats = as_scalar(tertile_stats(sufficient, VELOCITY))
    identical, repeated = stats["s0"] == stats["smax"], edges_repeated(stats)
    slow = F.when(identical, stats["smax"]).when(repeated, stats["rank_slow"]).otherwise(stats["sa"])
    medium = F.when(repeated, stats["rank_medium"]).otherwise(stats["sc"])
    is_top = (F.col("product_id") == top["product_id"]) & (F.col("title") == top["title"])
    movement = (F.when(~F.col("data_sufficient"), F.lit("slow"))
                .when(F.coalesce(stats["n"], F.lit(0)) < 3, F.when(is_top, F.lit("fast")).otherwise(F.lit("slow")))
                .when(F.col(VELOCITY).isNotNull(), _class_by(slow, medium)))
    return df.select(*products.columns, "data_sufficient", movement.alias("movement_class"))


def class_counts(classified: DataFrame) -> DataFrame:
    """Number of products per movement class."""
    return classified.groupBy("movement_class").agg(F.count(F.lit(1)).alias("n_products"))
