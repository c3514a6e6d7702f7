"""End-to-end composite: lines -> metrics -> classes -> campaign verdicts ->
recommendations (and segment proposals).

Stage boundaries that feed several consumers are materialized once as
Parquet in the shared checkpoint folder:

* line margins (line-sized) feed product metrics and campaign evaluation;
* products and classified products (product-sized) feed the order-statistic
  subqueries and the recommendation join;
* the campaign evaluation (one row per campaign) feeds evidence, policy and refs.

Everything else stays one lazy plan per stage.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.quantiles import as_scalar
from ..operators import campaigns as CE
from ..operators import classify as C
from ..operators import flatten as FL
from ..operators import metrics as M
from ..operators import privacy as PV
from ..operators import rules as R
from ..operators import segments as S
from ..schemas import MIN_UNITS
from ..session import materialize, remove_staged
from ..sources import sinks as SK
from .intake import build_clean_frames


class PromoPipeline:
    """Lazily built, materialized stages over one shop's flat frames."""

    def __init__(self, lines: DataFrame, orders: DataFrame, campaigns: DataFrame,
                 min_units: int = MIN_UNITS, affinity: DataFrame | None = None,
                 materialized: bool = True):
        self.lines = lines
        self.orders = orders
        self.campaigns = campaigns
        self.min_units = min_units
        self.affinity = affinity
        self.materialized = materialized
        self.staged: list[str] = []
        # lines, clipped_lines, orders (with lines), zero_revenue_orders: counted in the pass that writes line margins
        self.observed: dict[str, int] = {}

    @classmethod
    def from_nested_orders(cls, orders: DataFrame, campaigns: DataFrame, min_units: int = MIN_UNITS,
                           affinity: DataFrame | None = None, materialized: bool = True) -> "PromoPipeline":
        """Start from export orders with nested line items (ORDER schema):
        personal data dropped, lines exploded with each order's net revenue
        folded from its own nested lines, so cost allocation needs no
        order-level shuffle."""
        clean = PV.minimize_orders(orders)
        lines = FL.to_lineitems(clean, with_order_net=True)
        return cls(lines, FL.to_orders(clean), FL.to_campaigns(campaigns), min_units=min_units,
                   affinity=affinity, materialized=materialized)

    @classmethod
    def from_export(cls, orders: DataFrame, campaigns: DataFrame, shop: DataFrame, min_units: int = MIN_UNITS,
                    affinity: DataFrame | None = None, strict: bool = True) -> "PromoPipeline":
        """``from_nested_orders`` behind the validating intake
        (``intake.build_clean_frames``): nothing bad reaches the metrics silently."""
        clean = build_clean_frames(orders, campaigns, shop, strict)
        lines = FL.to_lineitems(clean.nested_orders, with_order_net=True)
        out = cls(lines, clean.orders, clean.campaigns, min_units=min_units, affinity=affinity)
        out.staged += clean.staged
        return out

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label, self.staged) if self.materialized else df

    def close(self) -> None:
        """Remove this run's staged tables. Results that were not written or
        collected before can't be read afterwards."""
        if self.staged:
            remove_staged(self.lines.sparkSession, self.staged)
            self.staged.clear()

    def __enter__(self) -> "PromoPipeline":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def outputs(self) -> dict[str, DataFrame]:
        """The seven result tables of a run."""
        return {"orders_clean": self.orders, "lineitems_clean": self.lines.drop("order_net_revenue", "first_line"),
                "campaigns_clean": self.campaigns, "product_metrics": self.products,
                "product_classification": self.classified, "campaign_eval": self.campaign_eval,
                "recommendations": self.kept_recommendations}

    def write_outputs(self, path: str, compression: str | None = None) -> dict[str, str]:
        """Write the seven result tables as CSV datasets under ``path``, compressed
        if a codec is given; returns their folders."""
        out = {}
        for name, df in self.outputs().items():
            out[name] = f"{path.rstrip('/')}/{name}"
            SK.write_csv(df, out[name], compression)
        return out

    @cached_property
    def line_margin(self) -> DataFrame:
        lines = M.compute_line_revenue(self.lines)
        if "order_net_revenue" not in lines.columns:
            # one pass: order sums on the lines as they lie by order, nothing written or joined back for them
            used = [c for c in lines.columns if c in M.LINE_MARGIN_COLUMNS or c == "net_clipped"]
            lines = M.with_order_net_revenue(lines.select(*used))
        seen = Observation("line-margin")
        counts = [F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("net_clipped"), 1)).alias("clipped_lines")]
        # an order is counted at its first line
        counts += [F.count(F.when(F.col("first_line"), 1)).alias("orders"),
                   F.count(F.when(F.col("first_line") & (F.col("order_net_revenue") == 0), 1)).alias("zero_revenue_orders")]
        lm = M.prepare_line_margin(lines.observe(seen, *counts)).select(*M.LINE_MARGIN_COLUMNS)
        if not self.materialized:
            return lm
        out = materialize(lm, "line-revenue-margin", self.staged)
        self.observed = dict(seen.get)
        return out

    # ``*_plan``: the stage as a lazy plan, for a caller that reads it once;
    # the plain properties are the materialized stages other stages build on.
    @cached_property
    def products_plan(self) -> DataFrame:
        return M.compute_product_metrics(self.line_margin)

    @cached_property
    def products(self) -> DataFrame:
        return self._keep(self.products_plan, "products")

    @cached_property
    def classified_plan(self) -> DataFrame:
        return C.classify_products(self.products, min_units=self.min_units)

    @cached_property
    def classified(self) -> DataFrame:
        return self._keep(self.classified_plan, "classified")

    @cached_property
    def campaign_eval_plan(self) -> DataFrame:
        return CE.evaluate_campaigns(self.orders, self.line_margin, self.campaigns, self.staged)

    @cached_property
    def campaign_eval(self) -> DataFrame:
        return self._keep(self.campaign_eval_plan, "campaign-eval")

    @cached_property
    def banded(self) -> DataFrame:
        return R.margin_bands(self.classified)

    @cached_property
    def evidence(self) -> DataFrame:
        return R.campaign_evidence(self.campaign_eval)

    @cached_property
    def policy(self) -> DataFrame:
        return R.resolved_policy(self.lines.sparkSession, self.campaign_eval)

    @cached_property
    def policy_campaign_refs(self) -> DataFrame:
        return R.policy_campaign_refs(self.policy, self.campaign_eval)

    @cached_property
    def recommendations(self) -> DataFrame:
        return R.recommend_for_products(self.classified, self.campaign_eval, self.affinity,
                                        min_units=self.min_units)

    @cached_property
    def kept_recommendations(self) -> DataFrame:
        return self._keep(self.recommendations, "recommendations")

    def segments(self) -> DataFrame:
        return S.segment_proposals(self.kept_recommendations)

    def segments_with_evidence(self, k: int = 5) -> DataFrame:
        """Segments with their best products and the campaigns behind them."""
        return S.with_evidence(self.segments(), S.segment_evidence(self.kept_recommendations, self.policy_campaign_refs, k))

    def summary(self) -> DataFrame:
        """One row of headline counts over every stage (G16)."""
        recs = self.kept_recommendations
        ce = self.campaign_eval
        rec_stats = recs.agg(
            F.count(F.lit(1)).alias("n_recommendations"),
            F.count(F.when(F.col("data_sufficient"), 1)).alias("n_sufficient"),
            F.count(F.when(F.col("movement_class") == "fast", 1)).alias("n_fast"),
            F.count(F.when(F.col("movement_class") == "medium", 1)).alias("n_medium"),
            F.count(F.when(F.col("movement_class") == "slow", 1)).alias("n_slow"),
            F.count(F.when(F.col("recommended_mechanic") == "Collect more data", 1)).alias("n_collect_more_data"),
        )
        ce_stats = ce.agg(
            F.count(F.lit(1)).alias("n_campaigns"),
            F.count(F.when(F.col("verdict") == "success", 1)).alias("n_success"),
            F.count(F.when(F.col("verdict") == "flop", 1)).alias("n_flop"),
            F.count(F.when(F.col("verdict") == "inconclusive", 1)).alias("n_inconclusive"),
        )
        lm_stats = self.line_margin.agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.countDistinct("order_id").alias("n_orders_with_lines"),
            M.dataset_window(self.line_margin).select("window_days").scalar().alias("window_days"))
        ce_s, lm_s = as_scalar(ce_stats), as_scalar(lm_stats)
        return rec_stats.select(
            "*", *[ce_s[c].alias(c) for c in ce_stats.columns],
            *[lm_s[c].alias(c) for c in lm_stats.columns])
