"""Intake composite: export records -> validated, audited, clean frames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators import contracts as CT
from ..operators import flatten as FL
from ..operators import privacy as PV
from ..operators import validate as V
from ..schemas import SHOP_COLUMNS
from ..session import materialize, remove_staged


@dataclass
class CleanFrames:
    """Clean tables of one shop, with the rule and audit counts of the intake.

    ``breaches`` has a row for each breach of the record contract (table, row_id,
    path, reason); ``observed`` the records read and rejected per table, counted
    in the pass that wrote them."""

    orders: DataFrame
    lineitems: DataFrame
    campaigns: DataFrame
    shop: DataFrame
    nested_orders: DataFrame
    rule_counts: DataFrame
    audit_counts: DataFrame
    breaches: DataFrame
    observed: dict[str, dict[str, int]] = field(default_factory=dict)
    staged: list[str] = field(default_factory=list)

    def frames(self) -> dict[str, DataFrame]:
        return {"orders": self.orders, "lineitems": self.lineitems, "campaigns": self.campaigns, "shop": self.shop}

    def close(self) -> None:
        """Remove the staged input; the frames can't be read afterwards."""
        if self.staged:
            remove_staged(self.shop.sparkSession, self.staged)
            self.staged.clear()


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kept(df: DataFrame, table: str, staged: list[str], observed: dict[str, dict[str, int]]) -> DataFrame:
    """Records without personal fields and with their breaches, written once."""
    if CT.RECORD not in df.columns:
        if table == "orders":
            df = PV.minimize_orders(df)
        elif table == "shop":
            df = df.select(*SHOP_COLUMNS, *[c for c in ("record_ok",) if c in df.columns])
    seen = Observation(f"intake-{table}")
    out = CT.listed(df, table).observe(
        seen, F.count(F.lit(1)).alias("records"), F.count(F.when(F.size(CT.FOUND) > 0, 1)).alias("rejected"))
    out = materialize(out, f"clean-{table}", staged)
    observed[table] = dict(seen.get)
    return out


def build_clean_frames(orders: DataFrame, campaigns: DataFrame, shop: DataFrame, strict: bool = True) -> CleanFrames:
    """Drop personal fields, validate every record, flatten, and audit every
    clean frame (line items included) for personal data.

    The three inputs are export records: VARIANT records (``read_records``), or
    typed rows, with ``record_ok`` where they were read from JSON Lines. Each is
    read once: its declared columns, without personal fields, are written with
    the list of its breaches, and rules, audits and flattening read files.
    ``strict`` raises a ValueError on the first breach of the record contract at
    any depth, if there isn't exactly one shop, and on any personal data found;
    without it the counts say what was found and bad values stay in the frames as
    nulls. Warnings (signs, date order, duplicate ids) never raise.
    """
    staged: list[str] = []
    observed: dict[str, dict[str, int]] = {}
    given = {"orders": orders, "campaigns": campaigns, "shop": shop}
    kept = {table: _kept(df, table, staged, observed) for table, df in given.items()}
    nested, camps, store = (kept[t].drop(CT.FOUND) for t in given)
    found = _union(CT.listed_breaches(kept[t], t) for t in given)
    rules = _union([V.validate_orders(nested), V.validate_lineitems(nested), V.validate_campaigns(camps)])
    by_walk = [t for t in given if CT.RECORD in given[t].columns]
    if "orders" not in by_walk:
        rules = rules.unionByName(V.validate_nested(kept["orders"]))
    rules = rules.where(~(F.col("rule").startswith("required:") & F.col("table").isin(
        *by_walk, *(["lineitems"] if "orders" in by_walk else []))))
    rules = rules.unionByName(V.single_record(store, "shop")).unionByName(V.counts_as_rules(
        CT.breach_counts(found.where(F.col("table").isin("shop", *by_walk)))))
    out = CleanFrames(FL.to_orders(nested), FL.to_lineitems(nested), FL.to_campaigns(camps), PV.minimize_shop(store),
                      nested, rules, rules, found, observed, staged)
    out.audit_counts = _union(PV.pii_value_scan(df, name) for name, df in out.frames().items())
    if strict:
        try:
            V.raise_on_violations(rules)
            PV.assert_no_pii(out.frames())
        except ValueError:
            out.close()
            raise
    return out
