"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written as plain SQL over the driver's views (lineitem, orders, part, ...).
Fragments are CTE bodies composed per query; each final SELECT aliases every
column exactly like the Spark query. Money is exact DECIMAL and only converted
to DOUBLE at the end (DECIMAL(18,s) first, so the conversion is exact).
"""

from __future__ import annotations

MIN_UNITS_DEFAULT = 500

# Fixed values, written out here and not imported, so that a wrong value in the
# library shows as a difference.
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
RATIONALE = {
    ("high", "fast"): ("keep_price_fast_high_margin",
                       "Demand already carries this product and its margin is among the best: leave the price alone."),
    ("high", "medium"): ("bundle_medium_high_margin",
                         "Average demand with a wide margin: pay for extra units through bundles or volume steps."),
    ("high", "slow"): ("bxgy_slow_high_margin",
                       "Weak demand with a wide margin: give units away with purchases rather than cutting the price."),
    ("mid", "fast"): ("keep_price_fast_mid_margin",
                      "Strong demand at an average margin: keep the price until a campaign result speaks for a change."),
    ("mid", "medium"): ("no_specific_rule", "Average demand at an average margin: nothing calls for an offer yet."),
    ("mid", "slow"): ("bundle_slow_mid_margin", "Weak demand at an average margin: try bundles or volume steps first."),
    ("low", "fast"): ("shipping_or_keep_fast_low_margin",
                      "Strong demand at a small margin: at most help with shipping, never with the item price."),
    ("low", "medium"): ("avoid_discount_low_margin", "Average demand at a small margin: no offer that costs margin."),
    ("low", "slow"): ("avoid_discount_slow_low_margin",
                      "Weak demand at a small margin: an offer would lose money on every unit."),
}
CAVEAT_STRUCTURAL = "caveat:product_fields_are_structural"
CAVEAT_TEXT = "Product-level figures rest on structural per-line fields; read them as indicative."
SHIPPING_TEXT = "Shipping is attributed at order level, so its effect is approximate."
ERODED_TEXT = "A past campaign lifted volume but eroded margin; watch margin on volume promotions."
CAMPAIGN_TYPE_TO_MECHANIC = {"shipping": "Free Shipping", "buy_one_get_one": "BXGY", "volume": "Volume/Bundle",
                             "order": "Order-level Discount", "general": "Generic Discount"}
MECHANIC_TO_CAMPAIGN_TYPE = {"Free Shipping": "shipping", "BXGY": "buy_one_get_one", "Volume/Bundle": "volume",
                             "Order-level Discount": "order", "Generic Discount": "general"}
MECHANIC_EFFORT = {"Leave/minimal discount": 1.0, "Free Shipping": 2.0, "BXGY": 3.0, "Volume/Bundle": 3.0,
                   "Bundle/Cross-sell": 4.0, "Collect more data": 1.0, "Avoid deeper discounts": 1.0,
                   "Order-level Discount": 2.0, "Generic Discount": 2.0}
OPPORTUNITY_VALUE = {"high": 3.0, "medium": 2.0, "low": 1.0}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3}
FALLBACK_ORDER = ("Volume/Bundle", "BXGY", "Free Shipping", "Avoid deeper discounts", "Leave/minimal discount")
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# -- stand-in shop input ------------------------------------------------------

ADAPTER = """
o_x AS (
  SELECT o_orderkey AS order_id, o_orderstatus,
         CAST(o_orderdate AS TIMESTAMP) AS createdAt,
         CAST(o_totalprice AS DECIMAL(14,2)) AS total_price,
         CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.2 AS DECIMAL(2,1)) AS DECIMAL(16,3)) AS cost_total,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'k6'
              WHEN o_orderpriority = '2-HIGH' THEN 'k7'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'k1'
              WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 500 = 0 THEN 'k8' END AS oc_id
  FROM orders),
sh_orders AS (
  SELECT *, CAST(CASE WHEN oc_id IN ('k6', 'k8') THEN 9.99 ELSE 0 END AS DECIMAL(4,2)) AS shipping_discount_amount
  FROM o_x),
sh_campaigns AS (
  SELECT * FROM (VALUES (0, 'k1', 'buy_one_get_one'), (1, 'k2', 'volume'), (2, 'k3', 'general'),
                        (3, 'k4', 'volume'), (4, 'k5', 'general'), (5, 'k6', 'shipping'),
                        (6, 'k7', 'order'), (7, 'k8', 'shipping'), (8, 'k9', 'general'))
         AS t(campaign_pos, id, type)),
sh_pairs AS (
  SELECT DISTINCT oc_id AS campaign_id, order_id FROM sh_orders WHERE oc_id IS NOT NULL),
sh_lines AS (
  SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, l.l_suppkey AS variant_id,
         p.p_name AS title, CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(CAST(l.l_quantity AS DECIMAL(6,0)) * CAST(p.p_retailprice AS DECIMAL(12,2)) AS DECIMAL(14,2))
              * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS total_discount,
         o.cost_total, o.createdAt, o.shipping_discount_amount,
         CASE WHEN CAST(ROUND(l.l_discount * 100) AS INTEGER) BETWEEN 1 AND 5 THEN 'k1'
              WHEN CAST(ROUND(l.l_discount * 100) AS INTEGER) IN (6, 7) THEN 'k2'
              WHEN CAST(ROUND(l.l_discount * 100) AS INTEGER) = 8 THEN 'k3'
              WHEN CAST(ROUND(l.l_discount * 100) AS INTEGER) = 9 THEN 'k5'
              WHEN CAST(ROUND(l.l_discount * 100) AS INTEGER) = 10 AND l.l_linenumber = 7
                   AND o.o_orderstatus = 'P' THEN 'k4' END AS active_campaign_id
  FROM lineitem l JOIN sh_orders o ON l.l_orderkey = o.order_id JOIN part p ON l.l_partkey = p.p_partkey)
"""

# -- line metrics -------------------------------------------------------------

LINE_METRICS = """
lr0 AS (
  SELECT *, CAST(quantity AS DECIMAL(20,0)) * price AS line_gross_revenue,
         CAST(quantity AS DECIMAL(20,0)) * price - total_discount AS raw_net
  FROM sh_lines),
lr AS (
  SELECT * EXCLUDE (raw_net), raw_net < 0 AS net_clipped,
         CASE WHEN raw_net < 0 THEN 0 ELSE raw_net END AS line_net_revenue
  FROM lr0),
onr AS (SELECT order_id, SUM(line_net_revenue) AS order_net_revenue FROM lr GROUP BY order_id),
la AS (
  SELECT lr.*, CAST(ROUND(CAST(lr.cost_total AS DOUBLE) *
           CASE WHEN onr.order_net_revenue > 0
                THEN CAST(lr.line_net_revenue AS DOUBLE) / CAST(onr.order_net_revenue AS DOUBLE)
                ELSE 0.0 END, 6) AS DECIMAL(28,6)) AS allocated_cost
  FROM lr JOIN onr USING (order_id)),
lm AS (SELECT *, line_net_revenue - allocated_cost AS line_margin_alloc FROM la),
win AS (
  SELECT MIN(createdAt) AS dataset_first, MAX(createdAt) AS dataset_last,
         GREATEST(date_diff('day', CAST(MIN(createdAt) AS DATE), CAST(MAX(createdAt) AS DATE)) + 1, 1)
           AS window_days
  FROM sh_lines)
"""

PRODUCTS = """
pagg AS (
  SELECT product_id, title, SUM(quantity) AS units_sold, SUM(line_net_revenue) AS rev,
         SUM(allocated_cost) AS cost, MIN(createdAt) AS product_first_order_date,
         MAX(createdAt) AS product_last_order_date
  FROM la GROUP BY product_id, title),
products AS (
  SELECT product_id, title, CAST(units_sold AS BIGINT) AS units_sold,
         CAST(CAST(ROUND(rev, 4) AS DECIMAL(18,4)) AS DOUBLE) AS revenue,
         CAST(CAST(ROUND(cost, 4) AS DECIMAL(18,4)) AS DOUBLE) AS allocated_cost,
         product_first_order_date, product_last_order_date,
         CAST(CAST(ROUND(rev - cost, 4) AS DECIMAL(18,4)) AS DOUBLE) AS gross_margin_alloc,
         ROUND(CASE WHEN rev <> 0 THEN CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE) ELSE 0.0 END, 4)
           AS margin_pct,
         ROUND(CAST(units_sold AS DOUBLE) / CAST((SELECT window_days FROM win) AS DOUBLE), 6)
           AS velocity_per_day,
         CAST((SELECT window_days FROM win) AS BIGINT) AS window_days
  FROM pagg)
"""



def classify_ctes(min_units: int) -> str:
    return f"""
cls_in AS (SELECT *, units_sold >= {min_units} AS data_sufficient FROM products),
vh AS (SELECT velocity_per_day AS v, COUNT(*) AS cnt FROM cls_in WHERE data_sufficient GROUP BY 1),
vh2 AS (
  SELECT v, cnt,
         COALESCE(SUM(cnt) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_before,
         SUM(cnt) OVER () AS n
  FROM vh),
vs0 AS (SELECT CAST(COALESCE(MAX(n), 0) AS BIGINT) AS n, COUNT(*) AS n_distinct FROM vh2),
vs AS (
  SELECT vs0.n, vs0.n_distinct,
         (SELECT MIN(v) FROM vh2) AS s0,
         (SELECT MIN(v) FROM vh2 WHERE cum_before + cnt > (vs0.n - 1) // 3) AS sa,
         (SELECT MIN(v) FROM vh2 WHERE cum_before + cnt > (vs0.n + 1) // 3) AS sb,
         (SELECT MIN(v) FROM vh2 WHERE cum_before + cnt > (2 * (vs0.n - 1)) // 3) AS sc,
         (SELECT MIN(v) FROM vh2 WHERE cum_before + cnt > (2 * vs0.n) // 3) AS sd,
         (SELECT MAX(v) FROM vh2) AS smax
  FROM vs0),
vtop AS (
  SELECT product_id AS top_id, title AS top_title FROM cls_in WHERE data_sufficient
  ORDER BY velocity_per_day DESC, product_id, title LIMIT 1),
vcls AS (
  SELECT vh2.v,
         CASE WHEN vs.n_distinct = 1 THEN 'slow'
              WHEN vs.sb = vs.s0 OR vs.sa = vs.sd OR vs.sc = vs.smax THEN
                CASE WHEN 6 * cum_before + 3 * cnt + 3 <= 2 * vh2.n THEN 'slow'
                     WHEN 6 * cum_before + 3 * cnt + 3 <= 4 * vh2.n THEN 'medium' ELSE 'fast' END
              WHEN vh2.v <= vs.sa THEN 'slow'
              WHEN vh2.v <= vs.sc THEN 'medium' ELSE 'fast' END AS tertile_class
  FROM vh2 CROSS JOIN vs),
classified AS (
  SELECT p.*,
         CASE WHEN NOT p.data_sufficient THEN 'slow'
              WHEN (SELECT n FROM vs) < 3 THEN
                CASE WHEN p.product_id = (SELECT top_id FROM vtop) AND p.title = (SELECT top_title FROM vtop)
                     THEN 'fast' ELSE 'slow' END
              ELSE vcls.tertile_class END AS movement_class
  FROM cls_in p LEFT JOIN vcls ON p.velocity_per_day = vcls.v)
"""


CAMPAIGNS = """
att_line AS (
  SELECT active_campaign_id AS campaign_id, order_id, product_id, quantity, line_margin_alloc,
         createdAt, active_campaign_id
  FROM lm WHERE active_campaign_id IN (SELECT id FROM sh_campaigns)),
hit_ids AS (SELECT DISTINCT campaign_id FROM att_line),
oc_fallback AS (
  SELECT DISTINCT campaign_id, order_id FROM sh_pairs
  WHERE campaign_id IN (SELECT id FROM sh_campaigns)
    AND campaign_id NOT IN (SELECT campaign_id FROM hit_ids)),
att AS (
  SELECT * FROM att_line
  UNION ALL
  SELECT f.campaign_id, l.order_id, l.product_id, l.quantity, l.line_margin_alloc, l.createdAt,
         l.active_campaign_id
  FROM lm l JOIN oc_fallback f ON l.order_id = f.order_id),
att_p AS (SELECT DISTINCT campaign_id, product_id FROM att),
att_o AS (SELECT DISTINCT campaign_id, order_id FROM att),
base AS (
  SELECT ap.campaign_id, l.order_id, l.product_id, l.quantity, l.line_margin_alloc, l.createdAt,
         l.active_campaign_id
  FROM lm l JOIN att_p ap ON l.product_id = ap.product_id
  WHERE l.active_campaign_id IS NULL
    AND NOT EXISTS (SELECT 1 FROM att_o ao WHERE ao.campaign_id = ap.campaign_id AND ao.order_id = l.order_id)),
camp_t AS (
  SELECT campaign_id, COUNT(DISTINCT order_id) AS attributed_orders, SUM(quantity) AS units,
         SUM(line_margin_alloc) AS margin, MIN(createdAt) AS f, MAX(createdAt) AS l, COUNT(*) AS n
  FROM att GROUP BY campaign_id),
base_t AS (
  SELECT campaign_id, SUM(quantity) AS units, SUM(line_margin_alloc) AS margin,
         MIN(createdAt) AS f, MAX(createdAt) AS l, COUNT(*) AS n
  FROM base GROUP BY campaign_id),
ship_t AS (
  SELECT ao.campaign_id, SUM(o.shipping_discount_amount) AS impact
  FROM att_o ao JOIN sh_orders o ON ao.order_id = o.order_id
  WHERE ao.campaign_id IN (SELECT id FROM sh_campaigns WHERE type = 'shipping')
  GROUP BY ao.campaign_id),
meas0 AS (
  SELECT c.id AS campaign_id, 'Campaign ' || c.id AS campaign_name, c.type, 'active' AS status,
         c.campaign_pos, CAST(0.0 AS DOUBLE) AS reported_totalRevenue, CAST(0.0 AS DOUBLE) AS reported_marginPct,
         CAST(CASE WHEN COALESCE(ct.n, 0) > 0 THEN (epoch_us(ct.l) - epoch_us(ct.f)) // 86400000000 + 1
              ELSE 0 END AS BIGINT) AS window_days,
         CAST(CASE WHEN COALESCE(bt.n, 0) > 0 THEN (epoch_us(bt.l) - epoch_us(bt.f)) // 86400000000 + 1
              ELSE 0 END AS BIGINT) AS baseline_days,
         CAST(COALESCE(ct.attributed_orders, 0) AS BIGINT) AS attributed_orders,
         CAST(COALESCE(ct.units, 0) AS BIGINT) AS campaign_units,
         CAST(COALESCE(bt.units, 0) AS BIGINT) AS baseline_units,
         COALESCE(ct.margin, 0) - COALESCE(CASE WHEN c.type = 'shipping' AND COALESCE(ct.n, 0) > 0
                                          THEN COALESCE(st.impact, 0) END, 0) AS campaign_margin_total,
         COALESCE(bt.margin, 0) AS baseline_margin_total,
         CASE WHEN c.type = 'shipping' AND COALESCE(ct.n, 0) > 0 THEN COALESCE(st.impact, 0) END
           AS shipping_cost_impact
  FROM sh_campaigns c LEFT JOIN camp_t ct ON c.id = ct.campaign_id
       LEFT JOIN base_t bt ON c.id = bt.campaign_id LEFT JOIN ship_t st ON c.id = st.campaign_id),
meas1 AS (
  SELECT *,
    CASE WHEN window_days > 0 THEN CAST(campaign_margin_total AS DOUBLE) / CAST(window_days AS DOUBLE)
         ELSE 0.0 END AS campaign_margin_per_day,
    CASE WHEN baseline_days > 0 THEN CAST(baseline_margin_total AS DOUBLE) / CAST(baseline_days AS DOUBLE)
         ELSE 0.0 END AS baseline_margin_per_day,
    CASE WHEN window_days > 0 THEN CAST(campaign_units AS DOUBLE) / CAST(window_days AS DOUBLE)
         ELSE 0.0 END AS campaign_velocity,
    CASE WHEN baseline_days > 0 THEN CAST(baseline_units AS DOUBLE) / CAST(baseline_days AS DOUBLE)
         ELSE 0.0 END AS baseline_velocity
  FROM meas0),
measures AS (
  SELECT *, CASE WHEN baseline_velocity > 0 THEN campaign_velocity / baseline_velocity ELSE 0.0 END AS units_lift
  FROM meas1),
suff0 AS (
  SELECT *, list_filter([
      CASE WHEN window_days < 3 THEN 'campaign_days=' || window_days || '<3' END,
      CASE WHEN baseline_days < 3 THEN 'baseline_days=' || baseline_days || '<3' END,
      CASE WHEN campaign_units < 20 THEN 'campaign_units=' || campaign_units || '<20' END,
      CASE WHEN baseline_units < 20 THEN 'baseline_units=' || baseline_units || '<20' END,
      CASE WHEN attributed_orders <= 0 THEN 'attributed_orders=0' END,
      CASE WHEN baseline_days = 0 THEN 'baseline_margin_per_day_invalid' END,
      CASE WHEN window_days = 0 THEN 'campaign_margin_per_day_invalid' END], lambda x: x IS NOT NULL) AS f0
  FROM measures),
suff AS (
  SELECT * EXCLUDE (f0),
         CASE WHEN len(f0) = 0 AND baseline_velocity = 0 THEN ['baseline_velocity_zero'] ELSE f0 END
           AS sufficiency_failures
  FROM suff0),
verd AS (
  SELECT *,
    CASE WHEN type = 'shipping' THEN '|shipping_order_level_attribution_coarse' ELSE '' END AS sfx,
    campaign_margin_per_day / baseline_margin_per_day AS lift
  FROM suff),
verd2 AS (
  SELECT *,
    CASE WHEN len(sufficiency_failures) > 0 THEN 'inconclusive'
         WHEN baseline_margin_per_day = 0 THEN 'inconclusive'
         WHEN lift >= CAST(1.2 AS DOUBLE) THEN 'success'
         WHEN lift <= CAST(1.0 AS DOUBLE) THEN 'flop'
         ELSE 'inconclusive' END AS verdict,
    CASE WHEN len(sufficiency_failures) > 0 THEN 0.2
         WHEN baseline_margin_per_day = 0 THEN 0.3
         WHEN lift >= CAST(1.2 AS DOUBLE) THEN
           CASE WHEN units_lift > CAST(1.1 AS DOUBLE) THEN (CASE WHEN type = 'shipping' THEN 0.7 ELSE 0.85 END)
                WHEN units_lift <= CAST(1.0 AS DOUBLE) THEN 0.6
                ELSE (CASE WHEN type = 'shipping' THEN 0.7 ELSE 0.75 END) END
         WHEN lift <= CAST(1.0 AS DOUBLE) THEN (CASE WHEN type = 'shipping' THEN 0.65 ELSE 0.8 END)
         ELSE (CASE WHEN type = 'shipping' THEN 0.45 ELSE 0.5 END) END AS conf,
    CASE WHEN len(sufficiency_failures) > 0 THEN 'low_n:' || array_to_string(sufficiency_failures, '|')
         WHEN baseline_margin_per_day = 0 THEN 'baseline_margin_per_day_zero'
         WHEN lift >= CAST(1.2 AS DOUBLE) THEN
           CASE WHEN units_lift > CAST(1.1 AS DOUBLE) THEN 'margin_lift|volume_lift'
                WHEN units_lift <= CAST(1.0 AS DOUBLE) THEN 'margin_gain_without_volume_lift'
                ELSE 'margin_lift' END || sfx
         WHEN lift <= CAST(1.0 AS DOUBLE) THEN
           CASE WHEN units_lift > CAST(1.1 AS DOUBLE) THEN 'volume_lift_margin_eroded' ELSE 'margin_erosion' END || sfx
         ELSE 'margin_lift_below_threshold' || sfx END AS reason_code
  FROM verd),
campaign_eval AS (
  SELECT campaign_id, campaign_name, type, status, window_days, attributed_orders, campaign_units,
         baseline_units,
         CAST(CAST(ROUND(campaign_margin_total, 2) AS DECIMAL(18,2)) AS DOUBLE) AS campaign_margin_total,
         CAST(CAST(ROUND(baseline_margin_total, 2) AS DECIMAL(18,2)) AS DOUBLE) AS baseline_margin_total,
         ROUND(campaign_margin_per_day, 4) AS margin_per_day_campaign,
         ROUND(baseline_margin_per_day, 4) AS margin_per_day_baseline,
         ROUND(units_lift, 4) AS units_lift_ratio,
         CAST(CAST(ROUND(shipping_cost_impact, 2) AS DECIMAL(18,2)) AS DOUBLE) AS shipping_cost_impact,
         verdict, CAST(ROUND(conf, 2) AS DOUBLE) AS confidence, reason_code,
         reported_totalRevenue, reported_marginPct, campaign_pos, baseline_days
  FROM verd2)
"""


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def case_map(mapping: dict, key: str, default=None) -> str:
    whens = " ".join(f"WHEN {key} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {lit(default)} END)"


def vetoed_sql(m: str) -> str:
    t = case_map(MECHANIC_TO_CAMPAIGN_TYPE, m)
    return (f"(COALESCE(list_contains(flop_types, {t}), FALSE) OR "
            f"(volume_lift_margin_eroded AND {m} IN ('Generic Discount', 'Order-level Discount')))")


def fixed4(v: str) -> str:
    return f"CAST(CAST(ROUND(CAST({v} AS DECIMAL(38,10)), 4) AS DECIMAL(38,4)) AS VARCHAR)"


def margin_band_ctes() -> str:
    return """
mh AS (SELECT margin_pct AS v, COUNT(*) AS cnt FROM classified GROUP BY 1),
mh2 AS (
  SELECT v, cnt,
         COALESCE(SUM(cnt) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_before,
         SUM(cnt) OVER () AS n
  FROM mh),
ms0 AS (SELECT CAST(COALESCE(MAX(n), 0) AS BIGINT) AS n FROM mh2),
ms AS (
  SELECT ms0.n,
         (SELECT MIN(v) FROM mh2 WHERE cum_before + cnt > (ms0.n - 1) // 3) AS sa,
         (SELECT MIN(v) FROM mh2 WHERE cum_before + cnt > (ms0.n + 1) // 3) AS sb,
         (SELECT MIN(v) FROM mh2 WHERE cum_before + cnt > (2 * (ms0.n - 1)) // 3) AS sc,
         (SELECT MIN(v) FROM mh2 WHERE cum_before + cnt > (2 * ms0.n) // 3) AS sd
  FROM ms0),
banded AS (
  SELECT c.*,
         CASE WHEN c.margin_pct >= ms.sd THEN 'high' WHEN c.margin_pct <= ms.sa THEN 'low' ELSE 'mid' END
           AS margin_band,
         ROUND(ms.sa + (ms.sb - ms.sa) * (CAST(ms.n - 1 AS DOUBLE) / 3.0 - FLOOR(CAST(ms.n - 1 AS DOUBLE) / 3.0)), 4)
           AS _margin_p33,
         ROUND(ms.sc + (ms.sd - ms.sc) * (CAST(ms.n - 1 AS DOUBLE) * 2.0 / 3.0
                                         - FLOOR(CAST(ms.n - 1 AS DOUBLE) * 2.0 / 3.0)), 4) AS _margin_p67
  FROM classified c CROSS JOIN ms)
"""


def rules_ctes(affinity_sql: str | None) -> str:
    cells = ", ".join(
        f"({lit(b)}, {lit(c)}, {lit(m)}, {lit(o)}, {lit(conf)}, {lit(RATIONALE[(b, c)][0])}, "
        f"{lit(RATIONALE[(b, c)][1])})" for b, c, m, o, conf in POLICY_MATRIX)
    fb = " ".join(
        f"WHEN NOT ({lit(f)} = 'Free Shipping' AND NOT shipping_roi_positive) AND NOT {vetoed_sql(lit(f))} "
        f"THEN {lit(f)}" for f in FALLBACK_ORDER)
    ftype = case_map(MECHANIC_TO_CAMPAIGN_TYPE, "recommended_mechanic")
    aff = (f"aff AS (SELECT DISTINCT product_id, TRUE AS is_aff FROM ({affinity_sql}))" if affinity_sql
           else "aff AS (SELECT CAST(NULL AS BIGINT) AS product_id, TRUE AS is_aff WHERE FALSE)")
    prio = lambda o, c, m: (f"ROUND({case_map(OPPORTUNITY_VALUE, o, 1.0)} * {case_map(CONFIDENCE_WEIGHT, c, 0.3)}"
                            f" / {case_map(MECHANIC_EFFORT, m, 1.0)}, 4)")
    return f"""
ev AS (
  SELECT list_sort(COALESCE(list(DISTINCT type) FILTER (WHERE verdict = 'success'), [])) AS success_types,
         list_sort(COALESCE(list(DISTINCT type) FILTER (WHERE verdict = 'flop'), [])) AS flop_types,
         list_sort(COALESCE(list(DISTINCT type) FILTER (WHERE verdict = 'inconclusive'), [])) AS inc0,
         COALESCE(bool_or(verdict = 'flop' AND contains(reason_code, 'volume_lift_margin_eroded')), FALSE)
           AS volume_lift_margin_eroded,
         CAST(COUNT(*) FILTER (WHERE verdict = 'success') AS BIGINT) AS n_success,
         CAST(COUNT(*) FILTER (WHERE verdict = 'flop') AS BIGINT) AS n_flop
  FROM campaign_eval),
evidence AS (
  SELECT success_types, flop_types,
         list_sort(list_filter(inc0, lambda x: NOT list_contains(success_types, x)
                                          AND NOT list_contains(flop_types, x))) AS inconclusive_types,
         list_contains(success_types, 'shipping') AS shipping_roi_positive,
         list_contains(flop_types, 'order') AS order_discount_flopped,
         volume_lift_margin_eroded, n_success, n_flop
  FROM ev),
cells AS (
  SELECT * FROM (VALUES {cells}) AS t(margin_band, movement_class, matrix_mechanic, margin_opportunity,
                                       base_confidence, rationale_code, base_rationale)),
pol0 AS (
  SELECT c.margin_band, c.movement_class, a.affinity, c.rationale_code, c.base_rationale, e.*,
         CASE WHEN a.affinity THEN 'Bundle/Cross-sell'
              WHEN c.matrix_mechanic = 'Free Shipping' AND NOT e.shipping_roi_positive THEN 'Leave/minimal discount'
              ELSE c.matrix_mechanic END AS start_mechanic,
         CASE WHEN a.affinity THEN 'high' ELSE c.margin_opportunity END AS margin_opportunity,
         CASE WHEN a.affinity THEN 'high' ELSE c.base_confidence END AS conf0
  FROM cells c CROSS JOIN (VALUES (FALSE), (TRUE)) AS a(affinity) CROSS JOIN evidence e),
pol1 AS (
  SELECT *, {vetoed_sql("start_mechanic")} AS vetoed, (CASE {fb} END) AS fallback FROM pol0),
pol2 AS (
  SELECT *,
         CASE WHEN NOT vetoed THEN start_mechanic ELSE COALESCE(fallback, 'Leave/minimal discount') END
           AS recommended_mechanic,
         CASE WHEN NOT vetoed THEN conf0 WHEN fallback IS NOT NULL THEN 'medium' ELSE 'low' END AS conf1
  FROM pol1),
pol3 AS (SELECT *, {ftype} AS final_type FROM pol2),
pol4 AS (
  SELECT *, COALESCE(list_contains(success_types, final_type), FALSE) AS succ,
         COALESCE(list_contains(flop_types, final_type), FALSE) AS flop,
         volume_lift_margin_eroded AND recommended_mechanic IN ('Generic Discount', 'Order-level Discount')
           AS eroded_risk
  FROM pol3),
pol5 AS (
  SELECT *, CASE WHEN succ THEN (CASE conf1 WHEN 'medium' THEN 'high' WHEN 'low' THEN 'medium' ELSE conf1 END)
                 ELSE conf1 END AS conf2
  FROM pol4),
pol6 AS (
  SELECT *, CASE WHEN flop THEN (CASE conf2 WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE conf2 END)
                 ELSE conf2 END AS conf3
  FROM pol5),
pol7 AS (
  SELECT *, CASE WHEN eroded_risk AND conf3 IN ('high', 'medium') THEN 'medium' ELSE conf3 END AS confidence_label,
         list_filter([
           CASE WHEN vetoed THEN (CASE WHEN fallback IS NOT NULL
                 THEN 'base_mechanic_vetoed:' || start_mechanic || '->fallback:' || fallback
                 ELSE 'all_fallbacks_vetoed:terminal_safe' END) END,
           CASE WHEN succ THEN 'campaign_success_evidence:' || final_type END,
           CASE WHEN succ AND final_type = 'shipping' THEN 'shipping_attribution_coarse' END,
           CASE WHEN flop THEN 'campaign_flop_evidence:' || final_type END,
           CASE WHEN eroded_risk THEN 'volume_lift_margin_eroded_risk' END,
           CASE WHEN recommended_mechanic = 'Free Shipping' THEN 'shipping_attribution_coarse' END,
           CASE WHEN affinity THEN 'affinity_override_applied' END], lambda x: x IS NOT NULL) AS tags
  FROM pol6),
policy AS (
  SELECT margin_band, movement_class, affinity, start_mechanic, vetoed, recommended_mechanic, final_type,
         margin_opportunity, confidence_label,
         {case_map(CONFIDENCE_WEIGHT, "confidence_label", 0.6)} AS confidence,
         rationale_code,
         concat_ws(' ', base_rationale,
                   CASE WHEN affinity THEN {lit("Strong purchase affinity: bundle it with its partner products.")} END,
                   CASE WHEN vetoed THEN 'Campaign results ruled out ' || start_mechanic || '; using '
                                         || recommended_mechanic || ' instead.' END,
                   CASE WHEN succ AND final_type = 'shipping' THEN {lit(SHIPPING_TEXT)} END) AS rationale,
         concat_ws(' ', {lit(CAVEAT_TEXT)},
                   CASE WHEN list_contains(tags, 'shipping_attribution_coarse') THEN {lit(SHIPPING_TEXT)} END,
                   CASE WHEN volume_lift_margin_eroded THEN {lit(ERODED_TEXT)} END) AS expected_effect,
         tags,
         {prio("margin_opportunity", "confidence_label", "recommended_mechanic")} AS priority_score
  FROM pol7),
crefs AS (
  SELECT campaign_pos, type, verdict,
         'campaign:' || campaign_id || '|type:' || type || '|verdict:' || verdict || '|rc:' || reason_code AS ref
  FROM campaign_eval),
policy_refs AS (
  SELECT p.*, p.margin_band || '/' || p.movement_class || CASE WHEN p.affinity THEN '/affinity' ELSE '/plain' END
           AS policy_id,
         COALESCE((SELECT list(r.ref ORDER BY r.campaign_pos) FROM crefs r
                        WHERE r.type = p.final_type OR r.verdict IN ('success', 'flop')), []) AS campaign_refs
  FROM policy p),
{aff},
recs0 AS (
  SELECT b.*, COALESCE(a.is_aff, FALSE) AS affinity_flag
  FROM banded b LEFT JOIN aff a ON b.product_id = a.product_id),
recommendations AS (
  SELECT r.product_id, r.title, r.margin_band, r.movement_class, r.data_sufficient, r.units_sold,
         r.velocity_per_day, r.margin_pct,
         CASE WHEN rule0 THEN 'Collect more data' ELSE p.recommended_mechanic END AS recommended_mechanic,
         CASE WHEN rule0 THEN 'low' ELSE p.margin_opportunity END AS margin_opportunity,
         CASE WHEN rule0 THEN 'low' ELSE p.confidence_label END AS confidence_label,
         CASE WHEN rule0 THEN CAST(0.3 AS DOUBLE) ELSE p.confidence END AS confidence,
         CASE WHEN rule0 THEN 'rule0_insufficient_data' ELSE p.rationale_code END AS rationale_code,
         CASE WHEN rule0 THEN 'Too few units sold to judge (' || CAST(r.units_sold AS VARCHAR)
                              || ' of ' || {{min_units}} || ' needed); no discount call is made on product-level figures.'
              ELSE p.rationale END AS rationale,
         CASE WHEN rule0 THEN {lit("Sample too small for product-level claims. " + CAVEAT_TEXT)}
              ELSE p.expected_effect END AS expected_effect,
         CASE WHEN rule0 THEN {prio("'low'", "'low'", "'Collect more data'")} ELSE p.priority_score END
           AS priority_score,
         CASE WHEN rule0 THEN ['product_id:' || CAST(r.product_id AS VARCHAR),
                               'units_sold:' || CAST(r.units_sold AS VARCHAR),
                               'rule0_insufficient_data', {lit(CAVEAT_STRUCTURAL)}]
              ELSE list_concat(['product_id:' || CAST(r.product_id AS VARCHAR),
                                'movement_class:' || r.movement_class,
                                'margin_band:' || r.margin_band,
                                'units_sold:' || CAST(r.units_sold AS VARCHAR),
                                'velocity_per_day:' || {fixed4("r.velocity_per_day")},
                                'margin_pct:' || {fixed4("r.margin_pct")},
                                'data_sufficient:' || CASE WHEN r.data_sufficient THEN 'True' ELSE 'False' END,
                                'recommended_mechanic:' || p.recommended_mechanic,
                                {lit(CAVEAT_STRUCTURAL)}], p.tags) END AS evidence_refs,
         CASE WHEN NOT rule0 THEN p.policy_id END AS policy_id,
         CASE WHEN rule0 THEN [] ELSE p.campaign_refs END AS campaign_refs
  FROM (SELECT *, (NOT data_sufficient OR movement_class NOT IN ('fast', 'medium', 'slow')) AS rule0
        FROM recs0) r
  LEFT JOIN policy_refs p
    ON r.margin_band = p.margin_band AND r.movement_class = p.movement_class AND r.affinity_flag = p.affinity)
"""


AFFINITY_SQL = "SELECT p_partkey AS product_id FROM part WHERE p_type = 'PROMO'"


def with_ctes(*fragments: str, select: str) -> str:
    body = ",\n".join(f.strip().rstrip(",") for f in fragments)
    return f"WITH {body}\n{select}"


BASE = (ADAPTER, LINE_METRICS)


BREACHED = """
read_orders AS (SELECT *, order_id % 31 <> 0 AND order_id % 37 <> 0 AS readable FROM sh_orders),
read_lines AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.order_id ORDER BY l.product_id, l.variant_id, l.title, l.price, l.quantity,
                                 l.total_discount, l.active_campaign_id NULLS FIRST) - 1 AS pos
  FROM sh_lines l JOIN read_orders o USING (order_id) WHERE o.readable),
breach_orders AS (
  SELECT order_id, CASE WHEN order_id % 37 = 0 THEN 'syntax:' ELSE 'type:' END AS rule FROM read_orders WHERE NOT readable
  UNION ALL SELECT order_id, 'absent:currency' FROM read_orders WHERE readable AND order_id % 7 = 0
  UNION ALL SELECT order_id, 'type:total_price' FROM read_orders WHERE readable AND order_id % 11 = 0
  UNION ALL SELECT order_id, 'null:has_partial_cost' FROM read_orders WHERE readable AND order_id % 13 = 0
  UNION ALL SELECT order_id, 'null:applied_campaigns' FROM read_orders WHERE readable AND order_id % 17 = 0
  UNION ALL SELECT order_id, 'absent:order_campaigns[].campaignName' FROM read_orders
            WHERE readable AND order_id % 2 = 0 AND oc_id = 'k6'),
breach_lines AS (
  SELECT order_id, pos, 'absent:line_items[].quantity' AS rule FROM read_lines WHERE order_id % 19 = 0
  UNION ALL SELECT order_id, pos, 'type:line_items[].variant_id' FROM read_lines WHERE order_id % 23 = 0
  UNION ALL SELECT order_id, pos, 'null:line_items[].campaign_discounts[].discountAmount' FROM read_lines
            WHERE order_id % 3 = 0 AND active_campaign_id IN ('k2', 'k4'))
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["product_metrics"] = with_ctes(*BASE, PRODUCTS, select="SELECT * FROM products")
    d = lambda c, sc=6: f"CAST(CAST({c} AS DECIMAL(18,{sc})) AS DOUBLE)"
    q["line_revenue"] = with_ctes(*BASE, select=f"""
SELECT order_id, product_id, quantity, {d("price")} AS price, {d("total_discount")} AS total_discount,
       {d("line_gross_revenue")} AS line_gross_revenue, {d("line_net_revenue")} AS line_net_revenue, net_clipped
FROM lr""")
    q["order_net_revenue"] = with_ctes(*BASE, select=(
        f"SELECT order_id, {d('order_net_revenue')} AS order_net_revenue FROM onr"))
    q["allocated_cost"] = with_ctes(*BASE, select=f"""
SELECT order_id, product_id, quantity, {d("cost_total")} AS cost_total, {d("line_net_revenue")} AS line_net_revenue,
       {d("allocated_cost")} AS allocated_cost FROM la""")
    q["zero_revenue_orders"] = with_ctes(*BASE, select=(
        f"SELECT order_id, {d('order_net_revenue')} AS order_net_revenue FROM onr WHERE order_net_revenue = 0"))
    clearance = (ADAPTER.replace("sh_lines AS (", "sh_lines0 AS ("), """
sh_lines AS (
  SELECT s.* REPLACE (CASE WHEN o.o_orderstatus = 'P'
                           THEN CAST(CAST(s.quantity AS DECIMAL(6,0)) * s.price * 2 AS DECIMAL(18,4))
                           ELSE s.total_discount END AS total_discount)
  FROM sh_lines0 s JOIN o_x o USING (order_id))""", LINE_METRICS)
    q["clearance_line_revenue"] = with_ctes(*clearance, select=f"""
SELECT order_id, product_id, quantity, {d("total_discount")} AS total_discount,
       {d("line_gross_revenue")} AS line_gross_revenue, {d("line_net_revenue")} AS line_net_revenue, net_clipped
FROM lr""")
    q["clearance_zero_revenue_orders"] = with_ctes(*clearance, select=(
        f"SELECT order_id, {d('order_net_revenue')} AS order_net_revenue FROM onr WHERE order_net_revenue = 0"))
    q["clearance_allocated_cost"] = with_ctes(*clearance, select=f"""
SELECT order_id, product_id, quantity, {d("line_net_revenue")} AS line_net_revenue,
       {d("allocated_cost")} AS allocated_cost FROM la""")
    q["line_margin"] = with_ctes(*BASE, select=f"""
SELECT order_id, product_id, quantity, {d("line_net_revenue")} AS line_net_revenue,
       {d("allocated_cost")} AS allocated_cost, {d("line_margin_alloc")} AS line_margin_alloc, active_campaign_id
FROM lm""")
    q["stream_line_margin"] = q["line_margin"]
    q["dataset_window"] = with_ctes(*BASE, select=(
        "SELECT dataset_first, dataset_last, CAST(window_days AS BIGINT) AS window_days FROM win"))
    q["products_by_velocity"] = with_ctes(*BASE, PRODUCTS, select=(
        "SELECT product_id, title, units_sold, velocity_per_day FROM products "
        "ORDER BY velocity_per_day DESC, product_id, title"))
    cls = (*BASE, PRODUCTS, classify_ctes(MIN_UNITS_DEFAULT))
    q["classify_products"] = with_ctes(*cls, select="SELECT * FROM classified")
    q["class_counts"] = with_ctes(*cls, select=(
        "SELECT movement_class, COUNT(*) AS n_products FROM classified GROUP BY movement_class"))
    q["classify_rank_fallback"] = with_ctes(*cls, select="""
SELECT p.*, CASE WHEN 6 * cum_before + 3 * cnt + 3 <= 2 * n THEN 'slow'
                 WHEN 6 * cum_before + 3 * cnt + 3 <= 4 * n THEN 'medium' ELSE 'fast' END AS rank_class
FROM cls_in p JOIN vh2 ON p.velocity_per_day = vh2.v WHERE p.data_sufficient""")
    q["classify_identical"] = with_ctes(*cls, select="""
SELECT n, n_distinct, n_distinct = 1 AS all_identical,
       COALESCE(sb = s0 OR sa = sd OR sc = smax, FALSE) AS edges_repeated,
       CASE WHEN n = 0 THEN 'none_sufficient' WHEN n < 3 THEN 'top_one_fast'
            WHEN n_distinct = 1 THEN 'all_identical'
            WHEN sb = s0 OR sa = sd OR sc = smax THEN 'rank_fallback'
            ELSE 'quantile_tertiles' END AS method,
       sa + (sb - sa) * (CAST(n - 1 AS DOUBLE) / 3.0 - FLOOR(CAST(n - 1 AS DOUBLE) / 3.0)) AS edge_low,
       sc + (sd - sc) * (CAST(n - 1 AS DOUBLE) * 2.0 / 3.0 - FLOOR(CAST(n - 1 AS DOUBLE) * 2.0 / 3.0)) AS edge_high
FROM vs""")
    q["classify_few"] = with_ctes(*cls, select="""
SELECT product_id, title, velocity_per_day FROM cls_in WHERE data_sufficient
ORDER BY velocity_per_day DESC, product_id, title LIMIT 1""")
    camp = (*BASE, CAMPAIGNS)
    line_cols = "order_id, product_id, quantity, CAST(line_margin_alloc AS DOUBLE) AS line_margin_alloc, " \
                "createdAt, active_campaign_id"
    q["order_campaign_pairs"] = with_ctes(*BASE, select="SELECT campaign_id, order_id FROM sh_pairs")
    q["attributed_lines"] = with_ctes(*camp, select=f"SELECT campaign_id, {line_cols} FROM att")
    q["baseline_lines"] = with_ctes(*camp, select=f"SELECT campaign_id, {line_cols} FROM base")
    q["campaign_windows"] = with_ctes(*camp, select=(
        "SELECT campaign_id, window_days, baseline_days FROM measures"))
    q["campaign_aggregates"] = with_ctes(*camp, select="""
SELECT campaign_id, attributed_orders, campaign_units, baseline_units,
       CAST(campaign_margin_total AS DOUBLE) AS campaign_margin_total,
       CAST(baseline_margin_total AS DOUBLE) AS baseline_margin_total FROM measures""")
    q["shipping_impact"] = with_ctes(*camp, select=(
        "SELECT campaign_id, CAST(impact AS DOUBLE) AS shipping_cost_impact FROM ship_t"))
    q["campaign_rates"] = with_ctes(*camp, select="""
SELECT campaign_id, campaign_margin_per_day, baseline_margin_per_day, campaign_velocity,
       baseline_velocity, units_lift FROM measures""")
    q["campaign_sufficiency"] = with_ctes(*camp, select="""
SELECT campaign_id, array_to_string(sufficiency_failures, '|') AS sufficiency_failures,
       len(sufficiency_failures) = 0 AS is_sufficient FROM suff""")
    q["campaign_eval"] = with_ctes(*camp, select="SELECT * FROM campaign_eval")
    q["verdict_counts"] = with_ctes(*camp, select=(
        "SELECT verdict, COUNT(*) AS n_campaigns FROM campaign_eval GROUP BY verdict"))
    cls_ce = (*cls, CAMPAIGNS.rstrip() , margin_band_ctes())
    recs = (*cls_ce, rules_ctes(None).replace("{min_units}", str(MIN_UNITS_DEFAULT)))
    recs_aff = (*cls_ce, rules_ctes(AFFINITY_SQL).replace("{min_units}", str(MIN_UNITS_DEFAULT)))
    rec_cols = ("product_id, title, margin_band, movement_class, data_sufficient, units_sold, velocity_per_day, "
                "margin_pct, recommended_mechanic, margin_opportunity, confidence_label, confidence, "
                "rationale_code, rationale, expected_effect, priority_score, policy_id, "
                "array_to_string(evidence_refs, ';') AS evidence_refs")
    q["recommendations"] = with_ctes(*recs, select=f"SELECT {rec_cols} FROM recommendations")
    q["pipeline_from_export"] = q["recommendations"]
    q["recommend_with_affinity"] = with_ctes(*recs_aff, select=f"SELECT {rec_cols} FROM recommendations")
    q["campaign_evidence"] = with_ctes(*recs, select="""
SELECT array_to_string(success_types, '|') AS success_types, array_to_string(flop_types, '|') AS flop_types,
       array_to_string(inconclusive_types, '|') AS inconclusive_types, shipping_roi_positive,
       order_discount_flopped, volume_lift_margin_eroded, n_success, n_flop FROM evidence""")
    q["margin_bands"] = with_ctes(*cls_ce, select=(
        "SELECT product_id, title, margin_pct, margin_band, _margin_p33, _margin_p67 FROM banded"))
    q["policy_matrix"] = with_ctes(*recs, select="""
SELECT p.margin_band, p.movement_class, p.start_mechanic AS base_mechanic, p.margin_opportunity,
       c.base_confidence, p.rationale_code,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM banded b WHERE b.margin_band = p.margin_band
          AND b.movement_class = p.movement_class AND b.data_sufficient) AS n_products
FROM pol0 p JOIN cells c ON p.margin_band = c.margin_band AND p.movement_class = c.movement_class
WHERE NOT p.affinity""")
    q["mechanic_vetoes"] = with_ctes(*recs, select=f"""
SELECT m.mechanic, {case_map(MECHANIC_TO_CAMPAIGN_TYPE, "m.mechanic")} AS campaign_type,
       {vetoed_sql("m.mechanic")} AS vetoed,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM recommendations r JOIN policy p
          ON r.margin_band = p.margin_band AND r.movement_class = p.movement_class AND NOT p.affinity
        WHERE p.vetoed AND p.start_mechanic = m.mechanic AND NOT (NOT r.data_sufficient)) AS n_products_vetoed
FROM (VALUES {", ".join(f"({lit(k)})" for k in MECHANIC_EFFORT)}) AS m(mechanic) CROSS JOIN evidence""")
    q["policy_resolved"] = with_ctes(*recs, select="""
SELECT policy_id, margin_band, movement_class, affinity, start_mechanic, vetoed, recommended_mechanic,
       margin_opportunity, confidence_label, confidence, priority_score, array_to_string(tags, ';') AS tags
FROM policy_refs""")
    q["policy_campaign_refs"] = with_ctes(*recs, select="""
SELECT p.policy_id, CAST(r.campaign_pos AS BIGINT) AS pos, r.ref
FROM policy_refs p JOIN crefs r ON r.type = p.final_type OR r.verdict IN ('success', 'flop')""")
    q["evidence_refs"] = with_ctes(*recs, select="""
SELECT product_id, title, array_to_string(list_concat(evidence_refs, campaign_refs), ';') AS evidence_refs,
       CAST(len(evidence_refs) + len(campaign_refs) AS INTEGER) AS n_refs FROM recommendations""")
    q["priority_scores"] = with_ctes(*recs, select="""
SELECT product_id, title, recommended_mechanic, margin_opportunity, confidence_label, priority_score
FROM recommendations""")
    q["mechanic_counts"] = with_ctes(*recs, select=(
        "SELECT recommended_mechanic, COUNT(*) AS n_products FROM recommendations GROUP BY 1"))
    q["top_recommendations"] = with_ctes(*recs, select=f"""
SELECT {rec_cols} FROM recommendations ORDER BY priority_score DESC, product_id, title LIMIT 20""")
    q["pipeline_summary"] = with_ctes(*recs, select="""
SELECT CAST(COUNT(*) AS BIGINT) AS n_recommendations,
       CAST(COUNT(*) FILTER (WHERE data_sufficient) AS BIGINT) AS n_sufficient,
       CAST(COUNT(*) FILTER (WHERE movement_class = 'fast') AS BIGINT) AS n_fast,
       CAST(COUNT(*) FILTER (WHERE movement_class = 'medium') AS BIGINT) AS n_medium,
       CAST(COUNT(*) FILTER (WHERE movement_class = 'slow') AS BIGINT) AS n_slow,
       CAST(COUNT(*) FILTER (WHERE recommended_mechanic = 'Collect more data') AS BIGINT) AS n_collect_more_data,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM campaign_eval) AS n_campaigns,
       (SELECT CAST(COUNT(*) FILTER (WHERE verdict = 'success') AS BIGINT) FROM campaign_eval) AS n_success,
       (SELECT CAST(COUNT(*) FILTER (WHERE verdict = 'flop') AS BIGINT) FROM campaign_eval) AS n_flop,
       (SELECT CAST(COUNT(*) FILTER (WHERE verdict = 'inconclusive') AS BIGINT) FROM campaign_eval) AS n_inconclusive,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM lm) AS n_lines,
       (SELECT CAST(COUNT(DISTINCT order_id) AS BIGINT) FROM lm) AS n_orders_with_lines,
       (SELECT CAST(window_days AS BIGINT) FROM win) AS window_days
FROM recommendations""")
    seg = """
seg0 AS (
  SELECT movement_class, margin_band, recommended_mechanic, CAST(COUNT(*) AS BIGINT) AS n_products,
         MAX(priority_score) AS max_priority_score,
         SUM(CAST(confidence AS DECIMAL(6,2))) AS conf_sum, MIN(product_id) AS first_product_id,
         CAST(SUM(units_sold) AS BIGINT) AS units_sold
  FROM recommendations GROUP BY 1, 2, 3),
segments AS (
  SELECT concat_ws('/', movement_class, margin_band, recommended_mechanic) AS segment_id,
         margin_band || '-margin ' || movement_class || ' movers' AS segment_label,
         recommended_mechanic AS discount_mechanic, movement_class, margin_band, n_products, units_sold,
         first_product_id, max_priority_score,
         ROUND(CAST(conf_sum AS DOUBLE) / CAST(n_products AS DOUBLE), 4) AS avg_confidence,
         CAST(ROW_NUMBER() OVER (ORDER BY max_priority_score DESC, n_products DESC, movement_class,
                                 margin_band, recommended_mechanic) AS INTEGER) AS segment_rank,
         CAST(ceil(5 * ROW_NUMBER() OVER (ORDER BY max_priority_score DESC, n_products DESC, movement_class,
                                          margin_band, recommended_mechanic) / COUNT(*) OVER ()) AS INTEGER)
           AS priority,
         'Apply ' || recommended_mechanic || ' to ' || margin_band || '-margin ' || movement_class || ' movers.'
           AS rationale,
         'Qualitative: ' || recommended_mechanic || ' expected to suit ' || CAST(n_products AS VARCHAR)
           || ' products.' AS expected_impact,
         ['segment_products:' || CAST(n_products AS VARCHAR),
          'max_priority_score:' || CAST(max_priority_score AS VARCHAR),
          'mechanic:' || recommended_mechanic] AS supporting_evidence_refs
  FROM seg0)
"""
    q["segment_proposals"] = with_ctes(*recs, seg, select="""
SELECT * EXCLUDE (supporting_evidence_refs),
       array_to_string(supporting_evidence_refs, ';') AS supporting_evidence_refs FROM segments""")
    q["segment_members"] = with_ctes(*recs, select="""
SELECT concat_ws('/', movement_class, margin_band, recommended_mechanic) AS segment_id, product_id, title,
       priority_score FROM recommendations""")
    # -- intake, personal data, validation ---------------------------------------
    q["flatten_orders"] = with_ctes(*BASE, select="""
SELECT order_id, 'shop-test' AS shop_id, order_id AS order_number, 'USD' AS currency,
       CAST(total_price AS DOUBLE) AS subtotal_price, CAST(0 AS DOUBLE) AS total_discounts,
       CAST(total_price AS DOUBLE) AS total_price, oc_id IS NOT NULL AS has_active_campaign,
       shipping_discount_amount > 0 AS is_free_shipping,
       CAST(shipping_discount_amount AS DOUBLE) AS shipping_original_price,
       CAST(0 AS DOUBLE) AS shipping_price_charged,
       CAST(shipping_discount_amount AS DOUBLE) AS shipping_discount_amount,
       '' AS applied_campaigns, COALESCE(oc_id, '') AS order_campaigns, CAST(cost_total AS DOUBLE) AS cost_total,
       CAST(total_price - cost_total AS DOUBLE) AS revenue_with_cost, FALSE AS has_partial_cost, createdAt
FROM sh_orders""")
    q["flatten_lineitems"] = with_ctes(*BASE, select="""
SELECT l.order_id, l.order_id AS order_number, 'shop-test' AS shop_id, l.createdAt, 'USD' AS currency,
       CAST(o.total_price AS DOUBLE) AS order_total_price, CAST(0 AS DOUBLE) AS order_total_discounts,
       CAST(o.cost_total AS DOUBLE) AS cost_total, CAST(o.total_price - o.cost_total AS DOUBLE) AS revenue_with_cost,
       CAST(o.shipping_discount_amount AS DOUBLE) AS shipping_original_price,
       CAST(0 AS DOUBLE) AS shipping_price_charged,
       CAST(o.shipping_discount_amount AS DOUBLE) AS shipping_discount_amount,
       o.shipping_discount_amount > 0 AS is_free_shipping,
       l.product_id, l.variant_id, l.title, CAST(l.price AS DOUBLE) AS price, l.quantity,
       CAST(l.total_discount AS DOUBLE) AS total_discount, CAST(l.price AS DOUBLE) AS compare_at_price,
       l.active_campaign_id, COALESCE(l.active_campaign_id, '') AS active_campaign_ids,
       COALESCE(l.active_campaign_id, '') AS campaign_discounts
FROM sh_lines l JOIN sh_orders o ON l.order_id = o.order_id""")
    q["src_export"] = with_ctes(*BASE, select="""
SELECT order_id, product_id, quantity, CAST(price AS DOUBLE) AS price,
       CAST(total_discount AS DOUBLE) AS total_discount, createdAt, active_campaign_id FROM sh_lines""")
    em = lit(EMAIL_PATTERN)
    # nested columns count as values wherever the list is there; none of their texts is an e-mail
    q["pii_minimize"] = with_ctes(*BASE, select=f"""
SELECT "table", "column", COUNT(*) AS n_values, COUNT(*) FILTER (WHERE regexp_matches(v, {em})) AS n_matches
FROM (SELECT CASE WHEN c = 'customer_email' THEN 'buyer' || CAST(order_id AS VARCHAR) || '@example.com' ELSE c END AS v, t.*
      FROM sh_orders, (VALUES ('orders_raw', 'shop_id'), ('orders_raw', 'currency'), ('orders_raw', 'line_items'),
        ('orders_raw', 'applied_campaigns'), ('orders_raw', 'order_campaigns'), ('orders_raw', 'customer_email'),
        ('orders_clean', 'shop_id'), ('orders_clean', 'currency'), ('orders_clean', 'applied_campaigns'),
        ('orders_clean', 'order_campaigns')) AS t("table", c)) AS x("v", "table", "column")
GROUP BY 1, 2
UNION ALL SELECT 'lineitems_clean', c, COUNT(*) FILTER (WHERE c <> 'active_campaign_id' OR active_campaign_id IS NOT NULL),
       COUNT(*) FILTER (WHERE c = 'title' AND regexp_matches(title, {em}))
FROM sh_lines, (VALUES ('shop_id'), ('currency'), ('title'), ('active_campaign_id'), ('active_campaign_ids'),
                       ('campaign_discounts')) AS t(c) GROUP BY c""")
    q["pii_column_audit"] = with_ctes(*BASE, select=f"""
SELECT 'orders_raw' AS "table", 'customer_email' AS "column", f.fragment, COUNT(*) AS n_values,
       COUNT(*) FILTER (WHERE regexp_matches('buyer' || CAST(o.order_id AS VARCHAR) || '@example.com', {em}))
         AS n_matches
FROM sh_orders o CROSS JOIN (VALUES ('customer_email'), ('email')) AS f(fragment)
GROUP BY f.fragment""")
    scans = []
    for t, cols in (("documents", ("text", "lang", "source")), ("conversations", ("role", "text")),
                    ("pages", ("url", "html"))):
        for c in cols:
            scans.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", COUNT({c}) AS n_values, "
                         f"COUNT(*) FILTER (WHERE regexp_matches({c}, {em})) AS n_matches FROM {t}")
    q["pii_value_scan"] = "\nUNION ALL ".join(scans)
    ord_req = {"id": "order_id", "shop_id": "'shop-test'", "order_number": "order_id", "currency": "'USD'",
               "subtotal_price": "total_price", "total_discounts": "0", "total_price": "total_price",
               "has_active_campaign": "(oc_id IS NOT NULL)", "is_free_shipping": "(shipping_discount_amount > 0)",
               "shipping_original_price": "shipping_discount_amount", "shipping_price_charged": "0",
               "shipping_discount_amount": "shipping_discount_amount", "cost_total": "cost_total",
               "revenue_with_cost": "(total_price - cost_total)", "has_partial_cost": "FALSE",
               "createdAt": "createdAt"}
    rules = [(f"required:{k}", f"{v} IS NULL") for k, v in ord_req.items()]
    rules += [(f"non_negative:{k}", f"{ord_req[k]} < 0") for k in
              ("subtotal_price", "total_price", "cost_total", "shipping_discount_amount")]
    parts = [f"SELECT 'orders' AS \"table\", '{r}' AS rule, COUNT(*) AS n_rows, "
             f"COUNT(*) FILTER (WHERE {cond}) AS n_violations FROM sh_orders" for r, cond in rules]
    parts.append("SELECT 'orders', 'unique:id', CAST(NULL AS BIGINT), CAST(COALESCE(SUM(c), 0) AS BIGINT) "
                 "FROM (SELECT order_id, COUNT(*) AS c FROM sh_orders GROUP BY 1 HAVING COUNT(*) > 1)")
    q["validate_orders"] = with_ctes(*BASE, select="\nUNION ALL ".join(parts))
    li_rules = [(f"required:{c}", f"{c} IS NULL") for c in
                ("product_id", "variant_id", "title", "price", "quantity", "total_discount")]
    li_rules += [("required:compare_at_price", "price IS NULL"), ("positive:quantity", "quantity <= 0"),
                 ("non_negative:price", "price < 0"), ("non_negative:total_discount", "total_discount < 0")]
    q["validate_lineitems"] = with_ctes(*BASE, select="\nUNION ALL ".join(
        f"SELECT 'lineitems' AS \"table\", '{r}' AS rule, COUNT(*) AS n_rows, "
        f"COUNT(*) FILTER (WHERE {cond}) AS n_violations FROM sh_lines" for r, cond in li_rules))
    broken = ord_req | {
        "cost_total": "(CASE WHEN shipping_discount_amount > 0 THEN NULL ELSE cost_total END)",
        "total_price": "(CASE WHEN oc_id IS NOT NULL THEN -total_price ELSE total_price END)"}
    rules = [(f"required:{k}", f"{v} IS NULL") for k, v in broken.items()]
    rules += [(f"non_negative:{k}", f"{broken[k]} < 0") for k in
              ("subtotal_price", "total_price", "cost_total", "shipping_discount_amount")]
    parts = [f"SELECT 'orders' AS \"table\", '{r}' AS rule, COUNT(*) AS n_rows, "
             f"COUNT(*) FILTER (WHERE {cond}) AS n_violations FROM sh_orders" for r, cond in rules]
    parts.append("SELECT 'orders', 'unique:id', CAST(NULL AS BIGINT), CAST(0 AS BIGINT)")
    parts += [f"SELECT 'lineitems', '{r}', COUNT(*), COUNT(*) FILTER (WHERE {cond}) FROM sh_lines"
              for r, cond in (("required:price", "quantity = 1"), ("positive:quantity", "quantity = 2"))]
    parts += [f"SELECT 'lineitems', '{r}', COUNT(*), CAST(0 AS BIGINT) FROM sh_lines" for r in (
        "required:product_id", "required:variant_id", "required:title", "required:quantity", "required:total_discount",
        "required:compare_at_price", "non_negative:price", "non_negative:total_discount")]
    q["validate_breaches"] = with_ctes(*BASE, select="\nUNION ALL ".join(parts))
    q["ingest_clean"] = with_ctes(*BASE, select="""
SELECT 'orders' AS frame, COUNT(*) AS n_rows, CAST(18 AS INTEGER) AS n_columns FROM sh_orders
UNION ALL SELECT 'lineitems', COUNT(*), CAST(23 AS INTEGER) FROM sh_lines
UNION ALL SELECT 'campaigns', COUNT(*), CAST(13 AS INTEGER) FROM sh_campaigns
UNION ALL SELECT 'shop', CAST(1 AS BIGINT), CAST(6 AS INTEGER)""")

    # -- contracts on derived frames -----------------------------------------------
    def counts(table: str, frame: str, rules: list[tuple[str, str]]) -> str:
        return "\nUNION ALL ".join(
            f"SELECT '{table}' AS \"table\", '{r}' AS rule, COUNT(*) AS n_rows, "
            f"COUNT(*) FILTER (WHERE COALESCE({cond}, FALSE)) AS n_violations FROM {frame}" for r, cond in rules)
    # breaches seeded by order id: a record that is no object (31) or cut off (37) has no others; both: [1] cut off
    q["intake_breaches"] = with_ctes(*BASE, BREACHED, select="""
SELECT "table", rule, CAST(SUM(n) AS BIGINT) AS n_violations FROM (
  SELECT 'orders' AS "table", rule, 1 AS n FROM breach_orders
  UNION ALL SELECT 'orders', rule, 1 FROM breach_lines
  UNION ALL SELECT 'shop', rule, n FROM (VALUES
    ('absent:shopifyDomain', 2), ('absent:country', 1), ('absent:currency', 1), ('absent:planName', 2),
    ('absent:createdAt', 2), ('type:country', 1), ('null:currency', 1), ('syntax:', 1)) AS t(rule, n))
GROUP BY 1, 2""")
    q["intake_breach_rows"] = with_ctes(*BASE, BREACHED, select="""
SELECT CAST(order_id AS VARCHAR) AS row_id,
       'line_items[' || CAST(pos AS VARCHAR) || '].' || replace(substr(rule, strpos(rule, '[].') + 3), '[]', '[0]') AS path,
       split_part(rule, ':', 1) AS reason
FROM breach_lines""")
    q["ingest_report"] = with_ctes(*BASE, BREACHED, select="""
SELECT 'observed' AS section, 'orders' AS "table", 'records' AS item, COUNT(*) AS n FROM sh_orders
UNION ALL SELECT 'observed', 'orders', 'rejected', COUNT(DISTINCT order_id) FROM (
  SELECT order_id FROM breach_orders UNION ALL SELECT order_id FROM breach_lines)
UNION ALL SELECT 'rule', 'orders', rule, COUNT(*) FROM (
  SELECT rule FROM breach_orders UNION ALL SELECT rule FROM breach_lines) GROUP BY rule
UNION ALL SELECT 'frame', 'orders', 'rows', COUNT(*) FROM sh_orders
UNION ALL SELECT 'frame', 'lineitems', 'rows', COUNT(*) FROM read_lines
UNION ALL SELECT 'audit', 'orders', item, COUNT(*) FILTER (WHERE held)
FROM (SELECT item, item IN ('applied_campaigns', 'order_campaigns') OR (readable AND (item = 'shop_id' OR order_id % 7 <> 0)) AS held
      FROM read_orders, (VALUES ('shop_id'), ('currency'), ('applied_campaigns'), ('order_campaigns')) AS i(item)) GROUP BY item
UNION ALL SELECT 'audit', 'lineitems', item, COUNT(*) FILTER (WHERE (item <> 'currency' OR order_id % 7 <> 0)
                                                              AND (item <> 'active_campaign_id' OR active_campaign_id IS NOT NULL))
FROM read_lines, (VALUES ('shop_id'), ('currency'), ('title'), ('active_campaign_id'), ('active_campaign_ids'),
                         ('campaign_discounts')) AS i(item) GROUP BY item
UNION ALL SELECT * FROM (VALUES
  ('observed', 'campaigns', 'records', 9), ('observed', 'campaigns', 'rejected', 0), ('observed', 'shop', 'records', 3),
  ('observed', 'shop', 'rejected', 3), ('frame', 'campaigns', 'rows', 9), ('frame', 'shop', 'rows', 3),
  ('rule', 'shop', 'single:record', 3), ('rule', 'shop', 'absent:shopifyDomain', 2), ('rule', 'shop', 'absent:country', 1),
  ('rule', 'shop', 'absent:currency', 1), ('rule', 'shop', 'absent:planName', 2), ('rule', 'shop', 'absent:createdAt', 2),
  ('rule', 'shop', 'type:country', 1), ('rule', 'shop', 'null:currency', 1), ('rule', 'shop', 'syntax:', 1),
  ('audit', 'campaigns', 'id', 9), ('audit', 'campaigns', 'shopId', 9), ('audit', 'campaigns', 'name', 9),
  ('audit', 'campaigns', 'type', 9), ('audit', 'campaigns', 'status', 9), ('audit', 'shop', 'id', 2),
  ('audit', 'shop', 'shopifyDomain', 0), ('audit', 'shop', 'country', 0), ('audit', 'shop', 'currency', 0),
  ('audit', 'shop', 'planName', 0)) AS t(section, "table", item, n)""")
    q["product_profiles"] = with_ctes(*cls, select="""
SELECT product_id, title, units_sold, revenue, gross_margin_alloc, margin_pct, velocity_per_day, movement_class,
       data_sufficient,
       'allocated_cost=' || CAST(CAST(allocated_cost AS DECIMAL(20,4)) AS VARCHAR)
       || ';classification_method=tertiles of velocity over products with enough units'
       || ';data_sufficient=' || CAST(data_sufficient AS VARCHAR)
       || ';first_order_date=' || CAST(CAST(product_first_order_date AS DATE) AS VARCHAR)
       || ';insufficiency_note=' || CASE WHEN data_sufficient THEN '' ELSE CAST(units_sold AS VARCHAR) || ' of 500 units' END
       || ';last_order_date=' || CAST(CAST(product_last_order_date AS DATE) AS VARCHAR)
       || ';margin_method=line net revenue less order cost allocated by revenue share'
       || ';min_units=500'
       || ';revenue=' || CAST(CAST(revenue AS DECIMAL(20,4)) AS VARCHAR)
       || ';truth_caveat=structural per-line fields; indicative only'
       || ';units_sold=' || CAST(units_sold AS VARCHAR)
       || ';velocity_per_day=' || CAST(CAST(velocity_per_day AS DECIMAL(20,6)) AS VARCHAR)
       || ';window_days=' || CAST(window_days AS VARCHAR) AS evidence
FROM classified""")
    q["contract_profiles"] = with_ctes(*cls, select=counts("profiles", "classified", [
        *[(f"required:{c}", f"{c} IS NULL") for c in ("product_id", "title", "units_sold", "revenue", "gross_margin_alloc",
                                                      "margin_pct", "velocity_per_day", "data_sufficient")],
        ("domain:movement_class", "movement_class NOT IN ('fast', 'medium', 'slow') OR movement_class IS NULL")]))
    q["contract_classes"] = with_ctes(*cls, select=counts("classified", "classified", [
        ("domain:movement_class", "movement_class NOT IN ('fast', 'medium', 'slow') OR movement_class IS NULL"),
        ("required:data_sufficient", "data_sufficient IS NULL")]))
    q["contract_verdicts"] = with_ctes(*camp, select=counts("campaign_eval", "campaign_eval", [
        ("domain:verdict", "verdict NOT IN ('success', 'flop', 'inconclusive') OR verdict IS NULL"),
        ("range:confidence", "NOT (confidence BETWEEN 0.0 AND 1.0) OR confidence IS NULL"),
        ("required:reason_code", "reason_code IS NULL"),
        ("non_negative:window_days", "window_days < 0")]))
    mech_list = ", ".join(lit(m) for m in MECHANIC_EFFORT)
    q["contract_recommendations"] = with_ctes(*recs, select=counts("recommendations", "recommendations", [
        ("domain:recommended_mechanic",
         f"recommended_mechanic NOT IN ({mech_list}) OR recommended_mechanic IS NULL"),
        ("required:product_id", "product_id IS NULL"), ("required:title", "title IS NULL"),
        ("range:confidence", "NOT (confidence BETWEEN 0.0 AND 1.0) OR confidence IS NULL"),
        ("finite:priority_score", "priority_score IS NULL OR isnan(priority_score) OR isinf(priority_score)"),
        ("required:rationale", "rationale IS NULL"),
        ("required:expected_effect", "expected_effect IS NULL")]))
    q["contract_breaches"] = with_ctes(*recs, select="""
SELECT 'recommendations' AS "table", t.rule, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE
    (t.rule = 'domain:recommended_mechanic' AND movement_class = 'slow')
    OR (t.rule = 'required:title' AND margin_band = 'low')
    OR (t.rule = 'range:confidence' AND movement_class = 'fast')
    OR (t.rule = 'finite:priority_score' AND movement_class = 'medium')) AS n_violations
FROM recommendations CROSS JOIN (VALUES ('domain:recommended_mechanic'), ('required:product_id'), ('required:title'),
  ('range:confidence'), ('finite:priority_score'), ('required:rationale'), ('required:expected_effect')) AS t(rule)
GROUP BY t.rule""")
    q["contract_segments"] = with_ctes(*recs, seg, select=counts("segments", "segments", [
        ("domain:discount_mechanic", f"discount_mechanic NOT IN ({mech_list}) OR discount_mechanic IS NULL"),
        ("required:segment_id", "segment_id IS NULL"), ("required:segment_label", "segment_label IS NULL"),
        ("required:rationale", "rationale IS NULL"),
        ("range:priority", "NOT (priority BETWEEN 1 AND 5) OR priority IS NULL"),
        ("non_empty:segment", "n_products <= 0")]))

    # -- sinks -----------------------------------------------------------------------
    q["sink_csv_roundtrip"] = with_ctes(*recs, select=f"""
SELECT {rec_cols.replace("array_to_string(evidence_refs, ';') AS evidence_refs",
                         "CAST(to_json(evidence_refs) AS VARCHAR) AS evidence_refs")} FROM recommendations""")
    oc_struct = ("struct_pack(campaignId := oc_id, campaignName := 'Campaign ' || oc_id, "
                 "campaignType := c.type, discountAmount := CAST(0.0 AS DOUBLE), "
                 "shippingDiscountType := CAST(CASE WHEN c.type = 'shipping' THEN 1 END AS INTEGER), "
                 "shippingDiscountValue := CAST(CASE WHEN c.type = 'shipping' THEN 9.99 END AS DOUBLE))")
    q["flatten_complex_to_json"] = with_ctes(*BASE, select=f"""
SELECT o.order_id, '[]' AS applied_campaigns,
       CASE WHEN o.oc_id IS NULL THEN '[]' ELSE CAST(to_json([{oc_struct}]) AS VARCHAR) END AS order_campaigns
FROM sh_orders o LEFT JOIN sh_campaigns c ON o.oc_id = c.id""")
    q["json_records"] = with_ctes(*camp, select="SELECT * FROM campaign_eval")
    q["bundle_sections"] = with_ctes(*recs, seg, select="""
SELECT 'recommendations' AS section, COUNT(*) AS n_records FROM recommendations
UNION ALL SELECT 'campaign_eval', COUNT(*) FROM campaign_eval
UNION ALL SELECT 'segments', COUNT(*) FROM segments""")
    q["campaign_mechanics"] = with_ctes(*camp, select=f"""
SELECT campaign_id, type, verdict, {case_map(CAMPAIGN_TYPE_TO_MECHANIC, "type")} AS mechanic FROM campaign_eval""")
    q["observed_counts"] = with_ctes(*clearance, select="""
SELECT 'lines' AS metric, COUNT(*) AS n FROM lr
UNION ALL SELECT 'clipped_lines', COUNT(*) FILTER (WHERE net_clipped) FROM lr
UNION ALL SELECT 'orders', COUNT(*) FROM onr
UNION ALL SELECT 'zero_revenue_orders', COUNT(*) FILTER (WHERE order_net_revenue = 0) FROM onr""")
    ranked = """
organic AS (
  SELECT product_id, order_id, createdAt, row_number() OVER (PARTITION BY product_id ORDER BY createdAt, order_id) AS rank
  FROM lm WHERE active_campaign_id IS NULL GROUP BY 1, 2, 3),
surviving AS (
  SELECT DISTINCT b.campaign_id, b.product_id, o.rank
  FROM base b JOIN organic o ON b.product_id = o.product_id AND b.order_id = o.order_id AND b.createdAt = o.createdAt),
islands AS (
  SELECT *, rank - row_number() OVER (PARTITION BY campaign_id, product_id ORDER BY rank) AS island FROM surviving)
"""
    q["baseline_runs"] = with_ctes(*camp, ranked, select="""
SELECT campaign_id, product_id, CAST(MIN(rank) AS BIGINT) AS first_rank, CAST(MAX(rank) AS BIGINT) AS last_rank
FROM islands GROUP BY campaign_id, product_id, island""")
    q["baseline_expanded"] = with_ctes(*camp, select=(
        f"SELECT campaign_id, {line_cols} FROM base WHERE campaign_id IN ('k4', 'k7')"))
    evidence = """
seg_rec AS (
  SELECT concat_ws('/', movement_class, margin_band, recommended_mechanic) AS segment_id, * FROM recommendations),
seg_top AS (
  SELECT segment_id, product_id, 0 AS kind, 'product:' || CAST(product_id AS VARCHAR) || ':' || CAST(priority_score AS VARCHAR) AS ref,
         row_number() OVER (PARTITION BY segment_id ORDER BY priority_score DESC, product_id, title) AS nth FROM seg_rec),
seg_camp AS (
  SELECT segment_id, ref, row_number() OVER (PARTITION BY segment_id ORDER BY campaign_pos, ref) AS nth
  FROM (SELECT DISTINCT s.segment_id, r.campaign_pos, r.ref FROM (SELECT DISTINCT segment_id, policy_id FROM seg_rec) s
        JOIN policy_refs p ON p.policy_id = s.policy_id
        JOIN crefs r ON r.type = p.final_type OR r.verdict IN ('success', 'flop'))),
seg_all AS (
  SELECT segment_id, kind, nth, product_id, ref FROM seg_top WHERE nth <= 5
  UNION ALL SELECT segment_id, 1, nth, NULL, ref FROM seg_camp WHERE nth <= 5)
"""
    q["segment_evidence"] = with_ctes(*recs, evidence, select="""
SELECT segment_id, string_agg(CAST(product_id AS VARCHAR), '|' ORDER BY nth) FILTER (WHERE kind = 0) AS product_ids,
       string_agg(ref, ';' ORDER BY kind, nth) AS evidence_refs
FROM seg_all GROUP BY segment_id""")
    breach = """
b_cls AS (
  SELECT * REPLACE (CASE WHEN product_id % 5 <> 0 THEN movement_class ELSE 'steady' END AS movement_class,
                    CASE WHEN product_id % 7 <> 0 THEN data_sufficient END AS data_sufficient) FROM classified),
b_prof AS (
  SELECT * REPLACE (CASE WHEN product_id % 3 <> 0 THEN title END AS title,
                    CASE WHEN product_id % 11 <> 0 THEN margin_pct END AS margin_pct) FROM b_cls)
"""
    q["contract_breaches_derived"] = with_ctes(*recs, seg, breach, select="\nUNION ALL ".join([
        counts("classified", "b_cls", [
            ("domain:movement_class", "movement_class NOT IN ('fast', 'medium', 'slow')"),
            ("required:data_sufficient", "data_sufficient IS NULL")]),
        counts("profiles", "b_prof", [
            *[(f"required:{c}", f"{c} IS NULL") for c in ("product_id", "title", "units_sold", "revenue", "gross_margin_alloc",
                                                          "margin_pct", "velocity_per_day", "data_sufficient")],
            ("domain:movement_class", "movement_class NOT IN ('fast', 'medium', 'slow')")]),
        counts("campaign_eval", "campaign_eval", [
            ("domain:verdict", "type = 'volume'"), ("range:confidence", "type = 'shipping'"),
            ("required:reason_code", "type = 'general'"), ("non_negative:window_days", "type = 'order'")]),
        counts("segments", "segments", [
            ("domain:discount_mechanic", "FALSE"), ("required:segment_id", "FALSE"),
            ("required:segment_label", "movement_class <> 'fast' AND margin_band <> 'high'"), ("required:rationale", "FALSE"),
            ("range:priority", "margin_band = 'high'"), ("non_empty:segment", "FALSE"),
            ("required:expected_impact", "movement_class = 'fast'"), ("non_empty:product_ids", "margin_band = 'high'"),
            ("non_empty:supporting_evidence_refs", "movement_class = 'fast'")])]))
    q["bundle_document"] = with_ctes(*recs, seg, select="""
SELECT 'recommendations' AS section, CAST(product_id AS VARCHAR) AS key, recommended_mechanic AS label,
       priority_score AS amount FROM recommendations
UNION ALL SELECT 'campaign_eval', campaign_id, verdict, units_lift_ratio FROM campaign_eval
UNION ALL SELECT 'segments', segment_id, discount_mechanic, avg_confidence FROM segments""")
    q["export_outputs"] = with_ctes(*recs, select="""
SELECT 'orders_clean' AS "table", COUNT(*) AS n_rows, CAST(CAST(SUM(total_price) AS DECIMAL(18,4)) AS DOUBLE) AS total FROM sh_orders
UNION ALL SELECT 'lineitems_clean', COUNT(*), CAST(SUM(quantity) AS DOUBLE) FROM sh_lines
UNION ALL SELECT 'campaigns_clean', COUNT(*), CAST(0 AS DOUBLE) FROM sh_campaigns
UNION ALL SELECT 'product_metrics', COUNT(*), CAST(SUM(units_sold) AS DOUBLE) FROM products
UNION ALL SELECT 'product_classification', COUNT(*), CAST(SUM(units_sold) AS DOUBLE) FROM classified
UNION ALL SELECT 'campaign_eval', COUNT(*), CAST(SUM(attributed_orders) AS DOUBLE) FROM campaign_eval
UNION ALL SELECT 'recommendations', COUNT(*), CAST(SUM(CAST(priority_score AS DECIMAL(18,4))) AS DOUBLE) FROM recommendations""")
    q["input_positions"] = with_ctes(*BASE, select=(
        "SELECT order_id, row_number() OVER (ORDER BY order_id) - 1 AS pos FROM sh_orders"))
    return q
