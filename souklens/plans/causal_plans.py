"""Impact measurement: synthetic control, placebos, reaction flags, data checks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from souklens.functions.storage import shared_dir
from souklens.operators import causal, panel, quality
from souklens.plans import panel_plans as pp
from souklens.plans.registry import query
from souklens.plans.stages import stage
from souklens.sources import marketplace as mp
from souklens.sources.tables import read_table, replace_scenario

UNITS = [f"NATION_{i}" for i in range(25)]
TREATED = ["NATION_1", "NATION_3", "NATION_6", "NATION_9"]
CONTROL = [u for u in UNITS if u not in TREATED]
METRICS = ["commission_rate_per_supplier", "commission_rate_per_supplier_yoy",
           "pct_active_suppliers", "pct_online_per_supplier", "pct_days_with_slots",
           "price_index_black", "price_index_effective",
           "bookings_yoy", "tickets_yoy", "gmv_yoy", "nr_yoy",
           "visitors_yoy", "conversion_rate_yoy", "add_to_cart_rate_yoy", "unavailability_rate_yoy",
           "bookings_per_supplier", "gmv_per_supplier", "nr_per_supplier", "conversion_rate"]
# ratios to last year, and the level that each is a ratio of
YOY_BASE = {f"{m}_yoy": f"{m}_per_supplier" for m in ("bookings", "tickets", "gmv", "nr", "visitors")} | {
    f"{m}_yoy": m for m in ("conversion_rate", "add_to_cart_rate", "unavailability_rate", "commission_rate_per_supplier")} | {
    f"price_index_{m}": f"avg_price_{m}_eur" for m in ("black", "effective")}
# invented rates, in per cent
SURCHARGE = {"NATION_1": 2.0, "NATION_3": 4.0, "NATION_6": 3.0, "NATION_9": 1.0}
# behaviours looked for: a change of a supplier's measure, and the direction that counts
REACTIONS = {
    "fewer_active_days": ("active_delta", -1),
    "smaller_share_online": ("pct_online_rel", -1),
    "lower_date_coverage": ("coverage_rel", -1),
    "higher_price_index": ("price_idx_post", 1),
    "lower_commission": ("commission_delta", -1),
}
FLAG_COLS = ["flag_exited"] + [f"flag_{f}" for f in REACTIONS]
T_SUP = TREATED


def fits_for(spark, root, st):
    """Panel, normalised series and fits of a study date."""
    p = pp.merged_panel(spark, root, st)

    @stage(f"series-{st.event}")
    def series(spark, root):
        return causal.normalise(causal.complete_panel(p, TREATED + CONTROL, METRICS), st.event)

    n = series(spark, root)

    @stage(f"fits-{st.event}")
    def fits(spark, root):
        return causal.synthetic_control(n, TREATED, CONTROL)

    return p, n, fits(spark, root)


LONG = pp.PANELS + f""",
long AS (SELECT week_start, country_name, metric, value FROM (SELECT week_start, country_name, {', '.join(f'{m}::DOUBLE AS {m}' for m in METRICS)} FROM merged)
      UNPIVOT (value FOR metric IN ({', '.join(METRICS)})) WHERE country_name IN ({', '.join(repr(c) for c in UNITS)})),
whole AS (SELECT * FROM long QUALIFY count(*) OVER (PARTITION BY metric, week_start) = {len(UNITS)})"""


@query("synthetic_control_fits", "C23", doubles="treat_pre_mean:3 did:3 pre_rmse:3")
def synthetic_control_fits(spark, root):
    _, _, f = fits_for(spark, root, pp.ST)
    return f.drop("weights", "gap")


@query("synthetic_control_certificates", "C23", doubles="treat_pre_mean:4",
       sql=LONG + f""", f AS (SELECT metric, country_name AS treated, CAST(count(*) FILTER (week_start < {pp.EV}) AS INTEGER) AS n_pre,
    CAST(count(*) FILTER (week_start >= {pp.EV}) AS INTEGER) AS n_post, avg(value) FILTER (week_start < {pp.EV}) AS treat_pre_mean FROM whole GROUP BY ALL),
z AS (SELECT metric FROM f GROUP BY metric HAVING min(n_pre) >= 8 AND min(n_post) >= 1 AND bool_and(treat_pre_mean <> 0))
SELECT metric, treated, treated IN ({', '.join(repr(c) for c in TREATED)}) AS is_treated, n_pre, n_post, treat_pre_mean,
  CASE WHEN treated IN ({', '.join(repr(c) for c in TREATED)}) THEN {len(CONTROL)} ELSE {len(CONTROL) - 1} END AS donors,
  TRUE AS weights_not_negative, TRUE AS weights_sum_to_one, TRUE AS certified FROM f WHERE metric IN (SELECT metric FROM z)""")
def synthetic_control_certificates(spark, root):
    """Every fit that the panel allows is there, with weights on the simplex that the duality gap proves to be best."""
    _, _, f = fits_for(spark, root, pp.ST)
    return causal.certificates(f)


@query("synthetic_control_series", "C23", doubles="actual:3 synthetic:3")
def synthetic_control_series(spark, root):
    _, n, f = fits_for(spark, root, pp.ST)
    return causal.synthetic_series(n, f)


@query("placebo_in_space", "C24", doubles="did:3 pre_rmse:3 treat_pre_mean:3")
def placebo_in_space(spark, root):
    _, _, f = fits_for(spark, root, pp.ST)
    return causal.placebo_in_space(f)


@query("placebo_in_time", "C25", doubles="did:3 pre_rmse:3 treat_pre_mean:3")
def placebo_in_time(spark, root):
    path = f"{shared_dir(spark)}/souklens-placebo-{uuid.uuid4().hex}"
    for name, event in (("real", pp.ST.event), ("placebo", pp.ST.event - timedelta(weeks=44))):
        _, _, f = fits_for(spark, root, panel.Study(event, as_of=pp.ST.as_of))
        found = causal.placebo_in_space(f).withColumn("scenario", F.lit(name))
        replace_scenario(found, path)
    return spark.read.schema(found.schema).parquet(path)   # a scenario without a fit has no files


@query("level_corrected_gap", "C26", doubles="did_absolute:3")
def level_corrected_gap(spark, root):
    p, n, f = fits_for(spark, root, pp.ST)
    levels = causal.level_corrected(causal.synthetic_series(n, f), p, YOY_BASE)
    return causal.mean_post_gap(levels)


@query("donor_usage", "C27", doubles="avg_weight:3 share_models_used:3")
def donor_usage(spark, root):
    _, _, f = fits_for(spark, root, pp.ST)
    return causal.donor_usage(f)


@query("complete_panel", "R4", doubles="value:4", sql=LONG + " SELECT week_start, country_name, metric, value FROM whole")
def complete_panel(spark, root):
    return causal.complete_panel(pp.merged_panel(spark, root), UNITS, METRICS)


def flagged(spark, root):
    e = causal.with_deltas(causal.with_dose(pp.entity_frame(spark, root), SURCHARGE))
    return causal.reaction_flags(e, causal.control_scales(e, ~treated(), REACTIONS), REACTIONS)


def treated():
    return F.col("country_name").isin(T_SUP)


TL = ", ".join(repr(c) for c in T_SUP)
FLAG_SQL = pp.ENTITY + f""",
dose AS (SELECT *, CASE country_name {' '.join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in SURCHARGE.items())} ELSE 0.0::DOUBLE END AS surcharge_pct,
          nr_pre / nullif(gmv_pre, 0) AS base_rate FROM ent),
dl AS (SELECT *, base_rate * (1 + surcharge_pct / 100) AS effective_rate, base_rate * surcharge_pct / 100 AS rate_increase,
         gmv_pre * (base_rate * surcharge_pct / 100) AS projected_amount, active_share_post - active_share_pre AS active_delta,
         (pct_online_post - pct_online_pre) / nullif(pct_online_pre, 0) AS pct_online_rel,
         (coverage_post - coverage_pre) / nullif(coverage_pre, 0) AS coverage_rel,
         nr_post / nullif(gmv_post, 0) - base_rate AS commission_delta, country_name IN ({TL}) AS t FROM dose),
""" + "q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) FILTER (NOT t) AS med_{f}, " +
    (f"quantile_cont({c}, 0.95) FILTER (NOT t) - quantile_cont({c}, 0.5) FILTER (NOT t)" if sign > 0 else
     f"quantile_cont({c}, 0.5) FILTER (NOT t) - quantile_cont({c}, 0.05) FILTER (NOT t)") + f" AS tail_{f}"
    for f, (c, sign) in REACTIONS.items()) + " FROM dl),\nsv AS (SELECT dl.*, " + ", ".join(
    f"CASE WHEN {c} IS NULL OR med_{f} IS NULL THEN NULL WHEN tail_{f} IS NULL OR tail_{f} <= 0 THEN CASE WHEN {sign} * ({c} - med_{f}) > 0 THEN 9.99::DOUBLE ELSE 0.0::DOUBLE END "
    f"ELSE least(greatest({sign} * ({c} - med_{f}) / tail_{f}, 0.0), 9.99) END AS severity_{f}"
    for f, (c, sign) in REACTIONS.items()) + """ FROM dl, q),
fl0 AS (SELECT *, coalesce(active_share_pre > 0 AND active_share_post = 0, false) AS flag_exited, """ + ", ".join(
    f"coalesce(severity_{f}, 0) >= 1 AS flag_{f}" for f in REACTIONS) + """ FROM sv),
fl AS (SELECT *, """ + " + ".join(f"{c}::INTEGER" for c in FLAG_COLS) + """ AS n_flags FROM fl0),
fin AS (SELECT *, n_flags > 0 AS any_flag, CASE WHEN n_flags > 0 THEN gmv_pre ELSE 0 END AS value_at_risk FROM fl)"""
SEVS = " ".join(f"severity_{f}:5" for f in REACTIONS)


@query("reaction_flags", "C29 C32 A10 F4", doubles=SEVS + " value_at_risk:2 projected_amount:4 effective_rate",
       sql=FLAG_SQL + " SELECT supplier_id, country_name, n_flags, any_flag, value_at_risk, projected_amount, effective_rate, " +
       ", ".join(FLAG_COLS) + ", " + ", ".join(f"severity_{f}" for f in REACTIONS) + " FROM fin")
def reaction_flags(spark, root):
    return flagged(spark, root).select("supplier_id", "country_name", "n_flags", "any_flag", "value_at_risk", "projected_amount",
                                       "effective_rate", *FLAG_COLS, *[f"severity_{f}" for f in REACTIONS])


@query("flag_excess_rates", "C30", doubles="treatment_rate control_rate excess",
       sql=FLAG_SQL + " " + " UNION ALL ".join(
           f"SELECT '{c}' AS flag, avg({c}::INTEGER) FILTER (t) AS treatment_rate, avg({c}::INTEGER) FILTER (NOT t) AS control_rate, "
           f"avg({c}::INTEGER) FILTER (t) - avg({c}::INTEGER) FILTER (NOT t) AS excess FROM fin" for c in FLAG_COLS))
def flag_excess_rates(spark, root):
    return causal.flag_excess_rates(flagged(spark, root), treated())


@query("flags_by_country", "C30", doubles="value_at_risk:2",
       sql=FLAG_SQL + " SELECT country_name, " + ", ".join(f"CAST(sum({c}::INTEGER) AS BIGINT) AS {c}" for c in FLAG_COLS) +
       ", CAST(sum(any_flag::INTEGER) AS BIGINT) AS any_flag, count(*) AS suppliers, sum(value_at_risk) AS value_at_risk FROM fin WHERE t GROUP BY 1")
def flags_by_country(spark, root):
    return causal.flags_by_country(flagged(spark, root), treated())


@query("flag_combinations", "C30 A24",
       sql=FLAG_SQL + " SELECT concat_ws(' + ', " + ", ".join(
           f"CASE WHEN {c} THEN '{c.replace('flag_', '')}' END" for c in FLAG_COLS) +
       ") AS combination, count(*) AS suppliers FROM fin WHERE t AND n_flags >= 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def flag_combinations(spark, root):
    return causal.flag_combinations(flagged(spark, root), treated())


@query("dose_by_flag", "C30 C32", doubles="avg_rate_increase:8",
       sql=FLAG_SQL + " SELECT any_flag, avg(rate_increase) AS avg_rate_increase, count(*) AS suppliers FROM fin WHERE t GROUP BY 1")
def dose_by_flag(spark, root):
    return causal.dose_by_flag(flagged(spark, root), treated())


@query("action_list", "C31 O2", doubles="value_at_risk:2 projected_amount:4",
       sql=FLAG_SQL + " SELECT supplier_id, country_name, n_flags, value_at_risk, projected_amount FROM fin WHERE t AND any_flag "
       "ORDER BY value_at_risk DESC, supplier_id LIMIT 25")
def action_list(spark, root):
    return causal.action_list(flagged(spark, root), treated()).select("supplier_id", "country_name", "n_flags", "value_at_risk", "projected_amount")


FRAMES = ("supply", "price", "realised", "traffic")
NO_NULLS = ["pct_active_suppliers", "pct_online_per_supplier", "pct_days_with_slots", "price_index_black", "commission_rate_per_supplier",
            "bookings_yoy", "nr_yoy", "visitors_yoy", "conversion_rate_yoy"]
SHARES = ["pct_active_suppliers", "pct_online_per_supplier", "pct_days_with_slots", "add_to_cart_rate", "conversion_rate", "unavailability_rate"]
BOUNDS = {c: (0.0, 1.0) for c in SHARES} | {f"price_index_{c}": (0.5, 2.0) for c in ("black", "effective")} | {
    "commission_rate_per_supplier": (0.001, 0.5)} | {f"{c}_yoy": (0.2, 5.0) for c in ("bookings", "gmv", "nr", "visitors")}
NOT_ABOVE = {"active_suppliers": ("cohort_suppliers", 1.0), "active_activities": ("cohort_activities", 1.0), "avg_price_effective_eur": ("avg_price_black_eur", 1.001)}


def _bad_sql(name, condition, frame):
    return f"SELECT '{name}' AS check_name, count(*) FILTER ({condition}) = 0 AS ok, count(*) FILTER ({condition}) AS f FROM {frame}"


def _checks_sql():
    out = []
    for name, cte in zip(FRAMES, ("supply", "pricep", "realised", "trafficp")):
        per = f"(SELECT country_name, count(DISTINCT week_start) AS w, count(DISTINCT week_start) FILTER (week_start < {pp.EV}) AS pre FROM {cte} GROUP BY 1)"
        out.append(f"SELECT '{name}: 25 units present' AS check_name, count(*) = 25 AS ok, count(*) AS f FROM {per}")
        out += [_bad_sql(f"{name}: 16 weeks per unit", "w <> 16", per), _bad_sql(f"{name}: same number of weeks before and after", "pre * 2 <> w", per)]
    out += [_bad_sql(f"{c} has no missing value", f"{c} IS NULL", "merged") for c in NO_NULLS]
    out += [_bad_sql(f"{c} in [{lo}, {hi}]", f"NOT {c} BETWEEN {lo} AND {hi}", "merged") for c, (lo, hi) in BOUNDS.items()]
    out += [_bad_sql(f"{a} <= {b}", f"coalesce({a} > {k}::DOUBLE * {b}, TRUE)", "merged") for a, (b, k) in NOT_ABOVE.items()]
    out.append("SELECT 'supplier_id is unique', count(*) = count(DISTINCT supplier_id), count(*) - count(DISTINCT supplier_id) FROM sizes")
    return " UNION ALL ".join(out)


@query("data_checks", "C33", sql=pp.PANELS + f", c AS ({_checks_sql()}) SELECT check_name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result, CAST(f AS VARCHAR) AS found FROM c")
def data_checks(spark, root):
    """All rules over all four frames and over the merged one; a rule that fails on small data is a finding, not an error."""
    merged = pp.merged_panel(spark, root)
    own = {"supply": "pct_active_suppliers", "price": "suppliers_with_price", "realised": "bookings_per_supplier", "traffic": "visitors"}
    out = quality.panel_checks(merged, NO_NULLS, BOUNDS, NOT_ABOVE)
    for name in FRAMES:  # a row of the merged panel is a row of a frame if it has the frame's own column
        out = out.unionByName(quality.frame_checks(merged.filter(F.col(own[name]).isNotNull()), name, 25, 16, pp.ST.event))
    sizes = panel.cohort_sizes(pp.pool(spark, root), pp.acts(spark, root))
    return out.unionByName(quality.unique_check(sizes, "supplier_id"))


@query("reconcile_panels", "C34", doubles="max_rel_diff",
       sql=pp.COHORT + """, o AS (SELECT week_start, country_name, count(DISTINCT booking_id) AS bookings, sum(gmv) AS gmv, sum(tickets) AS tickets
  FROM (SELECT *, CAST(date_trunc('week', checkout_date) AS DATE) AS week_start FROM cb) GROUP BY ALL),
j AS (SELECT a.bookings AS ab, o.bookings AS ob, a.gmv AS ag, o.gmv AS og, a.tickets AS at_, o.tickets AS ot FROM cwk a FULL JOIN o USING (week_start, country_name)),
r AS (SELECT count(*) FILTER (ab IS NOT NULL AND ob IS NOT NULL) AS n, count(*) FILTER (ob IS NULL) AS l, count(*) FILTER (ab IS NULL) AS rr, max(abs(ab - ob) / nullif(abs(ob), 0)) AS b, max(abs(ag - og) / nullif(abs(og), 0)) AS g,
        max(abs(at_ - ot) / nullif(abs(ot), 0)) AS t FROM j),
u AS (SELECT 'bookings' AS metric, n AS matched_rows, l AS only_left, rr AS only_right, b AS max_rel_diff FROM r
  UNION ALL SELECT 'gmv', n, l, rr, g FROM r UNION ALL SELECT 'tickets', n, l, rr, t FROM r)
SELECT *, CASE WHEN only_left + only_right > 0 THEN 'MISMATCH' WHEN max_rel_diff < 0.01 THEN 'OK' WHEN max_rel_diff < 0.05 THEN 'check' ELSE 'MISMATCH' END AS verdict FROM u""")
def reconcile_panels(spark, root):
    a = pp.acts(spark, root)
    b = mp.bookings(spark, root, pp.ST.ranges())
    one = panel.realised_weekly(b, a, pp.ST)
    two = panel.cohort_bookings(b, a, pp.ST).groupBy(panel.week_of("checkout_date").alias("week_start"), "country_name").agg(
        F.countDistinct("booking_id").alias("bookings"), F.sum("gmv").alias("gmv"), F.sum("tickets").alias("tickets"))
    return quality.reconcile(one, two, ["week_start", "country_name"], ["bookings", "gmv", "tickets"])


# two sources of an order's value that share no column: its lines, and the total in its head
@query("reconcile_order_totals", "C34",
       sql="""WITH a AS (SELECT l_orderkey AS cart_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS cart_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT coalesce(a.cart_id, b.cart_id) AS cart_id, a.cents AS a_cents, b.cents AS b_cents,
  CASE WHEN b.cart_id IS NULL THEN 'only in a' WHEN a.cart_id IS NULL THEN 'only in b' ELSE 'differs' END AS found
FROM a FULL JOIN b ON a.cart_id = b.cart_id WHERE a.cents IS DISTINCT FROM b.cents""")
def reconcile_order_totals(spark, root):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = read_table(spark, "lineitem", root).groupBy(F.col("l_orderkey").alias("cart_id")).agg(F.sum(cents("l_extendedprice")).alias("cents"))
    heads = read_table(spark, "orders", root).select(F.col("o_orderkey").alias("cart_id"), cents("o_totalprice").alias("cents"))
    return quality.differing_rows(lines, heads, ["cart_id"], ["cents"])
