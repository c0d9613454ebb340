"""Portal engagement, supplier actions and event funnels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.functions.labels import edge_bucket, two_flag_segment
from souklens.operators import engagement as en
from souklens.plans import sqlbase as sb
from souklens.plans.registry import query
from souklens.plans.stages import stage
from souklens.sources import marketplace as mp

AS_OF = date(2001, 6, 30)
LAUNCH = date(1999, 1, 1)
A = "DATE '2001-06-30'"


def supplier_base(spark, root):
    s = mp.suppliers(spark, root)
    return s.join(en.last_logins(mp.supplier_days(spark, root, [(date(1995, 1, 1), AS_OF)]), AS_OF), "supplier_id", "left")


@stage("relevant-suppliers")
def relevant(spark, root):
    b = mp.bookings(spark, root, [(date(2000, 6, 30), AS_OF)], place=False)
    return en.relevant_entities(b, mp.online_history(spark, root, [(date(1990, 1, 1), AS_OF)]), AS_OF)


REL = sb.with_(sb.BOOKING, sb.ONLINE, sb.LOGIN) + f""",
pa AS (SELECT supplier_id, line_id AS activity_id, count(*) AS n FROM booking WHERE checkout_date BETWEEN {A} - 365 AND {A} AND status_id IN (1, 2) GROUP BY ALL),
fo AS (SELECT supplier_id, activity_id, min(day) AS first_online FROM online WHERE is_online AND day <= {A} GROUP BY ALL),
aj AS (SELECT a.supplier_id, a.activity_id, coalesce(first_online >= {A} - 30, false) AS fresh, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT supplier_id, activity_id FROM online WHERE day <= {A}) a LEFT JOIN fo USING (supplier_id, activity_id) LEFT JOIN pa USING (supplier_id, activity_id)),
rel AS (SELECT supplier_id, CAST(count(*) FILTER (fresh OR n > 1) AS BIGINT) AS relevant_activities, CAST(sum(n) AS BIGINT) AS bookings_l365, CAST(max(fresh::INTEGER) AS INTEGER) AS has_new FROM aj GROUP BY 1
  HAVING count(*) FILTER (fresh OR n > 1) > 0 AND (sum(n) > 1 OR bool_or(fresh))),
ll AS (SELECT supplier_id, max(day) AS last_login FROM logins WHERE logins > 0 AND day <= {A} GROUP BY 1),
sb AS (SELECT sup.*, last_login, rel.supplier_id IS NOT NULL AS is_relevant FROM sup LEFT JOIN ll USING (supplier_id) LEFT JOIN rel USING (supplier_id))"""


def rates_sql(key: str, src: str, value: str = "") -> str:
    v = f", avg({value}) AS avg_value" if value else ""
    return f"""SELECT {key}, count(*) AS suppliers, {', '.join(f"100.0::DOUBLE * count(*) FILTER ({A} - last_login <= {d}) / count(*) AS l{d}_pct" for d in (7, 30, 90))}{v},
  100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct FROM {src} GROUP BY 1"""


RATE_D = "l7_pct:5 l30_pct:5 l90_pct:5 share_pct:5"


@query("relevant_suppliers", "P14", sql=REL + " SELECT * FROM rel")
def relevant_suppliers(spark, root):
    return relevant(spark, root)


@query("login_rates_by_cohort", "C63 J12", doubles=RATE_D, sql=REL + f", c AS (SELECT *, CASE WHEN is_relevant THEN 'Relevant' ELSE 'Not relevant' END AS cohort FROM sb) {rates_sql('cohort', 'c')}")
def login_rates_by_cohort(spark, root):
    flagged = supplier_base(spark, root).join(relevant(spark, root).select("supplier_id", F.lit(1).alias("_r")), "supplier_id", "left")
    return en.login_rates(flagged.withColumn("cohort", F.when(F.col("_r") == 1, "Relevant").otherwise("Not relevant")), "cohort", AS_OF)


@query("login_rates_by_segment", "C63 O1", doubles=RATE_D, sql=REL + " " + rates_sql("region_name", "(SELECT * FROM sb WHERE is_relevant)"))
def login_rates_by_segment(spark, root):
    return en.login_rates(supplier_base(spark, root).join(relevant(spark, root).select("supplier_id"), "supplier_id", "left_semi"), "region_name", AS_OF)


SEG = "CASE WHEN is_managed THEN 'Managed' ELSE 'Non-Managed' END || ' + ' || CASE WHEN is_connected THEN 'Connected' ELSE 'Non-Connected' END"


@query("login_rates_managed_connected", "C63 P16 A19", doubles=RATE_D + " avg_value:4",
       sql=REL + f", c AS (SELECT *, {SEG} AS segment, nr FROM sb JOIN (SELECT supplier_id, sum(nr) AS nr FROM booking WHERE checkout_date BETWEEN {A} - 365 AND {A} AND status_id IN (1, 2) GROUP BY 1) USING (supplier_id) WHERE is_relevant) "
       + rates_sql("segment", "c", "nr"))
def login_rates_managed_connected(spark, root):
    v = yearly_value(spark, root)
    s = supplier_base(spark, root).join(relevant(spark, root).select("supplier_id"), "supplier_id", "left_semi").join(v, "supplier_id")
    return en.login_rates(s.withColumn("segment", two_flag_segment(F.col("is_managed"), F.col("is_connected"), "Managed", "Connected")), "segment", AS_OF, "nr")


def yearly_value(spark, root):
    b = mp.bookings(spark, root, [(date(2000, 6, 30), AS_OF)], place=False).filter(F.col("status_id").isin(1, 2))
    return b.groupBy("supplier_id").agg(F.sum("nr").alias("nr"))


@query("monthly_reach", "C64 F3", doubles="total_value:2 value_logged_in:2 value_weighted_pct:5",
       sql=REL + """, l AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, supplier_id, max((logins > 0)::INTEGER) AS o FROM logins
   WHERE is_active AND day >= DATE '2000-07-01' AND day < DATE '2001-07-01' GROUP BY ALL),
v AS (SELECT CAST(date_trunc('month', checkout_date) AS DATE) AS month, supplier_id, sum(gmv) AS gmv FROM booking
   WHERE gmv > 0 AND checkout_date >= DATE '2000-07-01' AND checkout_date < DATE '2001-07-01' GROUP BY ALL)
SELECT month, strftime(month, '%b %Y') AS label, count(*) FILTER (o = 1) AS mau, sum(gmv) AS total_value, sum(gmv) FILTER (o = 1) AS value_logged_in,
  100.0::DOUBLE * sum(gmv) FILTER (o = 1) / nullif(sum(gmv), 0) AS value_weighted_pct FROM l FULL JOIN v USING (month, supplier_id) GROUP BY 1""")
def monthly_reach(spark, root):
    lo, hi = date(2000, 7, 1), date(2001, 6, 30)
    return en.monthly_reach(mp.supplier_days(spark, root, [(lo, hi)]), mp.bookings(spark, root, [(lo, hi)], place=False), lo, date(2001, 7, 1))


EDGES, TIER_LABELS = [150000.0, 200000.0, 250000.0], ["low", "middle", "upper", "high"]


@query("login_frequency", "C65 P15", doubles="pct_10_plus:5",
       sql=REL + f""", v AS (SELECT supplier_id, sum(nr) AS nr FROM booking WHERE checkout_date BETWEEN {A} - 365 AND {A} AND status_id IN (1, 2) GROUP BY 1),
m AS (SELECT supplier_id, avg(l) AS a FROM (SELECT supplier_id, date_trunc('month', day) AS mo, sum(logins) AS l FROM logins
   WHERE is_active AND day >= DATE '2001-04-01' AND day < DATE '2001-07-01' GROUP BY ALL) GROUP BY 1),
b AS (SELECT CASE WHEN nr IS NULL OR nr = 0 THEN 'none' WHEN nr < 150000 THEN 'low' WHEN nr < 200000 THEN 'middle' WHEN nr < 250000 THEN 'upper' ELSE 'high' END AS tier, coalesce(a, 0) AS a
  FROM rel LEFT JOIN v USING (supplier_id) LEFT JOIN m USING (supplier_id))
SELECT tier, count(*) AS suppliers, count(*) FILTER (a = 0) AS no_login, count(*) FILTER (a > 0 AND a < 3) AS logins_1_2, count(*) FILTER (a >= 3 AND a < 6) AS logins_3_5,
  count(*) FILTER (a >= 6 AND a < 11) AS logins_6_10, count(*) FILTER (a >= 11) AS logins_10_plus, 100.0::DOUBLE * count(*) FILTER (a >= 11) / count(*) AS pct_10_plus FROM b GROUP BY 1""")
def login_frequency(spark, root):
    e = relevant(spark, root).select("supplier_id").join(yearly_value(spark, root), "supplier_id", "left")
    e = e.withColumn("tier", edge_bucket(F.col("nr"), EDGES, TIER_LABELS, zero="none"))
    lo, hi = date(2001, 4, 1), date(2001, 7, 1)
    return en.frequency_distribution(e, mp.supplier_days(spark, root, [(lo, date(2001, 6, 30))]), "tier", lo, hi)


def actions(spark, root, start=LAUNCH):
    return en.surfaced(mp.supplier_actions(spark, root, [(start, AS_OF)]), start, AS_OF)


# what happened after the day is not known on it
THEN = f"""* REPLACE (CASE WHEN status = 'resolved' AND resolved_at > {A} THEN 'active' ELSE status END AS status,
  CASE WHEN resolved_at <= {A} THEN resolved_at END AS resolved_at)"""
ACT = f"a AS (SELECT {THEN} FROM act WHERE surfaced_at BETWEEN DATE '1999-01-01' AND {A})"
ACTS = sb.with_(sb.ACTION) + "," + ACT
REACHED = REL + "," + sb.ACTION.replace(sb.LINES + ",", "") + "," + ACT + ", sn AS (SELECT DISTINCT supplier_id FROM a), rs AS (SELECT rel.supplier_id, is_managed, sn.supplier_id IS NOT NULL AS r FROM rel JOIN sup USING (supplier_id) LEFT JOIN sn USING (supplier_id))"


@query("reach_overall", "C66 J12", doubles="reach_pct:5", sql=REACHED + " SELECT count(*) AS relevant, count(*) FILTER (r) AS reached, 100.0::DOUBLE * count(*) FILTER (r) / count(*) AS reach_pct FROM rs")
def reach_overall(spark, root):
    return en.reach_rate(relevant(spark, root), actions(spark, root))


@query("reach_by_managed", "C66", doubles="reach_pct:5", sql=REACHED + " SELECT is_managed, count(*) AS relevant, count(*) FILTER (r) AS reached, 100.0::DOUBLE * count(*) FILTER (r) / count(*) AS reach_pct FROM rs GROUP BY 1")
def reach_by_managed(spark, root):
    e = relevant(spark, root).join(mp.suppliers(spark, root).select("supplier_id", "is_managed"), "supplier_id")
    return en.reach_rate(e, actions(spark, root), "is_managed")


@query("reach_by_action_type", "C66", doubles="avg_actions:5",
       sql=ACTS + " SELECT action_type, count(DISTINCT supplier_id) AS suppliers_reached, count(*) AS actions_surfaced, count(*) / count(DISTINCT supplier_id) AS avg_actions FROM a GROUP BY 1")
def reach_by_action_type(spark, root):
    return en.reach_by_type(actions(spark, root))


@query("action_status_shares", "C67 A19 W6", doubles="share_pct:5",
       sql=ACTS + """ SELECT CASE status WHEN 'resolved' THEN 'Resolved' WHEN 'expired' THEN 'Expired' WHEN 'dismissed' THEN 'Dismissed' ELSE 'Active / In progress' END AS status_label,
  count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct FROM a GROUP BY 1""")
def action_status_shares(spark, root):
    return en.status_shares(actions(spark, root))


FUN = """count(*) AS surfaced, count(DISTINCT supplier_id) AS suppliers, count(*) FILTER (status = 'resolved') AS resolved,
  100.0::DOUBLE * count(*) FILTER (status = 'resolved') / count(*) AS resolution_pct,
  100.0::DOUBLE * count(*) FILTER (status = 'resolved' AND resolved_at - surfaced_at <= 28) / count(*) AS resolution_in_time_pct,
  100.0::DOUBLE * count(*) FILTER (status = 'dismissed') / nullif(count(*) FILTER (status IN ('resolved', 'dismissed')), 0) AS dismissal_pct,
  100.0::DOUBLE * count(*) FILTER (status = 'expired') / nullif(count(*) FILTER (status IN ('resolved', 'dismissed', 'expired')), 0) AS expiry_pct,
  avg(resolved_at - surfaced_at) FILTER (status = 'resolved') AS avg_days_to_resolve"""
FUN_D = "resolution_pct:5 resolution_in_time_pct:5 dismissal_pct:5 expiry_pct:5 avg_days_to_resolve:5"


@query("action_funnel", "C67", doubles=FUN_D, sql=ACTS + f" SELECT {FUN} FROM a")
def action_funnel(spark, root):
    return en.status_funnel(actions(spark, root), [])


@query("action_funnel_by_type", "C67", doubles=FUN_D, sql=ACTS + f" SELECT action_type, {FUN} FROM a GROUP BY 1")
def action_funnel_by_type(spark, root):
    return en.status_funnel(actions(spark, root), ["action_type"])


@query("action_funnel_by_month", "C67 F1", doubles=FUN_D, sql=ACTS + f" SELECT CAST(date_trunc('month', surfaced_at) AS DATE) AS month, {FUN} FROM a GROUP BY 1")
def action_funnel_by_month(spark, root):
    return en.status_funnel(en.by_month(actions(spark, root)), ["month"])


@query("dismissal_reasons", "C67 O2 A24", sql=ACTS + """ SELECT action_type, coalesce(dismissal_reason, 'None selected') AS reason, count(*) AS n FROM a WHERE status = 'dismissed'
  GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def dismissal_reasons(spark, root):
    return en.dismissal_reasons(actions(spark, root))


CONV = "p AS (SELECT supplier_id, bool_or(status = 'resolved') AS r FROM a GROUP BY 1)"
CONV_COLS = "count(*) AS reached, count(*) FILTER (r) AS converted, 100.0::DOUBLE * count(*) FILTER (r) / count(*) AS conversion_pct, count(*) FILTER (NOT r) AS never_resolved"


@query("action_conversion", "C68", doubles="conversion_pct:5", sql=ACTS + f", {CONV} SELECT {CONV_COLS} FROM p")
def action_conversion(spark, root):
    return en.entity_conversion(actions(spark, root))


@query("action_conversion_by_managed", "C68", doubles="conversion_pct:5", sql=sb.with_(sb.SUPPLIERS, sb.ACTION) + f",{ACT}, {CONV} SELECT is_managed, {CONV_COLS} FROM p JOIN sup USING (supplier_id) GROUP BY 1")
def action_conversion_by_managed(spark, root):
    return en.entity_conversion(actions(spark, root), mp.suppliers(spark, root), "is_managed")


TIER = "CASE WHEN n <= 1 THEN 'Single-Use' WHEN n = 2 THEN 'Occasional' WHEN n <= 9 THEN 'Regular' ELSE 'Power User' END"
START2 = date(2001, 4, 1)
ACT2 = sb.with_(sb.ACTION) + f", a AS (SELECT {THEN} FROM act WHERE surfaced_at BETWEEN DATE '2001-04-01' AND {A})"


@query("engagement_tiers", "C69", doubles="share_pct:5",
       sql=ACT2 + f", c AS (SELECT supplier_id, count(*) AS n FROM a WHERE status = 'resolved' GROUP BY 1) SELECT {TIER} AS tier, count(*) AS suppliers, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct FROM c GROUP BY 1")
def engagement_tiers(spark, root):
    return en.engagement_tiers(actions(spark, root, START2))


@query("time_to_resolution", "C70 W7", doubles="share_pct:5 cumulative_pct:5",
       sql=ACTS + """, r AS (SELECT resolved_at - surfaced_at AS d FROM a WHERE status = 'resolved' AND resolved_at IS NOT NULL),
b AS (SELECT CASE WHEN d <= 0 THEN 1 WHEN d <= 3 THEN 2 WHEN d <= 7 THEN 3 WHEN d <= 14 THEN 4 WHEN d <= 30 THEN 5 WHEN d <= 60 THEN 6 ELSE 7 END AS sort_order,
  CASE WHEN d <= 0 THEN 'Same day' WHEN d <= 3 THEN 'Days 1-3' WHEN d <= 7 THEN 'Days 4-7' WHEN d <= 14 THEN 'Days 8-14' WHEN d <= 30 THEN 'Days 15-30' WHEN d <= 60 THEN 'Days 31-60' ELSE '60+ days' END AS time_window FROM r),
g AS (SELECT sort_order, time_window, count(*) AS n FROM b GROUP BY 1, 2)
SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS share_pct, 100.0::DOUBLE * sum(n) OVER (ORDER BY sort_order ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumulative_pct FROM g""")
def time_to_resolution(spark, root):
    return en.time_to_event(actions(spark, root))


@query("cohort_migration", "C71", doubles="share_pct:5",
       sql=sb.with_(sb.ACTION) + f""", a AS (SELECT {THEN} FROM act WHERE surfaced_at BETWEEN DATE '2000-12-01' AND {A}),
p AS (SELECT supplier_id, count(*) FILTER (surfaced_at < DATE '2000-12-15') AS ia, count(*) FILTER (surfaced_at < DATE '2001-03-01') AS n FROM a WHERE status = 'resolved' GROUP BY 1)
SELECT {TIER} AS tier, count(*) AS suppliers, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct FROM p WHERE ia = 1 GROUP BY 1""")
def cohort_migration(spark, root):
    return en.cohort_migration(actions(spark, root, date(2000, 12, 1)), date(2000, 12, 1), date(2000, 12, 15), date(2001, 3, 1))


STEPS = ["view", "click", "signup", "purchase"]


@query("event_funnel_steps", "C74", doubles=" ".join(f"{a}_to_{b}_pct:5 {b}_abandonment_pct:5" for a, b in zip(STEPS, STEPS[1:])) + " overall_pct:5",
       sql=sb.with_(sb.EVENTS) + ", n AS (SELECT day, " + ", ".join(f"count(DISTINCT visitor_id) FILTER (event_type = '{s}') AS n_{s}" for s in STEPS) +
       " FROM ev WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1) SELECT *, " + ", ".join(
           f"100.0::DOUBLE * n_{b} / nullif(n_{a}, 0) AS {a}_to_{b}_pct, 100.0::DOUBLE - 100.0::DOUBLE * n_{b} / nullif(n_{a}, 0) AS {b}_abandonment_pct" for a, b in zip(STEPS, STEPS[1:])) +
       ", 100.0::DOUBLE * n_purchase / nullif(n_view, 0) AS overall_pct FROM n")
def event_funnel_steps(spark, root):
    return en.funnel_steps(mp.events(spark, root), STEPS, "day")
