"""Cohort panel queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.operators import panel
from souklens.plans import sqlbase as sb
from souklens.plans.registry import query
from souklens.plans.stages import stage
from souklens.sources import marketplace as mp

ST = panel.Study(date(1999, 6, 7), as_of=date(2001, 8, 1))
TRAFFIC_ST = panel.Study(date(2024, 1, 22), as_of=date(2024, 1, 31), weeks_before=1, weeks_after=1, shift_days=14)


def pool(spark, root):
    return mp.suppliers(spark, root)


def inputs(spark, root, st=ST):
    r = [(st.start, st.ranges()[1][1])]
    return pool(spark, root), mp.online_history(spark, root, r), mp.availability(spark, root, r)


def acts(spark, root, st=ST):
    """The cohort is fixed once per study date and then read by every panel."""
    @stage(f"cohort-{st.event}")
    def build(spark, root):
        p, o, _ = inputs(spark, root, st)
        return panel.cohort_activities(p, o, st)

    return build(spark, root)


S, E, EV = f"DATE '{ST.start}'", f"DATE '{ST.end}'", f"DATE '{ST.event}'"
PER = f"CASE WHEN week_start < {EV} THEN 'pre' ELSE 'post' END AS period"

COHORT = sb.with_(sb.BOOKING, sb.PRICE.replace(sb.SUPPLIERS + "," + sb.LINES + ",", ""), sb.ONLINE, sb.AVAIL, sb.FX) + f""",
acts AS (SELECT DISTINCT supplier_id, activity_id FROM online WHERE day >= {S} AND day < {EV}),
sizes AS (SELECT sup.supplier_id, sup.country_name, count(activity_id) AS n_activities FROM sup LEFT JOIN acts USING (supplier_id) GROUP BY ALL),
weeks AS (SELECT CAST(unnest(generate_series({S}, {E} - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS DATE) AS week_start),
onw AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, supplier_id, count(DISTINCT activity_id) AS online
        FROM online WHERE is_online AND day >= {S} AND day < {E} AND activity_id IN (SELECT activity_id FROM acts) GROUP BY ALL),
avd AS (SELECT day AS week_start, supplier_id, activity_id, count(DISTINCT travel_date) FILTER (vacancies > 0) AS d
        FROM avail WHERE day >= {S} AND day < {E} AND travel_date >= day AND travel_date < day + 90
          AND activity_id IN (SELECT activity_id FROM acts) GROUP BY ALL),
avs AS (SELECT week_start, supplier_id, sum(d) / nullif(count(*) FILTER (d > 0) * 90, 0) AS coverage FROM avd GROUP BY ALL),
sw AS (SELECT week_start, s.supplier_id, s.country_name, n_activities, coalesce(online, 0) AS online,
         CASE WHEN coalesce(online, 0) > 0 THEN 1 ELSE 0 END AS is_active, coalesce(online, 0) / nullif(n_activities, 0) AS pct_online, coverage
       FROM sizes s CROSS JOIN weeks LEFT JOIN onw USING (week_start, supplier_id) LEFT JOIN avs USING (week_start, supplier_id)),
supply AS (SELECT week_start, country_name, count(*) AS cohort_suppliers, CAST(sum(n_activities) AS BIGINT) AS cohort_activities,
             CAST(sum(is_active) AS BIGINT) AS active_suppliers, CAST(sum(online) AS BIGINT) AS active_activities,
             sum(is_active) / count(*) AS pct_active_suppliers, avg(pct_online) AS pct_online_per_supplier,
             avg(coverage) AS pct_days_with_slots, {PER} FROM sw GROUP BY ALL),
ptw AS (SELECT snapshot_date AS week_start, country_name, supplier_id, activity_id, currency, avg(price_black) AS black, avg(price_red) AS red
        FROM price WHERE snapshot_date >= {S} AND snapshot_date < {E} AND travel_date >= snapshot_date
          AND travel_date < snapshot_date + 90 AND price_black > 0 AND activity_id IN (SELECT activity_id FROM acts) GROUP BY ALL),
base AS (SELECT activity_id, currency, avg(black) AS bb, avg(red) AS br FROM ptw WHERE week_start < {EV} GROUP BY ALL),
tidx AS (SELECT ptw.*, least(greatest(black / bb, 0.5), 2.0) AS ib, least(greatest(red / br, 0.5), 2.0) AS ir
         FROM ptw JOIN base USING (activity_id, currency)),
sidx AS (SELECT week_start, country_name, supplier_id, avg(ib) AS b, avg(ir) AS r FROM tidx GROUP BY ALL),
eur AS (SELECT week_start, country_name, avg(black / CASE WHEN ptw.currency = 'EUR' THEN 1.0::DOUBLE ELSE rate END) AS avg_price_black_eur,
          avg(red / CASE WHEN ptw.currency = 'EUR' THEN 1.0::DOUBLE ELSE rate END) AS avg_price_effective_eur
        FROM ptw LEFT JOIN fx ON fx.currency = ptw.currency AND fx.rate_date = week_start
        WHERE ptw.currency = 'EUR' OR rate > 0 GROUP BY ALL),
pidx AS (SELECT week_start, country_name, count(*) AS suppliers_with_price, avg(b) AS price_index_black, avg(r) AS price_index_effective
         FROM sidx GROUP BY ALL),
pricep AS (SELECT *, {PER} FROM pidx LEFT JOIN eur USING (week_start, country_name)),
cb AS (SELECT * FROM booking WHERE status_id IN (1, 2) AND line_id IN (SELECT activity_id FROM acts)
         AND ((checkout_date >= {S} AND checkout_date < {E}) OR (checkout_date >= {S} - 364 AND checkout_date < {E} - 364))),
caps AS (SELECT country_name, quantile_disc(gmv, 0.99) AS gc, quantile_disc(nr, 0.99) AS nc FROM cb GROUP BY ALL),
swk AS (SELECT CAST(date_trunc('week', checkout_date) AS DATE) AS week_start, country_name, supplier_id,
          count(DISTINCT booking_id) AS bookings, sum(tickets) AS tickets, sum(least(gmv, gc)) AS gmv, sum(least(nr, nc)) AS nr,
          sum(gmv) FILTER (gmv > 0) AS gmv_raw, sum(nr) FILTER (gmv > 0) AS nr_raw FROM cb JOIN caps USING (country_name) GROUP BY ALL),
cwk AS (SELECT week_start, country_name, sum(bookings) AS bookings, sum(tickets) AS tickets, sum(gmv) AS gmv, sum(nr) AS nr,
          sum(gmv_raw) AS gmv_raw, sum(nr_raw) AS nr_raw, avg(nr_raw / nullif(gmv_raw, 0)) AS cps FROM swk GROUP BY ALL),
csz AS (SELECT country_name, count(*) AS cohort_suppliers FROM sizes GROUP BY ALL),
realised AS (SELECT c.week_start, c.country_name, CASE WHEN c.week_start < {EV} THEN 'pre' ELSE 'post' END AS period, cohort_suppliers,
    c.bookings / cohort_suppliers AS bookings_per_supplier, c.tickets / cohort_suppliers AS tickets_per_supplier,
    c.gmv / cohort_suppliers AS gmv_per_supplier, c.nr / cohort_suppliers AS nr_per_supplier,
    c.cps AS commission_rate_per_supplier, c.cps / nullif(l.cps, 0) AS commission_rate_per_supplier_yoy,
    c.nr_raw / nullif(c.gmv_raw, 0) AS commission_rate_pooled, c.bookings / nullif(l.bookings, 0) AS bookings_yoy,
    c.tickets / nullif(l.tickets, 0) AS tickets_yoy, c.gmv / nullif(l.gmv, 0) AS gmv_yoy, c.nr / nullif(l.nr, 0) AS nr_yoy
  FROM cwk c JOIN csz USING (country_name) LEFT JOIN cwk l ON l.country_name = c.country_name AND l.week_start = c.week_start - 364
  WHERE c.week_start >= {S})"""

SUPPLY_D = "pct_active_suppliers pct_online_per_supplier pct_days_with_slots"
PRICE_D = "price_index_black price_index_effective avg_price_black_eur:4 avg_price_effective_eur:4"
REAL_D = ("bookings_per_supplier tickets_per_supplier:5 gmv_per_supplier:4 nr_per_supplier:4 commission_rate_per_supplier "
          "commission_rate_per_supplier_yoy commission_rate_pooled bookings_yoy tickets_yoy gmv_yoy nr_yoy")


@query("cohort_supply_panel", "C20 F2 J17", doubles=SUPPLY_D, sql=COHORT + " SELECT * FROM supply")
def cohort_supply_panel(spark, root):
    return supply(spark, root, acts(spark, root))


def supply(spark, root, a):
    p, o, av = inputs(spark, root)
    return panel.cohort_supply_panel(panel.supplier_weeks(p, a, o, av, ST), ST)


@query("forward_availability", "C19 J6", doubles="coverage", sql=COHORT + " SELECT * FROM avs")
def forward_availability(spark, root):
    _, _, av = inputs(spark, root)
    return panel.forward_availability(av, acts(spark, root), ST)


@query("relative_price_index", "C18 J15 A15", doubles=PRICE_D, sql=COHORT + " SELECT * FROM pricep")
def relative_price_index(spark, root):
    return price_panel(spark, root, acts(spark, root))


def price_panel(spark, root, a):
    p = mp.prices(spark, root, [(ST.start, ST.ranges()[1][1])])
    return panel.relative_price_index(p, a, mp.fx_rates(spark, root, ST.ranges()), ST)


@query("realised_yoy_panel", "C21 A23 J7 A15", doubles=REAL_D, sql=COHORT + " SELECT * FROM realised")
def realised_yoy_panel(spark, root):
    return realised(spark, root, acts(spark, root))


def realised(spark, root, a):
    weekly = panel.realised_weekly(mp.bookings(spark, root, ST.ranges()), a, ST)
    return panel.realised_yoy_panel(weekly, panel.cohort_sizes(pool(spark, root), a), ST)


@query("traffic_yoy_panel", "C22", doubles="visitors_per_supplier visitors_yoy add_to_cart_rate add_to_cart_rate_yoy "
       "conversion_rate conversion_rate_yoy unavailability_rate unavailability_rate_yoy",
       sql=sb.with_(sb.SUPPLIERS, sb.TRAFFIC) + """,
n AS (SELECT country_name, count(*) AS cohort_suppliers FROM sup GROUP BY ALL),
w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, country_name, sum(visitors) AS v, sum(add_to_cart_visitors) AS a,
        sum(customers) AS c, sum(unavailability_visitors) AS u FROM traffic
      WHERE (day >= DATE '2024-01-15' AND day < DATE '2024-01-29') OR (day >= DATE '2024-01-01' AND day < DATE '2024-01-15') GROUP BY ALL)
SELECT y.week_start, y.country_name, CASE WHEN y.week_start < DATE '2024-01-22' THEN 'pre' ELSE 'post' END AS period,
  CAST(y.v AS BIGINT) AS visitors, y.v / cohort_suppliers AS visitors_per_supplier, y.v / nullif(l.v, 0) AS visitors_yoy,
  y.a / nullif(y.v, 0) AS add_to_cart_rate, (y.a / nullif(y.v, 0)) / nullif(l.a / nullif(l.v, 0), 0) AS add_to_cart_rate_yoy,
  y.c / nullif(y.v, 0) AS conversion_rate, (y.c / nullif(y.v, 0)) / nullif(l.c / nullif(l.v, 0), 0) AS conversion_rate_yoy,
  y.u / nullif(y.v, 0) AS unavailability_rate, (y.u / nullif(y.v, 0)) / nullif(l.u / nullif(l.v, 0), 0) AS unavailability_rate_yoy
FROM w y JOIN n USING (country_name) LEFT JOIN w l ON l.country_name = y.country_name AND l.week_start = y.week_start - 14
WHERE y.week_start >= DATE '2024-01-15'""")
def traffic_yoy_panel(spark, root):
    return panel.traffic_yoy_panel(mp.traffic(spark, root), pool(spark, root), TRAFFIC_ST)


# Events cover one month, orders years. For the panels the month is stretched over both years of a study: an event's
# place in the month is its place in the weeks before and after, last year's first.
EVENTS_FROM, EVENTS_DAYS = date(2024, 1, 1), 30


def _days(st):
    return (st.ly_end - st.ly_start).days, (min(st.end, st.as_of) - st.start).days


def study_day(st):
    last, this = _days(st)
    k = f"(timestampdiff(SECOND, TIMESTAMP_NTZ'{EVENTS_FROM} 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) * {last + this} div {EVENTS_DAYS * 86400})"
    return F.expr(f"date_add(DATE'{st.ly_start}', CAST({k} + CASE WHEN {k} < {last} THEN 0 ELSE {(st.start - st.ly_start).days - last} END AS INT))")


def _study_day_sql(st):
    last, this = _days(st)
    k = f"(date_diff('second', TIMESTAMP '{EVENTS_FROM}', CAST(ts AS TIMESTAMP)) * {last + this} // {EVENTS_DAYS * 86400})"
    return f"CAST(DATE '{st.ly_start}' + CAST({k} + CASE WHEN {k} < {last} THEN 0 ELSE {(st.start - st.ly_start).days - last} END AS INTEGER) AS DATE) AS day"


_RATES = (("a", "add_to_cart_rate"), ("c", "conversion_rate"), ("u", "unavailability_rate"))
PANELS = COHORT + "," + sb.TRAFFIC.replace("CAST(ts AS DATE) AS day", _study_day_sql(ST)) + f""",
tw AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, country_name, sum(visitors) AS v, sum(add_to_cart_visitors) AS a,
         sum(customers) AS c, sum(unavailability_visitors) AS u FROM traffic GROUP BY ALL),
trafficp AS (SELECT y.week_start, y.country_name, CAST(y.v AS BIGINT) AS visitors, y.v / cohort_suppliers AS visitors_per_supplier, y.v / nullif(l.v, 0) AS visitors_yoy,
    """ + ", ".join(f"y.{x} / nullif(y.v, 0) AS {n}, (y.{x} / nullif(y.v, 0)) / nullif(l.{x} / nullif(l.v, 0), 0) AS {n}_yoy" for x, n in _RATES) + f"""
  FROM tw y JOIN csz USING (country_name) LEFT JOIN tw l ON l.country_name = y.country_name AND l.week_start = y.week_start - 364
  WHERE y.week_start >= {S}),
merged AS (SELECT * FROM supply LEFT JOIN pricep USING (week_start, country_name, period)
  LEFT JOIN realised USING (week_start, country_name, period, cohort_suppliers) LEFT JOIN trafficp USING (week_start, country_name))"""
TRAFFIC_D = ("visitors_per_supplier visitors_yoy add_to_cart_rate add_to_cart_rate_yoy conversion_rate conversion_rate_yoy "
             "unavailability_rate unavailability_rate_yoy")


def four_panels(spark, root, st=ST):
    """Supply, price, realised and traffic panels of one cohort."""
    p, o, av = inputs(spark, root, st)
    a = acts(spark, root, st)
    sizes = panel.cohort_sizes(p, a)
    prices = mp.prices(spark, root, [(st.start, st.ranges()[1][1])])
    weekly = panel.realised_weekly(mp.bookings(spark, root, st.ranges()), a, st)
    return (panel.cohort_supply_panel(panel.supplier_weeks(p, a, o, av, st), st),
            panel.relative_price_index(prices, a, mp.fx_rates(spark, root, st.ranges()), st),
            panel.realised_yoy_panel(weekly, sizes, st),
            panel.traffic_yoy_panel(mp.traffic(spark, root, study_day(st)), sizes, st))


def merged_panel(spark, root, st=ST):
    @stage(f"merged-{st.event}")
    def build(spark, root):
        return panel.merge_panels(*four_panels(spark, root, st))

    return build(spark, root)


@query("merged_panel", "J18", doubles=f"{SUPPLY_D} {PRICE_D} {REAL_D} {TRAFFIC_D}", sql=PANELS + " SELECT * FROM merged")
def merged_panel_query(spark, root):
    return merged_panel(spark, root)


ENTITY_D = ("active_share_pre active_share_post pct_online_pre pct_online_post coverage_pre coverage_post price_idx_post "
            "gmv_pre:2 gmv_post:2 nr_pre:4 nr_post:4")
ENTITY = COHORT + f""",
e1 AS (SELECT supplier_id, country_name, n_activities, """ + ", ".join(
    f"avg({c}) FILTER (week_start {op} {EV}) AS {n}_{s}" for c, n in
    (("is_active", "active_share"), ("pct_online", "pct_online"), ("coverage", "coverage")) for s, op in (("pre", "<"), ("post", ">="))) + f"""
  FROM sw GROUP BY ALL),
e2 AS (SELECT supplier_id, avg(ib) FILTER (week_start >= {EV}) AS price_idx_post FROM tidx GROUP BY ALL),
e3 AS (SELECT supplier_id, """ + ", ".join(
    f"{c} FILTER (checkout_date {op} {EV}) AS {n}_{s}" for c, n in (("count(*)", "bookings"), ("sum(gmv)", "gmv"), ("sum(nr)", "nr"))
    for s, op in (("pre", "<"), ("post", ">="))) + f""" FROM cb WHERE checkout_date >= {S} GROUP BY ALL),
ent AS (SELECT e1.*, price_idx_post, """ + ", ".join(
    f"coalesce({n}_{s}, 0) AS {n}_{s}" for n in ("bookings", "gmv", "nr") for s in ("pre", "post")) + """
  FROM e1 LEFT JOIN e2 USING (supplier_id) LEFT JOIN e3 USING (supplier_id))"""


@stage("entities")
def entity_frame(spark, root):
    p, o, av = inputs(spark, root)
    r = [(ST.start, ST.ranges()[1][1])]
    return panel.entity_pre_post(p, acts(spark, root), o, av, mp.prices(spark, root, r), mp.bookings(spark, root, r), ST)


@query("entity_pre_post", "C28", doubles=ENTITY_D, sql=ENTITY + " SELECT * FROM ent")
def entity_pre_post(spark, root):
    return entity_frame(spark, root)
