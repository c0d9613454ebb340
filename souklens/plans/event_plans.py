"""Event study, cancellation, traffic, supply and price queries with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.functions.periods import (EventWindows, explode_windows, label_first_window, three_phase_windows,
                                        two_event_windows)
from souklens.functions.ratios import ratio
from souklens.functions.intervals import interval_join
from souklens.operators import event_study as es
from souklens.plans import sqlbase as sb
from souklens.plans.registry import query
from souklens.sources import marketplace as mp
from souklens.sources.tables import read_table

EVENT = date(1999, 6, 7)
W = EventWindows.around(EVENT, 8, 8)
PW = EventWindows.around(EVENT, 26, 26, "364d")
TRAFFIC_W = EventWindows(date(2024, 1, 1), date(2024, 1, 7), date(2024, 1, 8), date(2024, 1, 14),
                         date(2024, 1, 15), date(2024, 1, 21), date(2024, 1, 22), date(2024, 1, 28))
ANNOUNCE, ROLLOUT = date(1999, 4, 5), date(1999, 6, 7)


def d(x: date) -> str:
    return f"DATE '{x.isoformat()}'"


def label_sql(src: str, day: str, w: EventWindows, extra: str = "") -> str:
    """Period, phase, combined label, event date and week offset for a source table."""
    return f"""
lab0 AS (SELECT *, CASE WHEN {day} BETWEEN {d(w.ly_pre_start)} AND {d(w.ly_post_end)} THEN 'LY'
                        WHEN {day} BETWEEN {d(w.cy_pre_start)} AND {d(w.cy_post_end)} THEN 'CY' END AS period,
           CASE WHEN {day} BETWEEN {d(w.ly_pre_start)} AND {d(w.ly_pre_end)}
                  OR {day} BETWEEN {d(w.cy_pre_start)} AND {d(w.cy_pre_end)} THEN 'Pre'
                WHEN {day} BETWEEN {d(w.ly_event)} AND {d(w.ly_post_end)}
                  OR {day} BETWEEN {d(w.cy_event)} AND {d(w.cy_post_end)} THEN 'Post' END AS phase
         FROM {src} {extra}),
lab AS (SELECT *, upper(phase) || '_' || period AS period_window,
           CASE period WHEN 'LY' THEN {d(w.ly_event)} ELSE {d(w.cy_event)} END AS event_start,
           CAST(date_trunc('week', {day}) AS DATE) AS week_start,
           CAST(date_diff('day', date_trunc('week', CASE period WHEN 'LY' THEN {d(w.ly_event)} ELSE {d(w.cy_event)} END),
                          date_trunc('week', {day})) // 7 AS INTEGER) AS week_index
        FROM lab0 WHERE period IS NOT NULL AND phase IS NOT NULL)"""


BOOK_METRICS = """count(DISTINCT booking_id) AS bookings, count(DISTINCT activity_id) AS total_activities,
  count(DISTINCT supplier_id) AS total_suppliers, sum(tickets) AS tickets, sum(nr) AS nr, sum(gmv) AS gmv,
  sum(supplier_share) AS supplier_share_revenue, sum(gmv) / nullif(sum(tickets), 0) AS avg_gmv_per_ticket,
  sum(nr) / nullif(sum(tickets), 0) AS avg_nr_per_ticket,
  sum(gmv) / nullif(count(DISTINCT booking_id), 0) AS avg_gmv_per_booking,
  sum(nr) / nullif(count(DISTINCT booking_id), 0) AS avg_nr_per_booking"""
BOOK_DOUBLES = ("tickets:2 nr:4 gmv:2 supplier_share_revenue:4 avg_gmv_per_ticket:5 avg_nr_per_ticket:5 "
                "avg_gmv_per_booking:4 avg_nr_per_booking:4")
ACTIVE = "WHERE status_id = 1"


def active_bookings(spark, root, w=W):
    b = mp.bookings(spark, root, mp.event_ranges(w))
    return es.with_status(b, mp.status_dim(spark), ["Active"])


@query("booking_event_windows", "C1 P2 A1 A2 A5 O1 J1 J3", doubles=BOOK_DOUBLES,
       sql=sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W, ACTIVE)) +
       f"SELECT country_name, period_window, {BOOK_METRICS} FROM lab GROUP BY ALL")
def booking_event_windows(spark, root):
    return es.booking_metrics(es.by_window(active_bookings(spark, root), "checkout_date", W), es.WINDOW_KEYS)


@query("booking_weekly_event_study", "C2 P1 P6", doubles=BOOK_DOUBLES,
       sql=sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W, ACTIVE)) +
       f"SELECT country_name, period, phase, week_start, week_index, {BOOK_METRICS} FROM lab GROUP BY ALL")
def booking_weekly_event_study(spark, root):
    return es.booking_metrics(es.by_week(active_bookings(spark, root), "checkout_date", W), es.WEEK_KEYS)


@query("booking_three_phase", "P3 A9", doubles="tickets:2 nr:4 gmv:2 supplier_share_revenue:4 avg_price:4 median_price:4",
       sql=sb.with_(sb.BOOKING) + ", w AS (" + " UNION ALL ".join(
           f"SELECT '{x.period}' AS period, '{x.window}' AS win, {d(x.start)} AS s, {d(x.end)} AS e"
           for x in three_phase_windows(ANNOUNCE, ROLLOUT, 6)) + """)
       SELECT period, country_name, win AS "window", count(DISTINCT booking_id) AS bookings, sum(tickets) AS tickets,
         sum(nr) AS nr, sum(gmv) AS gmv, sum(supplier_share) AS supplier_share_revenue, avg(unit_price) AS avg_price,
         quantile_disc(unit_price, 0.5) AS median_price
       FROM booking JOIN w ON checkout_date BETWEEN s AND e WHERE status_id = 1 GROUP BY ALL""")
def booking_three_phase(spark, root):
    ws = three_phase_windows(ANNOUNCE, ROLLOUT, 6)
    b = mp.bookings(spark, root, [(x.start, x.end) for x in ws])
    b = label_first_window(es.with_status(b, mp.status_dim(spark), ["Active"]), "checkout_date", ws)
    return b.groupBy("period", "country_name", "window").agg(
        F.countDistinct("booking_id").alias("bookings"), F.sum("tickets").alias("tickets"), F.sum("nr").alias("nr"),
        F.sum("gmv").alias("gmv"), F.sum("supplier_share").alias("supplier_share_revenue"),
        F.avg("unit_price").alias("avg_price"), F.percentile_approx("unit_price", 0.5).alias("median_price"))


def cancel_sql(keys: str, months, revenue=True) -> str:
    parts = []
    for m in months:
        h = f"travel_date BETWEEN event_start AND CAST(event_start + INTERVAL {m} MONTH AS DATE)"
        c = f"{h} AND status_id = 2"
        parts.append(f"""count(DISTINCT booking_id) FILTER ({h}) AS bookings_{m}m,
          count(DISTINCT booking_id) FILTER ({c}) AS cancelled_bookings_{m}m,
          count(DISTINCT booking_id) FILTER ({c}) / nullif(count(DISTINCT booking_id) FILTER ({h}), 0) AS cancellation_rate_{m}m""")
        if revenue:
            parts.append(f"""coalesce(sum(nr) FILTER ({h}), 0) AS nr_{m}m, coalesce(sum(nr) FILTER ({c}), 0) AS cancelled_nr_{m}m,
          coalesce(sum(nr) FILTER ({c}), 0) / nullif(coalesce(sum(nr) FILTER ({h}), 0), 0) AS cancellation_rate_nr_{m}m""")
    return (sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W, "WHERE status_id IN (1, 2)")) + f"""
      SELECT {keys}, count(DISTINCT booking_id) AS total_bookings,
        count(DISTINCT booking_id) FILTER (status_id = 2) AS cancelled_bookings,
        count(DISTINCT booking_id) FILTER (status_id = 2) / nullif(count(DISTINCT booking_id), 0) AS cancellation_rate,
        sum(nr) AS total_nr, coalesce(sum(nr) FILTER (status_id = 2), 0) AS cancelled_nr,
        coalesce(sum(nr) FILTER (status_id = 2), 0) / nullif(sum(nr), 0) AS cancellation_rate_nr,
        {', '.join(parts)}, count(DISTINCT activity_id) AS total_activities, count(DISTINCT supplier_id) AS total_suppliers
      FROM lab GROUP BY ALL""")


CANCEL_D = "cancellation_rate total_nr:4 cancelled_nr:4 cancellation_rate_nr "


def all_bookings(spark, root):
    b = mp.bookings(spark, root, mp.event_ranges(W))
    return es.with_status(b, mp.status_dim(spark), ["Active", "Cancelled"])


@query("cancellation_by_window", "C3 A3 A4 P13", sql=cancel_sql("country_name, period_window", (3, 6, 12)),
       doubles=CANCEL_D + " ".join(f"cancellation_rate_{m}m nr_{m}m:4 cancelled_nr_{m}m:4 cancellation_rate_nr_{m}m"
                                   for m in (3, 6, 12)))
def cancellation_by_window(spark, root):
    return es.cancellation_rates(es.by_window(all_bookings(spark, root), "checkout_date", W), es.WINDOW_KEYS, [3, 6, 12])


@query("cancellation_weekly", "C3 P6", sql=cancel_sql("country_name, period, phase, week_start, week_index", (3, 6), False),
       doubles=CANCEL_D + "cancellation_rate_3m cancellation_rate_6m")
def cancellation_weekly(spark, root):
    return es.cancellation_rates(es.by_week(all_bookings(spark, root), "checkout_date", W), es.WEEK_KEYS, [3, 6], False)


TRAFFIC_METRICS = """CAST(sum(bookings) AS BIGINT) AS bookings, CAST(sum(clicks) AS BIGINT) AS clicks,
  CAST(sum(customers) AS BIGINT) AS customers, CAST(sum(visitors) AS BIGINT) AS visitors,
  CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(add_to_cart_visitors) AS BIGINT) AS add_to_cart_visitors,
  CAST(sum(unavailability_visitors) AS BIGINT) AS unavailability_visitors, CAST(sum(stars) AS BIGINT) AS total_stars,
  CAST(sum(reviews) AS BIGINT) AS total_reviews, count(DISTINCT activity_id) AS total_activities,
  count(DISTINCT supplier_id) AS total_suppliers, sum(customers) / nullif(sum(visitors), 0) AS conversion_rate,
  least(sum(clicks), sum(impressions)) / nullif(sum(impressions), 0) AS click_through_rate,
  least(sum(add_to_cart_visitors), sum(visitors)) / nullif(sum(visitors), 0) AS add_to_cart_rate,
  least(sum(unavailability_visitors), sum(visitors)) / nullif(sum(visitors), 0) AS unavailability_issue_rate,
  sum(stars) / nullif(sum(reviews), 0) AS avg_star_rating, sum(bookings) / nullif(sum(clicks), 0) AS bookings_per_click,
  sum(impressions) / nullif(count(DISTINCT activity_id), 0) AS avg_impressions_per_activity"""
TRAFFIC_D = ("conversion_rate click_through_rate add_to_cart_rate unavailability_issue_rate avg_star_rating "
             "bookings_per_click avg_impressions_per_activity")


@query("traffic_funnel_windows", "C4 A6", doubles=TRAFFIC_D,
       sql=sb.with_(sb.TRAFFIC, label_sql("traffic", "day", TRAFFIC_W)) +
       f"SELECT country_name, period_window, {TRAFFIC_METRICS} FROM lab GROUP BY ALL")
def traffic_funnel_windows(spark, root):
    return es.traffic_funnel(es.by_window(mp.traffic(spark, root), "day", TRAFFIC_W), es.WINDOW_KEYS)


@query("traffic_funnel_weekly", "C4 P6", doubles=TRAFFIC_D,
       sql=sb.with_(sb.TRAFFIC, label_sql("traffic", "day", TRAFFIC_W)) +
       f"SELECT country_name, period, phase, week_start, week_index, {TRAFFIC_METRICS} FROM lab GROUP BY ALL")
def traffic_funnel_weekly(spark, root):
    return es.traffic_funnel(es.by_week(mp.traffic(spark, root), "day", TRAFFIC_W), es.WEEK_KEYS)


# overlapping windows inside the month of event data: announcement 15 January, rollout 22 January
SESSION_WINDOWS = [w for w in two_event_windows(date(2024, 1, 15), date(2024, 1, 22), 2, 1, "364d") if w.period == "CY"]


def windows_sql(ws) -> str:
    return "w AS (" + " UNION ALL ".join(
        f"SELECT '{x.period}' AS period, '{x.window}' AS win, {d(x.start)} AS s, {d(x.end)} AS e, {d(x.anchor)} AS anchor"
        for x in ws) + ")"


@query("session_funnel", "C5 P5 F7", doubles="check_availability_rate add_to_cart_rate conversion_rate",
       sql=sb.with_(sb.SESSION, windows_sql(SESSION_WINDOWS)) + """
       SELECT period, country_name, win AS "window", count(DISTINCT visitor_id) AS total_visitors,
         count(DISTINCT visitor_id) FILTER (detail_views > 0) AS detail_view_visitors,
         count(DISTINCT visitor_id) FILTER (n_checked > 0) / nullif(count(DISTINCT visitor_id) FILTER (detail_views > 0), 0) AS check_availability_rate,
         count(DISTINCT visitor_id) FILTER (n_cart > 0) / nullif(count(DISTINCT visitor_id) FILTER (detail_views > 0), 0) AS add_to_cart_rate,
         count(DISTINCT visitor_id) FILTER (purchased) AS customers,
         count(DISTINCT visitor_id) FILTER (purchased) / nullif(count(DISTINCT visitor_id), 0) AS conversion_rate
       FROM sess JOIN w ON day BETWEEN s AND e GROUP BY ALL""")
def session_funnel(spark, root):
    s = explode_windows(mp.sessions(spark, root), "day", SESSION_WINDOWS)
    return es.session_funnel(s, ["period", "country_name", "window"])


def supply_sql(src: str, keys: str) -> str:
    wk = keys if "week_start" in keys else keys + ", week_start"
    side = lambda col, name: f"""(SELECT {keys}, count(*) AS total_{name}s, count(*) FILTER (sd > 0) AS active_{name}s,
        count(*) FILTER (sd > 0) / nullif(count(*), 0) AS share_active_{name}s,
        sum(sd) / nullif(sum(n), 0) AS avg_days_online_per_{name}_week,
        sum(sd) / nullif(sum(onw), 0) AS avg_days_online_per_active_{name}_week
      FROM (SELECT {keys}, {col}, sum(x) AS sd, count(*) AS n, count(*) FILTER (x > 0) AS onw
            FROM (SELECT {wk}, {col}, count(DISTINCT day) FILTER (is_online) AS x FROM {src} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""
    return f"SELECT * FROM {side('activity_id', 'activity')} a JOIN {side('supplier_id', 'supplier')} b USING ({keys})"


SUPPLY_D = ("share_active_activitys avg_days_online_per_activity_week avg_days_online_per_active_activity_week "
            "share_active_suppliers avg_days_online_per_supplier_week avg_days_online_per_active_supplier_week")


@query("supply_by_window", "C6 A13 A14", doubles=SUPPLY_D,
       sql=sb.with_(sb.ONLINE, label_sql("online", "day", W)) + supply_sql("lab", "country_name, period_window"))
def supply_by_window(spark, root):
    h = es.by_window(mp.online_history(spark, root, mp.event_ranges(W)), "day", W)
    h = h.withColumn("week_start", F.to_date(F.date_trunc("week", "day")))
    return es.supply_availability(h, es.WINDOW_KEYS)


@query("supply_weekly", "C6 P6", doubles=SUPPLY_D,
       sql=sb.with_(sb.ONLINE, label_sql("online", "day", W)) +
       supply_sql("lab", "country_name, period, phase, week_start, week_index"))
def supply_weekly(spark, root):
    return es.supply_availability(es.by_week(mp.online_history(spark, root, mp.event_ranges(W)), "day", W), es.WEEK_KEYS)


SUPPLY_WINDOWS = two_event_windows(date(1999, 5, 3), ROLLOUT, 6, 6)


@query("supply_two_events", "P4 C6", doubles=SUPPLY_D,
       sql=sb.with_(sb.ONLINE) + ", lab AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week_start, CASE " +
       " ".join(f"WHEN day BETWEEN {d(x.start)} AND {d(x.end)} THEN '{x.period}'" for x in SUPPLY_WINDOWS) +
       " END AS period, CASE " +
       " ".join(f"WHEN day BETWEEN {d(x.start)} AND {d(x.end)} THEN '{x.window}'" for x in SUPPLY_WINDOWS) +
       ' END AS "window" FROM online), lab2 AS (SELECT * FROM lab WHERE "window" IS NOT NULL) ' +
       supply_sql("lab2", 'country_name, period, "window"'))
def supply_two_events(spark, root):
    h = mp.online_history(spark, root, [(x.start, x.end) for x in SUPPLY_WINDOWS])
    h = label_first_window(h, "day", SUPPLY_WINDOWS).withColumn("week_start", F.to_date(F.date_trunc("week", "day")))
    return es.supply_availability(h, ["country_name", "period", "window"])


def level_sql(keys: str) -> str:
    return sb.with_(sb.PRICE, label_sql("price", "snapshot_date", PW)) + f""",
lvl AS (SELECT {keys}, event_start, activity_id, supplier_id, travel_date, avg(price_black) AS price_black,
          avg(price_red) AS price_red, avg(slots) AS slots
        FROM lab WHERE travel_date BETWEEN event_start AND CAST(event_start + INTERVAL 12 MONTH AS DATE) GROUP BY ALL)"""


def horizon(m: int) -> str:
    return f"FILTER (travel_date BETWEEN event_start AND CAST(event_start + INTERVAL {m} MONTH AS DATE))"


LEVEL_METRICS = """count(DISTINCT supplier_id) AS total_suppliers, count(DISTINCT activity_id) AS total_activities,
  quantile_disc(price_red, 0.5) AS median_red, stddev_samp(price_red) AS stddev_red,
  quantile_disc(price_black, 0.5) AS median_black, stddev_samp(price_black) AS stddev_black, """ + ", ".join(
    f"quantile_disc({c}, 0.5) {horizon(m)} AS median_{n}_{m}m, stddev_samp({c}) {horizon(m)} AS stddev_{n}_{m}m"
    for m in (3, 6, 12) for c, n in (("price_red", "red"), ("price_black", "black"), ("slots", "slots")))
LEVEL_D = "median_red:4 stddev_red:4 median_black:4 stddev_black:4 " + " ".join(
    f"median_{n}_{m}m:4 stddev_{n}_{m}m:4" for m in (3, 6, 12) for n in ("red", "black", "slots"))


def price_base(spark, root, weekly=False):
    return es.activity_prices(mp.prices(spark, root, mp.event_ranges(PW)), PW, weekly)


@query("price_levels_by_window", "C7 A9 A12", doubles=LEVEL_D,
       sql=level_sql("country_name, period_window") +
       f"SELECT country_name, period_window, {LEVEL_METRICS} FROM lvl GROUP BY ALL")
def price_levels_by_window(spark, root):
    return es.price_levels(price_base(spark, root), es.WINDOW_KEYS)


@query("price_levels_weekly", "C7 P6", doubles=LEVEL_D,
       sql=level_sql("country_name, period, phase, week_start, week_index") +
       f"SELECT country_name, period, phase, week_start, week_index, {LEVEL_METRICS} FROM lvl GROUP BY ALL")
def price_levels_weekly(spark, root):
    return es.price_levels(price_base(spark, root, True), es.WEEK_KEYS)


PANEL_SQL = level_sql("country_name, period_window") + """,
pan AS (SELECT activity_id FROM lvl GROUP BY activity_id, supplier_id, country_name HAVING count(DISTINCT period_window) = 4)"""


@query("balanced_price_medians", "C8 J10", doubles=" ".join(f"median_{n}_{m}m:4" for m in (3, 6, 12) for n in ("price", "slots")),
       sql=PANEL_SQL + ", a AS (SELECT country_name, period_window, activity_id, " + ", ".join(
           f"avg({c}) {horizon(m)} AS {n}_{m}m" for m in (3, 6, 12) for c, n in (("price_red", "price"), ("slots", "slots"))) +
       " FROM lvl WHERE activity_id IN (SELECT activity_id FROM pan) GROUP BY ALL) SELECT country_name, period_window, " +
       ", ".join(f"quantile_disc({n}_{m}m, 0.5) AS median_{n}_{m}m" for m in (3, 6, 12) for n in ("price", "slots")) +
       " FROM a GROUP BY ALL")
def balanced_price_medians(spark, root):
    return es.balanced_panel_medians(price_base(spark, root), [3, 6, 12])


def change_sql() -> str:
    piv = ", ".join(f"avg(price_red) FILTER (period_window = '{pw}' AND travel_date BETWEEN event_start AND "
                    f"CAST(event_start + INTERVAL {m} MONTH AS DATE)) AS {pw.lower()}_{m}m"
                    for m in (3, 6, 12) for pw in es.WINDOWS)
    ly = ", ".join(f"CAST(coalesce(abs((post_ly_{m}m - pre_ly_{m}m) / nullif(pre_ly_{m}m, 0)) > 0.01, false) AS INTEGER) AS m{m}"
                   for m in (3, 6, 12))
    cy = ", ".join(f"CAST(coalesce(abs(((post_cy_{m}m - pre_cy_{m}m) - (post_ly_{m}m - pre_ly_{m}m)) / nullif(pre_cy_{m}m, 0)) > 0.01, false) AS INTEGER) AS m{m}"
                   for m in (3, 6, 12))
    agg = ", ".join(f"""count(DISTINCT supplier_id) FILTER (m{m} = 1) AS suppliers_changed_{m}m,
      CAST(sum(m{m}) AS BIGINT) AS activities_changed_{m}m,
      100.0::DOUBLE * count(DISTINCT supplier_id) FILTER (m{m} = 1) / count(DISTINCT supplier_id) AS pct_suppliers_changed_{m}m,
      100.0::DOUBLE * sum(m{m}) / count(DISTINCT activity_id) AS pct_activities_changed_{m}m""" for m in (3, 6, 12))
    return level_sql("country_name, period_window") + f""",
p AS (SELECT activity_id, supplier_id, country_name, {piv} FROM lvl GROUP BY ALL HAVING count(DISTINCT period_window) = 4),
c AS (SELECT 'LY' AS year, country_name, activity_id, supplier_id, {ly} FROM p
      UNION ALL SELECT 'CY', country_name, activity_id, supplier_id, {cy} FROM p)
SELECT year, country_name, count(DISTINCT supplier_id) AS total_suppliers, count(DISTINCT activity_id) AS total_activities, {agg}
FROM c GROUP BY ALL"""


@query("price_change_did", "C9 R1", sql=change_sql(),
       doubles=" ".join(f"pct_suppliers_changed_{m}m pct_activities_changed_{m}m" for m in (3, 6, 12)))
def price_change_did(spark, root):
    return es.price_change_did(price_base(spark, root), [3, 6, 12])


INDEX_WINDOWS = two_event_windows(ANNOUNCE, ROLLOUT, 10, 10)


@query("price_index_by_window", "C10 P5 P12 A11 U3 J5",
       doubles=" ".join(f"{c}_{h}:4" for h in ("3m", "6m", "12m") for c in ("red", "black", "slots")),
       sql=sb.with_(sb.PRICE, windows_sql(INDEX_WINDOWS)) + """,
x AS (SELECT *, CASE WHEN travel_date < anchor + INTERVAL 3 MONTH THEN '3m' WHEN travel_date < anchor + INTERVAL 6 MONTH THEN '6m'
                     ELSE '12m' END AS h
      FROM price JOIN w ON snapshot_date BETWEEN s AND e AND travel_date >= anchor AND travel_date <= anchor + INTERVAL 12 MONTH
      WHERE price_red > 0),
wk AS (SELECT period, country_name, win, currency, h, snapshot_date, quantile_disc(price_red, 0.5) AS red,
          quantile_disc(price_black, 0.5) AS black, quantile_disc(slots, 0.5) AS slots FROM x GROUP BY ALL),
lv AS (SELECT period, country_name, win, currency, h, count(*) AS weeks, quantile_disc(red, 0.5) AS red,
          quantile_disc(black, 0.5) AS black, quantile_disc(slots, 0.5) AS slots FROM wk GROUP BY ALL)
SELECT period, country_name, win AS "window", currency, """ + ", ".join(
           f"max({c}) FILTER (h = '{h}') AS {c}_{h}" for h in ("3m", "6m", "12m") for c in ("weeks", "red", "black", "slots")) +
       " FROM lv GROUP BY ALL")
def price_index_by_window(spark, root):
    p = mp.prices(spark, root, [(x.start, x.end) for x in INDEX_WINDOWS])
    return es.price_index_by_window(p, INDEX_WINDOWS)


RIVALS, BAD = ["alpha", "beta"], ["Inaccurate Data", "Inaccurate data"]
PARITY_BASE = sb.with_(sb.COMPETITOR) + """,
parity AS (SELECT comp.* FROM comp LEFT JOIN acc1 ON comp.activity_id = acc1.activity_id AND comp.supplier_id = acc1.supplier_id
             AND acc1.week = date_trunc('week', comp.snapshot_date)
           WHERE (own_price <> 0 OR own_price IS NULL) AND own_status = 'active' AND (alpha_valid OR beta_valid)
             AND (alpha_accuracy <> 'Inaccurate' OR alpha_accuracy IS NULL) AND (beta_accuracy <> 'Inaccurate' OR beta_accuracy IS NULL)
             AND (alpha_status NOT IN ('Inaccurate Data', 'Inaccurate data') OR alpha_status IS NULL)
             AND (beta_status NOT IN ('Inaccurate Data', 'Inaccurate data') OR beta_status IS NULL)),"""
PARITY_METRICS = "count(DISTINCT activity_id) AS total_activities, count(DISTINCT supplier_id) AS total_suppliers, " + ", ".join(
    f"sum(({r}_meet + {r}_beat) * impressions) / nullif(sum(CASE WHEN {r}_price IS NOT NULL THEN impressions ELSE 0 END), 0) AS {r}_parity_rate"
    for r in RIVALS) + """, sum(CASE WHEN overall IN ('meet', 'beat') THEN impressions ELSE 0 END) / nullif(sum(impressions), 0) AS overall_parity_rate,
  sum(impressions) AS total_impressions"""
PARITY_D = "alpha_parity_rate beta_parity_rate overall_parity_rate total_impressions:2"


def parity(spark, root):
    status = es.latest_status(mp.accuracy_history(spark, root), ["activity_id", "supplier_id"], "snapshot_date", "log_id",
                              ["alpha_status", "beta_status"])
    return es.parity_rows(mp.competitor_prices(spark, root, mp.event_ranges(W)), status, RIVALS, BAD)


@query("price_parity_by_window", "C11 P11 A7 W1 J16", doubles=PARITY_D,
       sql=PARITY_BASE + label_sql("parity", "snapshot_date", W) +
       f" SELECT country_name, period_window, {PARITY_METRICS} FROM lab GROUP BY ALL")
def price_parity_by_window(spark, root):
    return es.price_parity(es.by_window(parity(spark, root), "snapshot_date", W), es.WINDOW_KEYS, RIVALS)


@query("price_parity_weekly", "C11 P6", doubles=PARITY_D,
       sql=PARITY_BASE + label_sql("parity", "snapshot_date", W) +
       f" SELECT country_name, period, phase, week_start, week_index, {PARITY_METRICS} FROM lab GROUP BY ALL")
def price_parity_weekly(spark, root):
    return es.price_parity(es.by_week(parity(spark, root), "snapshot_date", W), es.WEEK_KEYS, RIVALS)


def did_sql(src: str, labels: dict[str, str]) -> str:
    g = lambda m, pw: f"avg({m}) FILTER (period_window = '{pw}')"
    return " UNION ALL ".join(f"""SELECT country_name, '{lab}' AS metric, {g(m, 'PRE_CY')} AS pre_cy, {g(m, 'POST_CY')} AS post_cy,
      ({g(m, 'POST_CY')} - {g(m, 'PRE_CY')}) / nullif({g(m, 'PRE_CY')}, 0) AS cy_change,
      ({g(m, 'POST_LY')} - {g(m, 'PRE_LY')}) / nullif({g(m, 'PRE_LY')}, 0) AS ly_change FROM {src} GROUP BY ALL"""
                              for m, lab in labels.items())


BOOK_DID = {m: m for m in ("bookings", "gmv", "nr", "tickets", "avg_gmv_per_booking")}


@query("booking_event_did", "C12 F4", doubles="pre_cy:4 post_cy:4 cy_change ly_change did",
       sql=sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W, ACTIVE)) +
       f", m AS (SELECT country_name, period_window, {BOOK_METRICS} FROM lab GROUP BY ALL), u AS ({did_sql('m', BOOK_DID)}) "
       "SELECT *, cy_change - ly_change AS did FROM u")
def booking_event_did(spark, root):
    return es.did_pct(booking_event_windows(spark, root), ["country_name"], list(BOOK_DID))


PAIRS = [("PRE", "COMM"), ("PRE", "POST"), ("COMM", "POST")]
GROUPS = {"bookings": "Volume", "gmv": "Volume", "avg_price": "Price"}


@query("did_three_comparisons", "C13", doubles="did",
       sql=sb.with_(sb.BOOKING) + ", w AS (" + " UNION ALL ".join(
           f"SELECT '{x.period}' AS period, '{x.window}' AS win, {d(x.start)} AS s, {d(x.end)} AS e"
           for x in three_phase_windows(ANNOUNCE, ROLLOUT, 6)) + """),
       m AS (SELECT period, country_name, win, count(DISTINCT booking_id)::DOUBLE AS bookings, sum(gmv) AS gmv, avg(unit_price) AS avg_price
             FROM booking JOIN w ON checkout_date BETWEEN s AND e WHERE status_id = 1 GROUP BY ALL),
       u AS (UNPIVOT m ON bookings, gmv, avg_price INTO NAME metric VALUE v),
       p AS (SELECT country_name, metric, """ + ", ".join(
           f"max(v) FILTER (period = '{p}' AND win = '{w}') AS {p}_{w}" for p in ("CY", "LY") for w in ("PRE", "COMM", "POST")) +
       " FROM u GROUP BY ALL) " + " UNION ALL ".join(
           f"""SELECT country_name, CASE metric WHEN 'avg_price' THEN 'Price' ELSE 'Volume' END AS metric_group, metric,
             '{a} to {b}' AS comparison, (CY_{b} - CY_{a}) / nullif(abs(CY_{a}), 0) - (LY_{b} - LY_{a}) / nullif(abs(LY_{a}), 0) AS did,
             (CY_PRE IS NOT NULL AND CY_COMM IS NOT NULL AND CY_POST IS NOT NULL AND LY_PRE IS NOT NULL AND LY_COMM IS NOT NULL
               AND LY_POST IS NOT NULL) AS complete FROM p""" for a, b in PAIRS))
def did_three_comparisons(spark, root):
    summary = booking_three_phase(spark, root)
    es.require_windows(summary, ["CY", "LY"], ["PRE", "COMM", "POST"])   # a missing window stops the run
    return es.did_multi_comparison(summary, ["country_name"], GROUPS, PAIRS)


@query("weekly_did_line", "C14", doubles="did",
       sql=sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W, ACTIVE)) + """,
       m AS (SELECT country_name, week_index, max(phase) FILTER (period = 'CY') AS phase,
               sum(gmv) FILTER (period = 'CY') AS cy, sum(gmv) FILTER (period = 'LY') AS ly FROM lab GROUP BY country_name, week_index),
       b AS (SELECT country_name, avg(cy) AS bc, avg(ly) AS bl FROM m WHERE cy IS NOT NULL AND ly IS NOT NULL AND phase = 'Pre' GROUP BY 1)
       SELECT m.country_name, week_index, phase, cy / nullif(bc, 0) - ly / nullif(bl, 0) AS did
       FROM m LEFT JOIN b USING (country_name) WHERE cy IS NOT NULL AND ly IS NOT NULL""")
def weekly_did_line(spark, root):
    return es.weekly_did_line(booking_weekly_event_study(spark, root), ["country_name"], "gmv")


SUMMARY_B = {"nr": "Net revenue", "gmv": "Gross value", "bookings": "Bookings"}
SUMMARY_S = {"active_suppliers": "Active suppliers", "share_active_suppliers": "Share of active suppliers"}
SUMMARY_C = {"cancellation_rate": "Cancellation rate"}


@query("executive_summary", "C15 U1", doubles="pre_cy:4 post_cy:4 cy_change did",
       sql=sb.with_(sb.BOOKING, sb.ONLINE, label_sql("booking", "checkout_date", W, "WHERE status_id IN (1, 2)")) +
       "," + label_sql("online", "day", W).replace("lab0", "on0").replace("lab AS", "onl AS") +
       f""", m AS (SELECT country_name, period_window, {BOOK_METRICS} FROM lab WHERE status_id = 1 GROUP BY ALL),
       c AS (SELECT country_name, period_window, count(DISTINCT booking_id) FILTER (status_id = 2) / count(DISTINCT booking_id) AS cancellation_rate
             FROM lab GROUP BY ALL),
       s AS ({supply_sql('onl', 'country_name, period_window')}),
       u AS ({did_sql('m', SUMMARY_B)} UNION ALL {did_sql('s', SUMMARY_S)} UNION ALL {did_sql('c', SUMMARY_C)})
       SELECT country_name, metric, pre_cy, post_cy, cy_change, cy_change - ly_change AS did FROM u""")
def executive_summary(spark, root):
    return es.executive_summary([(booking_event_windows(spark, root), SUMMARY_B),
                                 (supply_by_window(spark, root), SUMMARY_S),
                                 (cancellation_by_window(spark, root), SUMMARY_C)], ["country_name"])


# the days around every deep discount of an activity: as many windows as there are discounts, and they overlap
@query("bookings_around_discounts", "J5 P5", doubles="quantity:2",
       sql="""WITH f AS (SELECT l_partkey AS activity_id, CAST(l_shipdate AS DATE) AS day, l_quantity AS quantity, l_discount FROM lineitem),
w AS (SELECT DISTINCT activity_id, day - 10 AS window_start, day + 20 AS window_end FROM f WHERE l_discount >= 0.095)
SELECT activity_id, CAST(w.window_start AS DATE) AS window_start, CAST(w.window_end AS DATE) AS window_end, count(*) AS bookings, sum(quantity) AS quantity
FROM w JOIN f USING (activity_id) WHERE f.day BETWEEN w.window_start AND w.window_end GROUP BY ALL""")
def bookings_around_discounts(spark, root):
    li = read_table(spark, "lineitem", root)
    day = F.to_date("l_shipdate")
    facts = li.select(F.col("l_partkey").alias("activity_id"), day.alias("day"), F.col("l_quantity").alias("quantity"))
    windows = li.filter("l_discount >= 0.095").select(F.col("l_partkey").alias("activity_id"), F.date_sub(day, 10).alias("window_start"),
                                                      F.date_add(day, 20).alias("window_end")).distinct()
    j = interval_join(facts, windows, ["activity_id"], "day", "window_start", "window_end")
    return j.groupBy("activity_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("bookings"), F.sum("quantity").alias("quantity"))
