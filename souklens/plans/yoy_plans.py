"""Year-over-year queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.functions.periods import YearToDate
from souklens.operators import yoy
from souklens.plans import sqlbase as sb
from souklens.plans.registry import query
from souklens.sources import marketplace as mp

AS_OF = date(2001, 7, 15)
YTD = YearToDate.at(AS_OF)
RANGES = [(YTD.py_start, YTD.py_end), (YTD.cy_start, YTD.cy_end)]
QUARTERS = {"Q1 - 2001": "q1", "Q2 - 2001": "q2"}


def dated_sessions(spark, root):
    """Sessions of the event month spread over both years' first half."""
    s = mp.sessions(spark, root)
    y = F.when(F.dayofmonth("day") > 15, 2001).otherwise(2000)
    return s.withColumn("day", F.make_date(y, (F.col("visitor_id") % 6 + 1).cast("int"), F.dayofmonth("day")
                                           .cast("int") - F.when(F.dayofmonth("day") > 28, 3).otherwise(0)))


def sess_sql(keys: str) -> str:
    return sb.with_(sb.BOOKING, sb.SESSION) + f""",
s2 AS (SELECT * REPLACE (make_date(CASE WHEN dayofmonth(day) > 15 THEN 2001 ELSE 2000 END, visitor_id % 6 + 1,
         dayofmonth(day) - CASE WHEN dayofmonth(day) > 28 THEN 3 ELSE 0 END) AS day) FROM sess),
s3 AS (SELECT *, CASE WHEN day >= DATE '2001-01-01' AND day < DATE '2001-07-01' THEN 'CY'
                      WHEN day >= DATE '2000-01-01' AND day < DATE '2000-07-01' THEN 'PY' END AS period,
          CAST(date_trunc('quarter', day) AS DATE) AS quarter_start FROM s2),
b3 AS (SELECT *, CASE WHEN checkout_date >= DATE '2001-01-01' AND checkout_date < DATE '2001-07-01' THEN 'CY'
                      WHEN checkout_date >= DATE '2000-01-01' AND checkout_date < DATE '2000-07-01' THEN 'PY' END AS period,
          CAST(date_trunc('quarter', checkout_date) AS DATE) AS quarter_start FROM booking),
v AS (SELECT {keys}period, quarter_start, visitor_id, bool_or(is_new_visitor) AS n, bool_or(detail_views > 0) AS q
      FROM s3 WHERE period IS NOT NULL GROUP BY ALL),
va AS (SELECT {keys}period, quarter_start, count(*) AS visitors, count(*) FILTER (n) AS new_visitors,
         count(*) FILTER (NOT n) AS returning_visitors, count(*) FILTER (q) AS quoted_visitors FROM v GROUP BY ALL),
sa AS (SELECT {keys}period, quarter_start, count(DISTINCT session_id) AS sessions,
         count(DISTINCT session_id) FILTER (is_bounce) AS bounced FROM s3 WHERE period IS NOT NULL GROUP BY ALL),
ba AS (SELECT {keys}period, quarter_start, count(DISTINCT booking_id) AS bookings, count(DISTINCT cart_id) AS transactions,
         count(DISTINCT booking_id) FILTER (coupon_id > 0) AS bookings_with_coupon, sum(gmv) AS gmv, sum(nr) AS nr,
         sum(supplier_share) AS supplier_share, sum(commission_rate * gmv) / nullif(sum(gmv), 0) AS commission_rate
       FROM b3 WHERE period IS NOT NULL AND status_id = 1 GROUP BY ALL),
qa AS (SELECT {keys}period, quarter_start, sessions, visitors, new_visitors, returning_visitors, bookings, transactions,
         bookings_with_coupon, gmv, nr, supplier_share, new_visitors / nullif(visitors, 0) AS new_visitor_share,
         bounced / nullif(sessions, 0) AS bounce_rate, quoted_visitors / nullif(visitors, 0) AS quoter_rate,
         bookings_with_coupon / nullif(bookings, 0) AS coupon_share, nr / nullif(gmv, 0) AS take_rate,
         supplier_share / nullif(gmv, 0) AS supplier_take_rate, bookings / nullif(sessions, 0) AS conversion_rate,
         gmv / nullif(transactions, 0) AS aov, gmv / nullif(bookings, 0) AS avg_price, commission_rate
       FROM (SELECT * FROM sa LEFT JOIN va USING ({keys}period, quarter_start))
       FULL JOIN ba USING ({keys}period, quarter_start))"""


def long_sql(keys: str) -> str:
    metrics = yoy.VOLUMES + yoy.SHARES + yoy.LEVELS
    parts = []
    for m in metrics:
        u = 100.0 if m in yoy.SHARES else 1.0
        for name, e in ((f"cy_{m}", f"c.{m} * {u}::DOUBLE"), (f"py_{m}", f"p.{m} * {u}::DOUBLE"),
                        (f"yoy_{m}_abs", f"(c.{m} - p.{m}) * {u}::DOUBLE"),
                        (f"yoy_{m}_pct", f"(c.{m} / nullif(p.{m}, 0) - 1) * 100.0::DOUBLE")):
            parts.append(f"{e} AS {name}")
    ck = "c.region_name, " if keys else ""
    on = "AND c.region_name = p.region_name" if keys else ""
    names = ", ".join(x.split(" AS ")[1] for x in parts)
    return sess_sql(keys) + f""",
wide AS (SELECT {ck}'Q' || quarter(c.quarter_start) || ' - ' || year(c.quarter_start) AS quarter_label, {', '.join(parts)}
         FROM qa c LEFT JOIN qa p ON p.period = 'PY' AND p.quarter_start = c.quarter_start - INTERVAL 12 MONTH {on}
         WHERE c.period = 'CY'),
lng AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({names})))
SELECT {keys}metric, max(value) FILTER (quarter_label = 'Q1 - 2001') AS q1, max(value) FILTER (quarter_label = 'Q2 - 2001') AS q2
FROM lng GROUP BY ALL"""


def quarters(spark, root, keys):
    return yoy.yoy_quarters(dated_sessions(spark, root), mp.bookings(spark, root, RANGES), YTD, keys)


@query("visitor_new_returning", "C17 P7",
       sql=sess_sql("") + " SELECT * FROM va")
def visitor_new_returning(spark, root):
    return yoy.visitor_new_returning(dated_sessions(spark, root), YTD, [])


@query("yoy_performance_global", "C16 J8 J9 R2 R3 A8 F3", sql=long_sql(""), doubles="q1:4 q2:4")
def yoy_performance_global(spark, root):
    return yoy.pivot_quarters(yoy.yoy_long(quarters(spark, root, []), []), [], QUARTERS)


@query("yoy_performance_region", "C16 R2 R3", sql=long_sql("region_name, "), doubles="q1:4 q2:4")
def yoy_performance_region(spark, root):
    keys = ["region_name"]
    return yoy.pivot_quarters(yoy.yoy_long(quarters(spark, root, keys), keys), keys, QUARTERS)
