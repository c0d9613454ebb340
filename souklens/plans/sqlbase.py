"""Common table expressions of the check SQL (DuckDB dialect)."""

SUPPLIERS = """
sup AS (SELECT s_suppkey AS supplier_id, s_nationkey AS nation_id, n_name AS country_name, r_name AS region_name,
               s_acctbal > 5000 AS is_managed, s_suppkey % 2 = 0 AS is_connected
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LINES = """
ln AS (SELECT *, CAST(o_orderdate AS DATE) AS od, CAST(l_shipdate AS DATE) AS sd,
              CAST(date_trunc('week', o_orderdate) AS DATE) AS ow,
              CAST(o_orderdate AS DATE) + CAST(abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) % 400 AS INTEGER) AS td,
              l_suppkey * 8 + l_linenumber AS sl, l_extendedprice / l_quantity AS up
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

BOOKING = SUPPLIERS + "," + LINES + """,
booking AS (SELECT l_orderkey * 8 + l_linenumber AS booking_id, o_orderkey AS cart_id, l_partkey AS activity_id,
              l_suppkey AS supplier_id, o_custkey AS customer_id,
              CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' OR l_linenumber < 7 THEN 1 END AS status_id,
              od AS checkout_date, td AS travel_date, l_quantity AS tickets, l_extendedprice AS gmv,
              l_extendedprice * l_discount AS nr, l_extendedprice * (1 - l_discount) AS supplier_share,
              l_discount * 100 AS commission_rate, up AS unit_price,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS coupon_id, sl AS line_id, country_name, region_name
            FROM ln JOIN sup ON l_suppkey = supplier_id)"""

PRICE = SUPPLIERS + "," + LINES + """,
price AS (SELECT ow AS snapshot_date, td AS travel_date, sl AS activity_id, l_suppkey AS supplier_id,
             up AS price_black, up * (1 - l_discount) AS price_red, l_linenumber - 1 AS slots, country_name,
             CASE nation_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency
          FROM ln JOIN sup ON l_suppkey = supplier_id)"""

FX = """
fx AS (SELECT d AS rate_date, c AS currency,
              (CASE c WHEN 'USD' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) + (dayofyear(d) % 40) / 100.0::DOUBLE AS rate
       FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT unnest(['USD', 'GBP']) AS c))"""

ONLINE = SUPPLIERS + """,
online AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey * 8 + l_linenumber AS activity_id, l_suppkey AS supplier_id,
              l_linestatus = 'O' AS is_online, country_name
           FROM lineitem JOIN sup ON l_suppkey = supplier_id)"""

AVAIL = """
avail AS (SELECT ow AS day, td AS travel_date, sl AS activity_id, l_suppkey AS supplier_id,
             CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_linenumber = 7 THEN 9999999 ELSE l_linenumber END AS vacancies
          FROM ln)"""

EVENTS = """
cust AS (SELECT c_custkey AS visitor_id, n_name AS country_name, r_name AS region_name, c_mktsegment AS segment
         FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ev AS (SELECT event_id, CAST(ts AS DATE) AS day, ts, user_id AS visitor_id, event_type, value,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS activity_id FROM events)"""

TRAFFIC = EVENTS + """,
traffic AS (SELECT day, country_name, activity_id, activity_id % 10 AS supplier_id,
              count(DISTINCT ev.visitor_id) AS visitors,
              count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions,
              count(DISTINCT ev.visitor_id) FILTER (event_type = 'purchase') AS customers,
              count(*) FILTER (event_type = 'purchase') AS bookings,
              count(DISTINCT ev.visitor_id) FILTER (event_type = 'signup') AS add_to_cart_visitors,
              count(DISTINCT ev.visitor_id) FILTER (event_type = 'error') AS unavailability_visitors,
              coalesce(sum(1 + CAST(floor(value) AS BIGINT) % 5) FILTER (event_type = 'purchase'), 0) AS stars,
              count(*) FILTER (event_type = 'purchase') AS reviews
            FROM ev JOIN cust USING (visitor_id) GROUP BY ALL)"""

SESSION = EVENTS + """,
sess AS (SELECT visitor_id, day, country_name, region_name, visitor_id || '-' || strftime(day, '%Y%m%d') AS session_id,
            count(*) FILTER (event_type = 'view') AS detail_views,
            count(DISTINCT activity_id) FILTER (event_type = 'click') AS n_checked,
            count(DISTINCT activity_id) FILTER (event_type = 'signup') AS n_cart,
            bool_or(event_type = 'purchase') AS purchased, count(*) = 1 AS is_bounce,
            day = (SELECT min(day) FROM ev f WHERE f.visitor_id = ev.visitor_id) AS is_new_visitor
         FROM ev JOIN cust USING (visitor_id) GROUP BY visitor_id, day, country_name, region_name)"""


def rival(name: str, salt: int) -> str:
    k, has, acc = f"((l_orderkey + {salt}) % 5)", f"((l_linenumber + {salt}) % 4 <> 0)", f"((l_orderkey + {salt}) % 7)"
    return f"""CASE WHEN {has} THEN up * (0.9::DOUBLE + 0.05::DOUBLE * {k}) END AS {name}_price,
      CASE WHEN {has} THEN CAST({k} = 2 AS INTEGER) END AS {name}_meet,
      CASE WHEN {has} THEN CAST({k} > 2 AS INTEGER) END AS {name}_beat,
      (l_partkey + {salt}) % 3 <> 0 AS {name}_valid,
      CASE WHEN {acc} = 0 THEN 'Inaccurate' WHEN {acc} < 4 THEN 'Accurate' END AS {name}_accuracy"""


COMPETITOR = SUPPLIERS + "," + LINES + f""",
comp AS (SELECT od AS snapshot_date, l_partkey AS activity_id, l_suppkey AS supplier_id, l_quantity AS impressions,
            up AS own_price, CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'paused' END AS own_status,
            {rival('alpha', 0)},
            {rival('beta', 1)},
            CASE WHEN l_orderkey % 5 = 2 THEN 'meet' WHEN l_orderkey % 5 > 2 THEN 'beat' ELSE 'lose' END AS overall,
            country_name
         FROM ln JOIN sup ON l_suppkey = supplier_id),
acc AS (SELECT l_partkey AS activity_id, l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS snapshot_date,
           CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_orderkey AS log_id,
           CASE WHEN l_orderkey % 11 = 0 THEN 'Inaccurate data' ELSE 'OK' END AS alpha_status,
           CASE WHEN l_orderkey % 13 = 0 THEN 'Inaccurate Data' WHEN l_orderkey % 13 < 9 THEN 'OK' END AS beta_status,
           l_linenumber
        FROM lineitem),
acc1 AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY activity_id, supplier_id, week
           ORDER BY snapshot_date DESC, log_id DESC) = 1)"""

ACTION = LINES + """,
act AS (SELECT l_suppkey AS supplier_id, o_orderpriority AS action_type, od AS surfaced_at,
           CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'resolved'
                WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'expired'
                WHEN l_returnflag = 'R' THEN 'dismissed' ELSE 'active' END AS status,
           CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN od + CAST(abs(sd - od) % 90 AS INTEGER) END AS resolved_at,
           CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 'reason ' || l_linenumber END AS dismissal_reason
        FROM ln)"""

LOGIN = """
logins AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS supplier_id, l_linenumber % 3 AS logins,
              l_linestatus = 'O' AS is_active FROM lineitem)"""


def with_(*ctes: str) -> str:
    """Join CTE texts; a CTE already contained in an earlier text is not repeated."""
    out = []
    for c in ctes:
        if not any(c in o for o in out):
            for shared in (SUPPLIERS, LINES, EVENTS):
                if any(shared in o for o in out):
                    c = c.replace(shared + ",", "")
            out.append(c)
    return "WITH " + ",".join(out) + "\n"
