"""Small building blocks shown on their own: sources, filters, joins and reshaping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.functions import labels, periods
from souklens.functions.quantiles import exact_quantiles
from souklens.functions.storage import materialise, shared_dir
from souklens.operators import event_study as es
from souklens.operators import configs, panel
from souklens.plans import sqlbase as sb
from souklens.plans.event_plans import W, label_sql
from souklens.plans.registry import query
from souklens.sources import marketplace as mp
from souklens.sources import tables


@query("parameterised_sql", "S1 S2", doubles="gmv:2",
       sql="SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS gmv FROM lineitem WHERE l_shipdate >= DATE '1999-01-01' AND l_quantity > 25 GROUP BY 1")
def parameterised_sql(spark, root):
    return tables.run_sql(
        spark, "SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS gmv FROM {li} WHERE l_shipdate >= :since AND l_quantity > :min_qty GROUP BY 1",
        {"since": date(1999, 1, 1), "min_qty": 25.0}, li=tables.read_table(spark, "lineitem", root))


@query("optional_id_filters", "S3 P8 P9 J10", doubles="gmv:2",
       sql=sb.with_(sb.BOOKING) + """ SELECT 'listed' AS filter, count(*) AS n, sum(gmv) AS gmv FROM booking WHERE supplier_id IN (1, 3, 5) AND lower(country_name) <> ''
  UNION ALL SELECT 'empty list', count(*), sum(gmv) FROM booking UNION ALL SELECT 'flag off', count(*), sum(gmv) FROM booking""")
def optional_id_filters(spark, root):
    b = mp.bookings(spark, root)
    agg = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.sum("gmv").alias("gmv")).select(F.lit(name).alias("filter"), "n", "gmv")
    listed = tables.keep_ids(b, tables.id_frame(spark, [1, 3, 5], "supplier_id"), "supplier_id")
    empty = tables.keep_listed(tables.keep_ids(b, tables.id_frame(spark, [], "supplier_id"), "supplier_id"), "country_name", [])
    off = tables.flag_filter(b, F.lit(False), F.col("supplier_id") == 1)
    return agg(listed, "listed").unionByName(agg(empty, "empty list")).unionByName(agg(off, "flag off"))


@query("csv_parameter_rows", "S4",
       sql="""SELECT p_type, item, count(*) AS n FROM (SELECT p_type, trim(unnest(string_split(p_size || ', ,' || p_brand || ', ' || (p_partkey % 3), ','))) AS t, NULL FROM part),
  LATERAL (SELECT TRY_CAST(t AS BIGINT) AS item) WHERE t <> '' GROUP BY 1, 2""")
def csv_parameter_rows(spark, root):
    p = tables.read_table(spark, "part", root).withColumn(
        "ids", F.concat(F.col("p_size").cast("string"), F.lit(", ,"), F.col("p_brand"), F.lit(", "), (F.col("p_partkey") % 3).cast("string")))
    return tables.csv_rows(p, "ids", "item").groupBy("p_type", "item").agg(F.count(F.lit(1)).alias("n"))


@query("materialised_view_chain", "S5 S6", doubles="gmv:2",
       sql=sb.with_(sb.BOOKING) + " SELECT region_name, count(*) AS n, sum(gmv) AS gmv FROM booking WHERE status_id = 1 GROUP BY 1")
def materialised_view_chain(spark, root):
    saved = materialise(mp.bookings(spark, root).filter("status_id = 1").select("region_name", "gmv"))
    saved.createOrReplaceTempView("active_booking")
    return spark.sql("SELECT region_name, count(*) AS n, sum(gmv) AS gmv FROM active_booking GROUP BY 1")


def _fresh(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/souklens-{uuid.uuid4().hex}"


@query("scenario_replacement", "S7", doubles="gmv:2",
       sql=sb.with_(sb.BOOKING) + """ SELECT 'placebo' AS scenario, country_name, sum(gmv) AS gmv FROM booking WHERE status_id = 1 GROUP BY ALL
  UNION ALL SELECT 'real', country_name, sum(gmv) FROM booking WHERE status_id = 2 GROUP BY ALL""")
def scenario_replacement(spark, root):
    b, path = mp.bookings(spark, root), _fresh(spark)
    by = lambda cond, name: b.filter(cond).groupBy("country_name").agg(F.sum("gmv").alias("gmv")).withColumn("scenario", F.lit(name))
    tables.replace_scenario(by("status_id = 1", "placebo").unionByName(by("status_id = 1", "real")), path)
    tables.replace_scenario(by("status_id = 2", "real"), path)
    return spark.read.parquet(path)


@query("additive_schema", "S8", doubles="gmv:2 nr:4",
       sql=sb.with_(sb.BOOKING) + """ SELECT country_name, sum(gmv) AS gmv, NULL::DOUBLE AS nr FROM booking WHERE status_id = 1 GROUP BY 1
  UNION ALL SELECT country_name, sum(gmv), sum(nr) FROM booking WHERE status_id = 2 GROUP BY 1""")
def additive_schema(spark, root):
    b, path = mp.bookings(spark, root), _fresh(spark)
    tables.append_evolving(b.filter("status_id = 1").groupBy("country_name").agg(F.sum("gmv").alias("gmv")), path)
    tables.append_evolving(b.filter("status_id = 2").groupBy("country_name").agg(F.sum("gmv").alias("gmv"), F.sum("nr").alias("nr")), path)
    return tables.read_evolved(spark, path)


@query("frozen_cohort", "S9", sql=sb.with_(sb.SUPPLIERS) + " SELECT supplier_id, country_name FROM sup WHERE is_managed")
def frozen_cohort(spark, root):
    return tables.freeze_cohort(mp.suppliers(spark, root).filter("is_managed").select("supplier_id", "country_name"), _fresh(spark))


@query("label_primitives", "P10 P16 P15 F6",
       sql="""SELECT CASE WHEN lower(coalesce(c_mktsegment, '')) IN ('building', 'machinery') THEN c_mktsegment ELSE 'Other' END AS segment,
  CASE WHEN c_nationkey % 4 = 0 THEN 'Yes' WHEN c_nationkey % 4 = 1 THEN 'No' ELSE 'Unknown' END AS flag,
  CASE WHEN c_acctbal = 0 OR c_acctbal IS NULL THEN 'none' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS tier, count(*) AS n FROM customer GROUP BY ALL""")
def label_primitives(spark, root):
    c = tables.read_table(spark, "customer", root)
    raw = F.when(F.col("c_nationkey") % 4 == 0, " YES ").when(F.col("c_nationkey") % 4 == 1, "False").otherwise("maybe")
    return c.select(labels.one_of_or_other(F.col("c_mktsegment"), ["Building", "Machinery"]).alias("segment"), labels.yes_no(raw).alias("flag"),
                    labels.edge_bucket(F.col("c_acctbal"), [1000, 5000], ["low", "mid", "high"], zero="none").alias("tier")
                    ).groupBy("segment", "flag", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("null_tolerant_exclusion", "P11",
       sql=sb.with_(sb.COMPETITOR) + " SELECT alpha_accuracy, count(*) AS n FROM comp WHERE alpha_accuracy NOT IN ('Inaccurate') OR alpha_accuracy IS NULL GROUP BY 1")
def null_tolerant_exclusion(spark, root):
    c = mp.competitor_prices(spark, root)
    return c.filter(labels.not_in_or_null(F.col("alpha_accuracy"), ["Inaccurate"])).groupBy("alpha_accuracy").agg(F.count(F.lit(1)).alias("n"))


@query("fx_conversion", "J15 P11", doubles="eur:4",
       sql=sb.with_(sb.PRICE, sb.FX) + """ SELECT price.currency, count(*) AS n, avg(price_black / CASE WHEN price.currency = 'EUR' THEN 1.0::DOUBLE ELSE rate END) AS eur
  FROM price LEFT JOIN fx ON fx.currency = price.currency AND rate_date = snapshot_date WHERE price.currency = 'EUR' OR rate > 0 GROUP BY 1""")
def fx_conversion(spark, root):
    p = panel.to_eur(mp.prices(spark, root), mp.fx_rates(spark, root), "snapshot_date", {"price_black": "e"})
    return p.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("eur"))


@query("week_spine", "F2 F1",
       sql="""SELECT CAST(unnest(generate_series(date_trunc('week', min(o_orderdate)), LEAST(max(o_orderdate), TIMESTAMP '2001-03-01'), INTERVAL 7 DAY)) AS DATE) AS week_start FROM orders""")
def week_spine(spark, root):
    o = mp.orders(spark, root).agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return periods.week_spine(o, F.to_date(F.date_trunc("week", "a")), F.col("b"), date(2001, 3, 1))


@query("exact_percentiles", "A10", doubles="p25:6 p50:6 p75:6 p99:6",
       sql=sb.with_(sb.BOOKING) + " SELECT country_name, " + ", ".join(f"quantile_cont(gmv, {p}) AS {n}" for n, p in (("p25", .25), ("p50", .5), ("p75", .75), ("p99", .99))) +
       " FROM booking GROUP BY 1")
def exact_percentiles(spark, root):
    return exact_quantiles(mp.bookings(spark, root), "gmv", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}, ["country_name"])


@query("latest_value_in_group", "A16 W1",
       sql="SELECT l_partkey AS activity_id, arg_max(l_linestatus, l_orderkey * 8 + l_linenumber) AS status FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL) GROUP BY 1")
def latest_value_in_group(spark, root):
    # equal keys are settled by the larger status
    li = mp.lineitem(spark, root)
    seq = F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_linestatus")
    return li.groupBy(F.col("l_partkey").alias("activity_id")).agg(F.max_by("l_linestatus", seq).alias("status"))


@query("quarter_pivot", "R2", doubles="q1:2 q2:2 q3:2 q4:2",
       sql=sb.with_(sb.BOOKING) + " SELECT country_name, " + ", ".join(f"sum(gmv) FILTER (quarter(checkout_date) = {q}) AS q{q}" for q in (1, 2, 3, 4)) +
       " FROM booking WHERE checkout_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1")
def quarter_pivot(spark, root):
    b = mp.bookings(spark, root, [(date(2000, 1, 1), date(2000, 12, 31))])
    b = b.withColumn("q", F.concat(F.lit("q"), F.quarter("checkout_date")))
    return b.groupBy("country_name").pivot("q", ["q1", "q2", "q3", "q4"]).agg(F.sum("gmv"))


@query("metric_unpivot", "R3", doubles="value:2",
       sql=sb.with_(sb.BOOKING) + """, g AS (SELECT country_name, sum(gmv) AS gmv, sum(nr) AS nr, sum(tickets) AS tickets FROM booking GROUP BY 1)
  SELECT country_name, metric, value FROM g UNPIVOT (value FOR metric IN (gmv, nr, tickets))""")
def metric_unpivot(spark, root):
    g = mp.bookings(spark, root).groupBy("country_name").agg(F.sum("gmv").alias("gmv"), F.sum("nr").alias("nr"), F.sum("tickets").alias("tickets"))
    return es.melt(g, ["country_name"], ["gmv", "nr", "tickets"])


@query("safe_casts", "F12 F4",
       sql="SELECT TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS no_number, count(*) AS n FROM part GROUP BY ALL")
def safe_casts(spark, root):
    p = tables.read_table(spark, "part", root)
    return p.groupBy(F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").alias("brand_no"), F.col("p_name").try_cast("double").alias("no_number")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sentence_labels", "F5", doubles="change_pct:4",
       sql=sb.with_(sb.BOOKING) + """, g AS (SELECT country_name, sum(gmv) FILTER (year(checkout_date) = 1999) AS a, sum(gmv) FILTER (year(checkout_date) = 2000) AS b FROM booking GROUP BY 1)
  SELECT country_name, (b - a) / nullif(a, 0) * 100 AS change_pct, country_name || ' moved ' || CASE WHEN b >= a THEN 'up' ELSE 'down' END || ' to ' || CAST(floor(b) AS BIGINT) AS sentence FROM g""")
def sentence_labels(spark, root):
    b = mp.bookings(spark, root, [(date(1999, 1, 1), date(2000, 12, 31))])
    at = lambda y: F.sum(F.when(F.year("checkout_date") == y, F.col("gmv")))
    g = b.groupBy("country_name").agg(at(1999).alias("a"), at(2000).alias("b"))
    up = F.when(F.col("b") >= F.col("a"), "up").otherwise("down")
    return g.select("country_name", ((F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)) * 100).alias("change_pct"),
                    F.concat(F.col("country_name"), F.lit(" moved "), up, F.lit(" to "), F.floor("b").cast("string")).alias("sentence"))


@query("outer_explode_tiers", "F11", sql="""SELECT l_linestatus = 'O' AS has_group_data, sum(CASE WHEN l_linestatus = 'O' THEN CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END ELSE 1 END)::BIGINT AS n,
  sum(CASE WHEN l_linestatus = 'O' THEN CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END ELSE 0 END)::BIGINT AS priced FROM lineitem GROUP BY 1""")
def outer_explode_tiers(spark, root):
    c = configs.parse_config(mp.slot_configs(spark, root), "details", mp.CONFIG_DDL)
    return configs.tier_rows(c, "groups", outer=True).groupBy((F.col("vacancies") > 0).alias("has_group_data")).agg(
        F.count(F.lit(1)).alias("n"), F.count("tier_price").alias("priced"))


@query("ordered_windows", "O1", doubles="gmv:2",
       sql=sb.with_(sb.BOOKING, label_sql("booking", "checkout_date", W)) + """ SELECT period_window, CASE period_window WHEN 'PRE_LY' THEN 1 WHEN 'POST_LY' THEN 2 WHEN 'PRE_CY' THEN 3 ELSE 4 END AS sort_key,
  count(*) AS n, sum(gmv) AS gmv FROM lab GROUP BY 1, 2 ORDER BY 2""")
def ordered_windows(spark, root):
    b = es.by_window(mp.bookings(spark, root, mp.event_ranges(W)), "checkout_date", W)
    g = b.groupBy("period_window").agg(F.count(F.lit(1)).alias("n"), F.sum("gmv").alias("gmv"))
    return g.withColumn("sort_key", labels.category_order(F.col("period_window"), es.WINDOWS)).orderBy("sort_key")
