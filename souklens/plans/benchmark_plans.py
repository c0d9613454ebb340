"""Price benchmark and outlier queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from souklens.functions.skew import broadcast_if_small, placed_beside
from souklens.functions.storage import materialise
from souklens.operators import benchmarks as bm
from souklens.operators import configs
from souklens.plans import feature_plans as fp
from souklens.plans import sqlbase as sb
from souklens.plans.registry import query
from souklens.plans.stages import stage
from souklens.sources import marketplace as mp
from souklens.sources.tables import row_count

AS_OF = fp.AS_OF


def priced_options(spark, root, by):
    """Priced options with their EUR price, location, type, category and retail price; slots are dealt out ``by`` these keys."""
    cfg = fp.configurations(spark, root, configs.retail_price().alias("retail"), configs.retail_kind().alias("retail_kind"), by=by)
    s = mp.suppliers(spark, root).select("supplier_id", F.col("country_name").alias("location"), F.when(F.col("nation_id") % 3 == 0, "EUR")
                                         .when(F.col("nation_id") % 3 == 1, "USD").otherwise("GBP").alias("currency"))
    # one row per currency
    fx = mp.fx_rates(spark, root, [(AS_OF, AS_OF)]).filter(F.col("rate_date") == F.lit(AS_OF)).select("currency", "rate")
    s = broadcast_if_small(s, row_count(spark, "supplier", root))
    a = mp.activity_dim(spark, root, "title", "activity_type", "category")
    rate = F.coalesce("rate", F.lit(1.0))
    return (cfg.join(s, "supplier_id").join(F.broadcast(fx), "currency", "left").join(a, "activity_id").select(
        "activity_id", "supplier_id", F.concat_ws("-", "activity_id", "supplier_id").alias("option_id"), "pricing_id",
        F.concat_ws(" ", "title", (F.col("supplier_id") % 4).cast("string")).alias("option_title"),
        "location", "activity_type", "category", (F.col("from_price") / rate).alias("price_eur"),
        (F.col("retail") / rate).alias("retail_eur"), "retail_kind"))


@stage("options")
def options(spark, root):
    """Priced options; they are not shuffled to be joined to activities."""
    return priced_options(spark, root, fp.dealt_by(spark, root))


OPT_SQL = sb.with_(sb.SUPPLIERS, fp.CFG_SQL, sb.FX) + """,
opt AS (SELECT cfg.activity_id, cfg.supplier_id, cfg.activity_id || '-' || cfg.supplier_id AS option_id, pricing_id, p_name || ' ' || (cfg.supplier_id % 4) AS option_title,
   country_name AS location, p_type AS activity_type, p_brand AS category, from_price / coalesce(rate, 1) AS price_eur, retail / coalesce(rate, 1) AS retail_eur, retail_kind
  FROM cfg JOIN sup USING (supplier_id) LEFT JOIN fx ON rate_date = DATE '2001-08-01' AND currency = CASE nation_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END
  JOIN part ON activity_id = p_partkey)"""


def bench_sql(levels) -> str:
    dims = sorted({k for lv in levels for k in lv.keys})
    return ", ben AS (" + " UNION ALL ".join(
        f"SELECT '{lv.name}' AS level, " + ", ".join(k if k in lv.keys else f"NULL AS {k}" for k in dims) +
        ", count(DISTINCT activity_id) AS n_activities, count(*) AS n_prices, avg(price_eur) AS avg_price, stddev_samp(price_eur) AS stddev_price, " +
        ", ".join(f"quantile_cont(price_eur, {p}) AS {n}" for n, p in bm.PROBS.items()) +
        f" FROM opt GROUP BY {', '.join(lv.keys) if lv.keys else '()'} HAVING count(DISTINCT activity_id) >= {lv.min_activities}"
        for lv in levels) + ")"


BENCH_D = "avg_price:4 stddev_price:3 p50:6 p75:6 p90:6 p95:6 p99:6"


def with_bench(spark, root, levels):
    o = options(spark, root)
    b = materialise(bm.hierarchical_benchmarks(o, levels))
    return o, bm.attach_benchmarks(o, b, levels)


@query("hierarchical_benchmarks", "C35 A10 A18 U4", doubles=BENCH_D, sql=OPT_SQL + bench_sql(bm.LEVELS) + " SELECT * FROM ben")
def hierarchical_benchmarks(spark, root):
    return bm.hierarchical_benchmarks(options(spark, root), bm.LEVELS)


@query("category_benchmarks", "C40", doubles=BENCH_D, sql=OPT_SQL + bench_sql(bm.CATEGORY_LEVELS) + " SELECT * FROM ben")
def category_benchmarks(spark, root):
    return bm.hierarchical_benchmarks(options(spark, root), bm.CATEGORY_LEVELS)


def attach_sql(levels) -> str:
    joins = " ".join(f"LEFT JOIN ben b{i} ON b{i}.level = '{lv.name}'" + "".join(f" AND b{i}.{k} = opt.{k}" for k in lv.keys)
                     for i, lv in enumerate(levels))
    return (f", owb AS (SELECT opt.*, " + ", ".join(f"b{i}.p50 AS {lv.name}_p50, b{i}.p95 AS {lv.name}_p95" for i, lv in enumerate(levels)) +
            f" FROM opt {joins})")


def outlier_sql(order, factor) -> str:
    case = lambda f: "CASE " + " ".join(f"WHEN price_eur > {lv}_p95 * {factor} THEN {f(lv, s)}" for lv, s in order) + " END"
    return f""", hit AS (SELECT *, {case(lambda lv, s: s)} AS severity, {case(lambda lv, s: f"'{lv}'")} AS exceeded_level, {case(lambda lv, s: f'{lv}_p95')} AS ref,
   coalesce({', '.join(f'{lv}_p50' for lv, _ in order)}) AS benchmark_p50, coalesce({', '.join(f'{lv}_p95' for lv, _ in order)}) AS benchmark_p95 FROM owb),
hp AS (SELECT *, 'HIGH_PRICE' AS issue, 'Price is ' || CAST(floor(100.0::DOUBLE * (price_eur / ref - 1)) AS BIGINT) || '% above P95 of ' || exceeded_level AS description
  FROM hit WHERE severity IS NOT NULL)"""


ORDER = [("loc_act_cat", 10), ("loc_act", 9), ("location", 8)]
OUT_COLS = ["issue", "severity", "exceeded_level", "activity_id", "supplier_id", "option_id", "pricing_id", "price_eur", "benchmark_p50", "benchmark_p95", "description"]


@query("price_outliers", "C36 J14 F5", doubles="price_eur:6 benchmark_p50:6 benchmark_p95:6",
       sql=OPT_SQL + bench_sql(bm.LEVELS) + attach_sql(bm.LEVELS) + outlier_sql(ORDER, 1.0) + f" SELECT {', '.join(OUT_COLS)} FROM hp")
def price_outliers(spark, root):
    return bm.price_outliers(with_bench(spark, root, bm.LEVELS)[1], ORDER).select(*OUT_COLS)


ORDER2 = [("loc_cat", 10), ("category", 9), ("location", 8)]


@query("category_price_outliers", "C40", doubles="price_eur:6 benchmark_p50:6 benchmark_p95:6",
       sql=OPT_SQL + bench_sql(bm.CATEGORY_LEVELS) + attach_sql(bm.CATEGORY_LEVELS) + outlier_sql(ORDER2, 2.0) + f" SELECT {', '.join(OUT_COLS)} FROM hp")
def category_price_outliers(spark, root):
    return bm.price_outliers(with_bench(spark, root, bm.CATEGORY_LEVELS)[1], ORDER2, factor=2.0).select(*OUT_COLS)


PS_SQL = """, ps AS (SELECT activity_id, count(DISTINCT option_id) AS num_options, count(DISTINCT price_eur) AS num_prices, min(price_eur) AS parent_min, max(price_eur) AS parent_max,
   avg(price_eur) AS parent_avg, coalesce(stddev_samp(price_eur) / nullif(avg(price_eur), 0), 0) AS price_cv,
   coalesce((max(price_eur) - min(price_eur)) / nullif(min(price_eur), 0), 0) AS spread_ratio FROM opt GROUP BY 1)"""


@query("parent_price_stats", "A12", doubles="parent_min:6 parent_max:6 parent_avg:4 price_cv:5 spread_ratio:5", sql=OPT_SQL + PS_SQL + " SELECT * FROM ps")
def parent_price_stats(spark, root):
    return bm.parent_stats(options(spark, root)).drop("parent_rows")


@query("parent_variance_simple", "C40", doubles="spread_ratio:5",
       sql=OPT_SQL + PS_SQL + """ SELECT option_id, pricing_id, spread_ratio, CASE WHEN spread_ratio > 2 THEN 10 WHEN spread_ratio > 1 THEN 8 WHEN spread_ratio > 0.5 THEN 6 ELSE 4 END AS severity
  FROM opt JOIN ps USING (activity_id) WHERE num_options > 1 AND spread_ratio > 0.3""")
def parent_variance_simple(spark, root):
    return bm.parent_variance_simple(options(spark, root)).select("option_id", "pricing_id", "spread_ratio", "severity")


SIM_SQL = """, sim AS (SELECT a.option_id, a.pricing_id, max(abs(a.price_eur - b.price_eur) / nullif(least(a.price_eur, b.price_eur), 0)) AS similar_gap
  FROM opt a JOIN opt b ON a.activity_id = b.activity_id AND a.option_id <> b.option_id AND substring(a.option_title, 1, 50) = substring(b.option_title, 1, 50) GROUP BY 1, 2)"""


@query("similar_title_gap", "J13 F6", doubles="similar_gap:5",
       sql=OPT_SQL + SIM_SQL + " SELECT option_id, pricing_id, similar_gap FROM opt LEFT JOIN sim USING (option_id, pricing_id)")
def similar_title_gap(spark, root):
    return bm.similar_title_gap(options(spark, root)).select("option_id", "pricing_id", "similar_gap")


PERF_SQL = fp.PERF_SQL.replace("WITH ", ", ", 1).replace(sb.SUPPLIERS + ",", "", 1)
OP_SQL = PERF_SQL + ", op AS (SELECT activity_id || '-' || supplier_id AS option_id, bookings_l12m, gmv_l12m FROM perf)"
WPI_SQL = SIM_SQL + PS_SQL + """,
ts AS (SELECT activity_id, option_title, count(DISTINCT pricing_id) AS title_configs, count(DISTINCT price_eur) AS title_prices, min(price_eur) AS title_min, max(price_eur) AS title_max
  FROM opt GROUP BY 1, 2),
w0 AS (SELECT opt.*, ps.* EXCLUDE (activity_id), ts.* EXCLUDE (activity_id, option_title), coalesce(op.bookings_l12m, 0) AS n, coalesce(similar_gap, -1) AS g,
   percent_rank() OVER (PARTITION BY opt.activity_id ORDER BY price_eur) AS pr
  FROM opt JOIN ps ON ps.activity_id = opt.activity_id JOIN ts ON ts.activity_id = opt.activity_id AND ts.option_title = opt.option_title
  LEFT JOIN op ON op.option_id = opt.option_id LEFT JOIN sim ON sim.option_id = opt.option_id AND sim.pricing_id = opt.pricing_id),
wpi AS (SELECT 'PARENT_VARIANCE' AS issue, *,
   CASE WHEN title_configs > 1 AND title_prices > 1 THEN 'DUPLICATE_PRICING_CONFIGS' WHEN n = 0 AND price_eur > parent_avg * 1.2 THEN 'HIGH_PRICE_NO_DEMAND'
     WHEN n BETWEEN 1 AND 5 AND price_eur > parent_avg * 1.5 THEN 'HIGH_PRICE_LOW_DEMAND' WHEN g > 0.3 THEN 'UNCLEAR_DIFFERENTIATION'
     WHEN pr >= 0.75 AND spread_ratio > 0.5 THEN 'HIGH_VARIANCE_OUTLIER' ELSE 'OTHER' END AS sub_type,
   CASE WHEN title_configs >= 4 THEN 10 WHEN title_configs >= 3 THEN 9 WHEN n = 0 AND price_eur > parent_avg * 1.5 THEN 10 WHEN n = 0 AND price_eur > parent_avg * 1.2 THEN 9
     WHEN n <= 5 AND price_eur > parent_avg * 1.5 THEN 8 WHEN g > 1.0 THEN 9 WHEN g > 0.5 THEN 8 WHEN pr >= 0.9 AND spread_ratio > 1.0 THEN 10
     WHEN pr >= 0.9 AND spread_ratio > 0.5 THEN 9 WHEN pr >= 0.75 AND spread_ratio > 1.0 THEN 8 WHEN pr >= 0.75 AND spread_ratio > 0.5 THEN 7 ELSE 5 END AS severity
  FROM w0 WHERE (title_configs > 1 AND title_prices > 1 AND title_max > title_min * 1.2) OR (n = 0 AND price_eur > parent_avg * 1.2)
     OR (n BETWEEN 1 AND 5 AND price_eur > parent_avg * 1.5) OR g > 0.3 OR (num_options > 1 AND spread_ratio > 0.5 AND pr >= 0.75))"""


ISSUE_COLS = ["activity_id", "supplier_id", "option_id", "pricing_id", "location", "activity_type", "category", "price_eur", "retail_eur",
              "bookings_l12m", "gmv_l12m", "parent_sub_type", "parent_severity"]


@stage("option_issues")
def option_issues(spark, root):
    """Options with the performance of their listing, which has one row at most, and their issue inside the activity.

    Slots and bookings are dealt out by activity once; options meet their performance and each other where they are. If an activity
    has too many lines for that, options and performance are joined and stored first.
    """
    crowded = fp.crowded(spark, root, bm.HOT_PARENT)
    by = fp.KEYS if crowded else ["activity_id"]
    p = fp.performance(spark, root, by=by).select(*fp.KEYS, "bookings_l12m", "gmv_l12m")
    if crowded:
        o = bm.with_parent_issue(materialise(options(spark, root).join(p, fp.KEYS, "left")))
    else:
        o = bm.with_parent_issue(placed_beside(priced_options(spark, root, by), p, fp.KEYS), hot=None)
    return o.select(*ISSUE_COLS)


@query("within_parent_issues", "C37 W4 J13", doubles="price_eur:6",
       sql=OPT_SQL + OP_SQL + WPI_SQL + " SELECT issue, sub_type, severity, option_id, pricing_id, price_eur FROM wpi")
def within_parent_issues(spark, root):
    return bm.parent_issues(option_issues(spark, root)).select("issue", "sub_type", "severity", "option_id", "pricing_id", "price_eur")


PM_SQL = """, pm AS (SELECT 'PRICE_MISMATCH' AS issue, *, CASE WHEN price_eur > retail_eur * 1.05 THEN 10 ELSE 8 END AS severity,
   CASE WHEN price_eur > retail_eur * 1.05 THEN 'HIGHER' ELSE 'LOWER' END AS sub_type, 100.0::DOUBLE * (price_eur - retail_eur) / retail_eur AS price_gap_pct
  FROM opt WHERE retail_eur IS NOT NULL AND (price_eur > retail_eur * 1.05 OR price_eur < retail_eur * 0.95))"""


@query("price_mismatch", "C38 F11", doubles="price_eur:6 retail_eur:6 price_gap_pct:5",
       sql=OPT_SQL + PM_SQL + " SELECT sub_type, severity, option_id, pricing_id, retail_kind, price_eur, retail_eur, price_gap_pct FROM pm")
def price_mismatch(spark, root):
    return bm.price_mismatch(options(spark, root)).select("sub_type", "severity", "option_id", "pricing_id", "retail_kind", "price_eur", "retail_eur", "price_gap_pct")


@query("issue_report", "C39 U1 O3", doubles="price_eur:6 gmv_l12m:2",
       sql=OPT_SQL + OP_SQL + WPI_SQL + bench_sql(bm.LEVELS) + attach_sql(bm.LEVELS) + outlier_sql(ORDER, 1.0) + PM_SQL + """,
iss AS (SELECT issue, NULL AS sub_type, severity, supplier_id, activity_id, option_id, pricing_id, price_eur FROM hp
  UNION ALL SELECT issue, sub_type, severity, supplier_id, activity_id, option_id, pricing_id, price_eur FROM wpi
  UNION ALL SELECT issue, sub_type, severity, supplier_id, activity_id, option_id, pricing_id, price_eur FROM pm)
SELECT iss.*, gmv_l12m, bookings_l12m FROM iss LEFT JOIN op USING (option_id)""")
def issue_report(spark, root):
    o = option_issues(spark, root)
    ob = bm.attach_benchmarks(o, materialise(bm.hierarchical_benchmarks(o, bm.LEVELS)), bm.LEVELS)
    columns = ["option_id", *[c for c in bm.REPORT if c != "option_id"], "gmv_l12m", "bookings_l12m"]
    return bm.issue_report([bm.price_outliers(ob, ORDER), bm.parent_issues(o), bm.price_mismatch(o)], stored=True).select(*columns)
