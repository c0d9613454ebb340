"""Feature adoption, lift and concentration queries on the listing stage table."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions.labels import adoption_level, maturity_band
from souklens.functions.skew import broadcast_if_small
from souklens.functions.storage import materialise
from souklens.operators import lift, ranking
from souklens.plans.feature_plans import AS_OF, LISTING_SQL, listings
from souklens.plans.registry import query

FEATURES = ["has_individual", "has_group", "has_addons", "has_scale", "has_capacity", "has_cutoff"]
NAMES = {"Individual": "has_individual", "Group": "has_group", "Addons": "has_addons", "Scale": "has_scale"}
VALUE = "gmv_lifetime"


def sold(spark, root):
    return listings(spark, root).filter(F.col(VALUE) > 0)


SOLD = LISTING_SQL + ",\nsold AS (SELECT * FROM lst WHERE gmv_lifetime > 0)"


def melt_sql(src: str, keep: str, feats=FEATURES) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, {f} AS has FROM {src}" for f in feats) + ")"


def lift_sql(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1) * 100"


RAW = SOLD + f""", g AS (SELECT feature, count(*) FILTER (has = 1) AS n_with, count(*) FILTER (has = 0) AS n_without,
   avg(gmv_lifetime) FILTER (has = 1) AS mean_with, avg(gmv_lifetime) FILTER (has = 0) AS mean_without,
   avg(avg_booking_value) FILTER (has = 1) AS aov_with, avg(avg_booking_value) FILTER (has = 0) AS aov_without
  FROM {melt_sql('sold', 'gmv_lifetime, avg_booking_value')} GROUP BY 1),
raw AS (SELECT *, 100.0::DOUBLE * n_with / nullif(n_with + n_without, 0) AS adoption_pct, {lift_sql('mean_with', 'mean_without')} AS lift_pct,
   {lift_sql('aov_with', 'aov_without')} AS aov_lift_pct, n_without * mean_without * ({lift_sql('mean_with', 'mean_without')}) / 100 AS potential FROM g)"""


@query("raw_lift", "C47 A4", doubles="mean_with:4 mean_without:4 aov_with:4 aov_without:4 adoption_pct:5 lift_pct:5 aov_lift_pct:5 potential:1",
       sql=RAW + " SELECT * FROM raw")
def raw_lift(spark, root):
    return lift.raw_lift(sold(spark, root), FEATURES, VALUE, "avg_booking_value")


# fixed values: assumed effort per feature
DIFFICULTY = {"has_individual": 1, "has_group": 2, "has_addons": 2, "has_scale": 3, "has_capacity": 2, "has_cutoff": 1}


@query("opportunity_score", "C60 W7", doubles="potential_m:5 lift_pct:5 adoption_pct:5 score:5 cumulative_m:5",
       sql=RAW + f""", o AS (SELECT *, CASE feature {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DIFFICULTY.items())} END AS difficulty FROM raw),
s AS (SELECT *, potential / 1e6 * lift_pct / (difficulty * greatest(adoption_pct, 10)) AS score FROM o)
SELECT feature, difficulty, potential / 1e6 AS potential_m, lift_pct, adoption_pct, score, CASE WHEN score > 100 THEN 'P0' WHEN score > 50 THEN 'P1' ELSE 'P2' END AS priority,
  sum(potential / 1e6) OVER (ORDER BY potential DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative_m FROM s""")
def opportunity_score(spark, root):
    return lift.opportunity_score(raw_lift(spark, root), DIFFICULTY)


P = lift.PRIME
BOOT = 400
WSQL = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(lift.POISSON)) + f" ELSE {len(lift.POISSON)} END"


def boot_sql(feats):
    return SOLD + f""", m AS (SELECT * FROM {melt_sql('sold', 'listing_id, gmv_lifetime AS x0', feats)}),
c AS (SELECT feature, has, quantile_cont(x0, 0.01) AS lo, quantile_cont(x0, 0.99) AS hi, count(*) AS n FROM m GROUP BY 1, 2),
x AS (SELECT m.feature, m.has, CAST(listing_id % {P} AS BIGINT) AS k, least(greatest(x0, lo), hi) AS x, n FROM m JOIN c USING (feature, has)),
t1 AS (SELECT *, (k * 48271 + r * 69621 + 1) % {P} AS t FROM x, (SELECT unnest(range(1, {BOOT + 1})) AS r)),
t2 AS (SELECT * REPLACE ((t * t + r * 40692 + k) % {P} AS t) FROM t1),
t3 AS (SELECT *, ((t * t + k * 16807) % {P}) / {P}.0::DOUBLE AS u FROM t2),
s AS (SELECT feature, r, has, sum(w * x) AS s, sum(w) AS w, max(n) AS n FROM (SELECT *, {WSQL} AS w FROM t3) GROUP BY 1, 2, 3),
b AS (SELECT feature, r, max(s / w) FILTER (has = 1) AS a, max(s / w) FILTER (has = 0) AS b, max(n) FILTER (has = 1) AS n_with, max(n) FILTER (has = 0) AS n_without FROM s GROUP BY 1, 2)
SELECT feature, avg({lift_sql('a', 'b')}) AS lift_mean_pct, quantile_cont({lift_sql('a', 'b')}, 0.025) AS ci_low_pct, quantile_cont({lift_sql('a', 'b')}, 0.975) AS ci_high_pct,
  max(n_with) AS n_with, max(n_without) AS n_without FROM b WHERE n_with >= 200 AND n_without >= 200 AND b > 0 GROUP BY 1"""


@query("bootstrap_lift", "C48", doubles="lift_mean_pct:5 ci_low_pct:5 ci_high_pct:5",
       sql=boot_sql(["has_addons", "has_scale"]))
def bootstrap_lift(spark, root):
    return lift.bootstrap_lift(sold(spark, root), "listing_id", ["has_addons", "has_scale"], VALUE, replicates=BOOT)


# over every feature: bootstrap_lift stays as its SQL has it
@query("bootstrap_lift_features", "C48", doubles="lift_mean_pct:5 ci_low_pct:5 ci_high_pct:5", sql=boot_sql(FEATURES))
def bootstrap_lift_features(spark, root):
    return lift.bootstrap_lift(sold(spark, root), "listing_id", FEATURES, VALUE, replicates=BOOT)


TOPC = """, topc AS (SELECT country_name FROM sold GROUP BY 1 ORDER BY count(*) DESC, country_name LIMIT 25),
st AS (SELECT *, CASE WHEN country_name IN (SELECT country_name FROM topc) THEN country_name ELSE 'Other' END AS country_name_top FROM sold)"""


@query("stratified_lift", "C49", doubles="lift_mean_pct:5 lift_median_pct:5",
       sql=SOLD + TOPC + f""", g AS (SELECT feature, country_name_top, activity_type, count(*) FILTER (has = 1) AS n_with, count(*) FILTER (has = 0) AS n_without,
   {lift_sql('avg(v) FILTER (has = 1)', 'avg(v) FILTER (has = 0)')} AS lift_mean_pct,
   {lift_sql('quantile_cont(v, 0.5) FILTER (has = 1)', 'quantile_cont(v, 0.5) FILTER (has = 0)')} AS lift_median_pct
  FROM {melt_sql('st', 'country_name_top, activity_type, gmv_lifetime AS v')} GROUP BY 1, 2, 3)
SELECT *, n_with + n_without AS weight FROM g WHERE n_with >= 40 AND n_without >= 40""")
def stratified_lift(spark, root):
    d = lift.top_values(sold(spark, root), "country_name", 25, "Other")
    return lift.stratified_lift(d, FEATURES, VALUE, ["country_name_top", "activity_type"])


SEG_SQL = lambda keys: f"""SELECT {keys}, feature, count(*) FILTER (has = 1) AS n_with, count(*) FILTER (has = 0) AS n_without,
   avg(v) FILTER (has = 1) AS avg_with, avg(v) FILTER (has = 0) AS avg_without, avg(a) FILTER (has = 1) AS aov_with, avg(a) FILTER (has = 0) AS aov_without
  FROM {melt_sql('sold', keys + ', gmv_lifetime AS v, avg_booking_value AS a')} GROUP BY 1, 2"""


@query("segment_lift", "C46 R1", doubles="avg_with:4 avg_without:4 aov_with:4 aov_without:4 adoption_pct:5 lift_pct:5",
       sql=SOLD + f", g AS ({SEG_SQL('region_name')}) SELECT *, 100.0::DOUBLE * n_with / nullif(n_with + n_without, 0) AS adoption_pct, "
       f"{lift_sql('avg_with', 'avg_without')} AS lift_pct FROM g WHERE n_with > 0 AND n_without > 0")
def segment_lift(spark, root):
    return lift.segment_lift(sold(spark, root), FEATURES, "region_name", VALUE, "avg_booking_value")


@query("segment_lift_matrix", "C80 R1", doubles=" ".join(f"{f}:5" for f in FEATURES),
       sql=SOLD + ", top AS (SELECT country_name FROM sold GROUP BY 1 ORDER BY count(*) DESC, country_name LIMIT 8) SELECT country_name, " + ", ".join(
           f"CASE WHEN count(*) FILTER ({f} = 1) >= 120 AND count(*) FILTER ({f} = 0) >= 120 AND avg(gmv_lifetime) FILTER ({f} = 0) > 0 THEN "
           f"{lift_sql(f'avg(gmv_lifetime) FILTER ({f} = 1)', f'avg(gmv_lifetime) FILTER ({f} = 0)')} END AS {f}" for f in FEATURES) +
       " FROM sold WHERE country_name IN (SELECT country_name FROM top) GROUP BY 1")
def segment_lift_matrix(spark, root):
    return lift.segment_lift_matrix(sold(spark, root), FEATURES, "country_name", VALUE)


PM = """CASE WHEN has_individual = 1 AND has_group = 1 THEN 'Individual + Group' WHEN has_individual = 1 THEN 'Individual Only'
  WHEN has_group = 1 THEN 'Group Only' ELSE 'No Pricing Model' END"""
PSYS = "CASE WHEN uses_external = 1 THEN 'External API' WHEN live_dynamic = 1 THEN 'Live Dynamic' ELSE 'Native' END"
GP = lambda label, name, where="": f"""SELECT {label} AS {name}, count(*) AS listings, count(DISTINCT supplier_id) AS suppliers, avg(gmv_lifetime) AS avg_value,
  sum(gmv_lifetime) AS total_value, avg(avg_booking_value) AS avg_aov, avg(bookings_l12m) AS avg_bookings, quantile_cont(gmv_lifetime, 0.5) AS median_value FROM sold {where} GROUP BY 1"""
GP_D = "avg_value:4 total_value:2 avg_aov:4 avg_bookings median_value:6"


@query("pricing_model_performance", "C45", doubles=GP_D, sql=SOLD + " " + GP(PM, "pricing_model"))
def pricing_model_performance(spark, root):
    return lift.group_performance(sold(spark, root).withColumn("pricing_model", lift.pricing_model()), "pricing_model", VALUE)


@query("pricing_system_performance", "C45", doubles=GP_D, sql=SOLD + " " + GP(PSYS, "pricing_system"))
def pricing_system_performance(spark, root):
    return lift.group_performance(sold(spark, root).withColumn("pricing_system", lift.pricing_system()), "pricing_system", VALUE)


COMBO = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"{c} = {v}" for c, v in zip(("has_individual", "has_group", "has_addons", "has_scale"), st)) + f" THEN '{n}'"
    for n, st in lift.COMBINATIONS.items()) + " END"


@query("combination_performance", "C45 J4", doubles=GP_D + " lift_vs_baseline_pct:5",
       sql=SOLD + ", g AS (" + GP(COMBO, "combination", "WHERE uses_external = 0") +
       f"), h AS (SELECT * FROM g WHERE combination IS NOT NULL) SELECT h.*, {lift_sql('avg_value', 'b')} AS lift_vs_baseline_pct "
       "FROM h, (SELECT max(avg_value) AS b FROM h WHERE combination = 'Individual Only')")
def combination_performance(spark, root):
    return lift.combination_performance(sold(spark, root), VALUE)


BUNDLE = """CASE WHEN has_individual = 0 AND has_group = 0 AND has_addons + has_scale + has_capacity + has_cutoff = 0 THEN 'No pricing features'
  ELSE concat_ws(' + ', CASE WHEN has_individual = 1 AND has_group = 1 THEN 'Flexible' WHEN has_individual = 1 THEN 'Individual' WHEN has_group = 1 THEN 'Group' ELSE 'None' END,
    nullif(concat_ws('+', CASE WHEN has_addons = 1 THEN 'Addons' END, CASE WHEN has_scale = 1 THEN 'Scale' END, CASE WHEN has_capacity = 1 THEN 'Capacity' END,
      CASE WHEN has_cutoff = 1 THEN 'Cutoff' END), '')) END"""


@query("bundle_performance", "C79 W6", doubles="total_value:2 median_value:6 listing_share_pct:5 value_share_pct:5",
       sql=SOLD + f""", g AS (SELECT {BUNDLE} AS bundle, count(*) AS listings, count(DISTINCT supplier_id) AS suppliers, sum(gmv_lifetime) AS total_value,
   CAST(sum(bookings_l12m) AS BIGINT) AS total_bookings, quantile_cont(gmv_lifetime, 0.5) AS median_value FROM sold GROUP BY 1 HAVING count(*) >= 200)
SELECT *, 100.0::DOUBLE * listings / sum(listings) OVER () AS listing_share_pct, 100.0::DOUBLE * total_value / sum(total_value) OVER () AS value_share_pct FROM g""")
def bundle_performance(spark, root):
    return lift.bundle_performance(sold(spark, root), VALUE)


Q10 = [i / 10 for i in range(11)]


@query("quantile_trend", "C50", doubles="mean_x:5 mean_feature_count:5",
       sql=SOLD + ", e AS (SELECT quantile_cont(gmv_lifetime, " + str(Q10) + ") AS q FROM sold), b AS (SELECT CAST(CASE " + " ".join(
           f"WHEN gmv_lifetime <= q[{i + 2}] THEN {i}" for i in range(10)) + " END AS INTEGER) AS bin, gmv_lifetime, feature_count FROM sold, e) "
       "SELECT bin, count(*) AS n, avg(gmv_lifetime) AS mean_x, avg(feature_count) AS mean_feature_count FROM b GROUP BY 1")
def quantile_trend(spark, root):
    return lift.quantile_trend(sold(spark, root), VALUE, ["feature_count"])


@query("fixed_width_trend", "C50", doubles="median_outcome:6",
       sql=SOLD + """, b AS (SELECT CAST(ceil((avg_total_tiers + 0.01) / 0.5) - 1 AS BIGINT) AS bin, gmv_lifetime FROM sold)
  SELECT bin, count(*) AS n, quantile_cont(gmv_lifetime, 0.5) AS median_outcome FROM b GROUP BY 1 HAVING count(*) >= 30""")
def fixed_width_trend(spark, root):
    return lift.fixed_width_trend(sold(spark, root), "avg_total_tiers", VALUE, 0.5)


@query("adoption_by_group", "C51", doubles="total_value:2 adoption_pct:5",
       sql=LISTING_SQL + f" SELECT value_tier, is_managed, feature, count(*) AS n, sum(v) AS total_value, avg(has) * 100 AS adoption_pct "
       f"FROM {melt_sql('lst', 'value_tier, is_managed, gmv_lifetime AS v')} GROUP BY 1, 2, 3")
def adoption_by_group(spark, root):
    return lift.adoption_by_group(listings(spark, root), FEATURES, ["value_tier", "is_managed"], VALUE)


SUP = LISTING_SQL + ", sv AS (SELECT supplier_id, region_name, is_managed, " + ", ".join(f"max({f}) AS {f}" for f in FEATURES) + \
    ", sum(gmv_lifetime) AS supplier_value, count(*) AS listings FROM lst GROUP BY ALL)"


def by_supplier(spark, root):
    return lift.supplier_adoption(listings(spark, root), FEATURES, ["region_name", "is_managed"], VALUE)


PAR = SUP + """, par AS (SELECT *, sum(supplier_value) OVER (PARTITION BY region_name ORDER BY supplier_value DESC, supplier_id ROWS UNBOUNDED PRECEDING)
    / sum(supplier_value) OVER (PARTITION BY region_name) AS cumulative_share FROM sv WHERE supplier_value > 0)"""


@query("pareto_suppliers", "W8", doubles="cumulative_share:7",
       sql=PAR + " SELECT supplier_id, region_name, cumulative_share, cumulative_share <= 0.8 AS in_set FROM par")
def pareto_suppliers(spark, root):
    return ranking.pareto_set(by_supplier(spark, root), ["region_name"], "supplier_id", "supplier_value").select(
        "supplier_id", "region_name", "cumulative_share", "in_set")


@query("pareto_adoption", "C51 W8", doubles="total_value:2 adoption_pct:5",
       sql=PAR + f", p8 AS (SELECT * FROM par WHERE cumulative_share <= 0.8) SELECT region_name, feature, count(*) AS n, sum(v) AS total_value, avg(has) * 100 AS adoption_pct "
       f"FROM {melt_sql('p8', 'region_name, supplier_value AS v')} GROUP BY 1, 2")
def pareto_adoption(spark, root):
    p = ranking.pareto_set(by_supplier(spark, root), ["region_name"], "supplier_id", "supplier_value").filter("in_set")
    return lift.adoption_by_group(p, FEATURES, ["region_name"], "supplier_value")


def reach_rules():
    priced = (F.col("has_individual") == 1) | (F.col("has_group") == 1)
    return {"has_scale": F.col("has_individual") == 1, "has_addons": None, "native_scale": priced, "static_api": priced}


RULES = {"has_scale": "has_individual = 1", "has_addons": "true", "native_scale": "has_individual = 1 OR has_group = 1",
         "static_api": "has_individual = 1 OR has_group = 1"}


def reach_sql(keys: str) -> str:
    return LISTING_SQL + ", rr AS (" + " UNION ALL ".join(
        f"SELECT {keys}, supplier_id, coalesce(gmv_lifetime, 0) AS v, '{f}' AS feature, {f} AS has, ({r}) AS ok FROM lst" for f, r in RULES.items()) + f"""),
ra AS (SELECT {keys}, feature, count(*) AS listings, count(DISTINCT supplier_id) AS suppliers, sum(v) AS total_value,
   100.0::DOUBLE * count(*) FILTER (ok) / count(*) AS reach_pct, 100.0::DOUBLE * sum(has) FILTER (ok) / nullif(count(*) FILTER (ok), 0) AS activation_pct,
   100.0::DOUBLE * sum(has * v) FILTER (ok) / nullif(sum(v) FILTER (ok), 0) AS activation_value_pct FROM rr GROUP BY ALL)"""


REACH_D = "total_value:2 reach_pct:5 activation_pct:5 activation_value_pct:5"


@query("reach_activation", "C52", doubles=REACH_D, sql=reach_sql("region_name, value_tier") + " SELECT * FROM ra")
def reach_activation(spark, root):
    return lift.reach_activation(listings(spark, root), reach_rules(), ["region_name", "value_tier"], VALUE)


@query("managed_activation_gap", "C53", doubles="activation_a:5 activation_b:5 delta_pp:5",
       sql=reach_sql("is_managed") + """ SELECT feature, max(activation_pct) FILTER (is_managed) AS activation_a, max(activation_pct) FILTER (NOT is_managed) AS activation_b,
  max(activation_pct) FILTER (is_managed) - max(activation_pct) FILTER (NOT is_managed) AS delta_pp FROM ra GROUP BY 1""")
def managed_activation_gap(spark, root):
    r = lift.reach_activation(listings(spark, root), reach_rules(), ["is_managed"], VALUE)
    return lift.group_delta(r, "is_managed", True, False)


TIERS4 = """, cut AS (SELECT quantile_cont(supplier_value, [0.25, 0.5, 0.75]) AS q FROM sv WHERE supplier_value > 0),
t4 AS (SELECT sv.*, CASE WHEN coalesce(supplier_value, 0) <= 0 THEN 'none' WHEN supplier_value <= q[1] THEN 'p0-25' WHEN supplier_value <= q[2] THEN 'p25-50'
  WHEN supplier_value <= q[3] THEN 'p50-75' ELSE 'p75-100' END AS size_bucket FROM sv, cut)"""
LAB4 = ["p0-25", "p25-50", "p50-75", "p75-100"]


def bucketed(spark, root):
    return lift.value_tiers(by_supplier(spark, root), "supplier_value", [0.25, 0.5, 0.75], LAB4, "none", "size_bucket")


@query("supplier_value_tiers", "C54", doubles="supplier_value:2",
       sql=SUP + TIERS4 + " SELECT supplier_id, supplier_value, size_bucket FROM t4")
def supplier_value_tiers(spark, root):
    return bucketed(spark, root).select("supplier_id", "supplier_value", "size_bucket")


@query("supplier_tertiles", "C54", doubles="supplier_value:2",
       sql=SUP + """, cut AS (SELECT quantile_cont(supplier_value, [0.33, 0.67]) AS q FROM sv WHERE supplier_value > 0)
  SELECT supplier_id, supplier_value, CASE WHEN coalesce(supplier_value, 0) <= 0 THEN 'No value' WHEN supplier_value <= q[1] THEN 'Small' WHEN supplier_value <= q[2] THEN 'Medium'
    ELSE 'Large' END AS size_bucket FROM sv, cut""")
def supplier_tertiles(spark, root):
    return lift.value_tiers(by_supplier(spark, root), "supplier_value", [0.33, 0.67], ["Small", "Medium", "Large"], "No value", "size_bucket").select(
        "supplier_id", "supplier_value", "size_bucket")


def with_buckets(spark, root):
    of = materialise(bucketed(spark, root).select("supplier_id", "size_bucket"))
    return listings(spark, root).join(broadcast_if_small(of), "supplier_id")


LB = SUP + TIERS4 + ", lb AS (SELECT lst.*, size_bucket FROM lst JOIN t4 USING (supplier_id))"


@query("conditional_split", "C83", doubles="with_pct:5 without_pct:5",
       sql=LB + """ SELECT size_bucket, count(*) AS n, avg(static_api) * 100 AS with_pct, 100 - avg(static_api) * 100 AS without_pct FROM lb
  WHERE has_individual = 1 OR has_group = 1 GROUP BY 1""")
def conditional_split(spark, root):
    return lift.conditional_split(with_buckets(spark, root), (F.col("has_individual") == 1) | (F.col("has_group") == 1), "static_api", "size_bucket")


@query("ecdf_by_bucket", "C81", doubles="avg_total_tiers ecdf:7",
       sql=LB + """, c AS (SELECT size_bucket, avg_total_tiers, cume_dist() OVER (PARTITION BY size_bucket ORDER BY avg_total_tiers) AS ecdf,
   count(*) OVER (PARTITION BY size_bucket) AS n FROM lb) SELECT DISTINCT size_bucket, avg_total_tiers, ecdf FROM c WHERE n >= 50""")
def ecdf_by_bucket(spark, root):
    return lift.ecdf_by_bucket(with_buckets(spark, root), "size_bucket", "avg_total_tiers")


QW = SUP + """, cut AS (SELECT region_name, quantile_cont(supplier_value, [0.25, 0.5, 0.75]) AS q FROM sv WHERE supplier_value > 0 GROUP BY 1),
qw AS (SELECT sv.*, CASE WHEN coalesce(supplier_value, 0) <= 0 THEN 'none' WHEN supplier_value <= q[1] THEN 'Q1' WHEN supplier_value <= q[2] THEN 'Q2'
  WHEN supplier_value <= q[3] THEN 'Q3' ELSE 'Q4' END AS quartile FROM sv LEFT JOIN cut USING (region_name)),
lq AS (SELECT lst.* EXCLUDE (quartile), qw.quartile FROM lst JOIN qw USING (supplier_id))"""


@query("quartile_gap", "C82 C54", doubles="bottom_pct:5 top_pct:5 gap_pp:5",
       sql=QW + f""" SELECT region_name, feature, avg(has) FILTER (quartile = 'Q1') * 100 AS bottom_pct, avg(has) FILTER (quartile = 'Q4') * 100 AS top_pct,
  avg(has) FILTER (quartile = 'Q4') * 100 - avg(has) FILTER (quartile = 'Q1') * 100 AS gap_pp FROM {melt_sql('lq', 'region_name, quartile')} GROUP BY 1, 2""")
def quartile_gap(spark, root):
    q = lift.quartiles_within(by_supplier(spark, root), "region_name", "supplier_value").select("supplier_id", "quartile")
    return lift.quartile_gap(listings(spark, root).drop("quartile").join(q, "supplier_id"), FEATURES, "region_name")


@query("maturity_bands", "C55 A22", sql=LISTING_SQL + """ SELECT CASE WHEN x <= 180 THEN 'New (0-6 months)' WHEN x <= 540 THEN 'Developing (6-18 months)' ELSE 'Mature (18+ months)' END AS band,
  count(*) AS n FROM (SELECT DATE '2001-08-01' - first_online AS x FROM lst WHERE first_online <= DATE '2001-08-01') GROUP BY 1""")
def maturity_bands(spark, root):
    """Listings by the time since their first day online, booked or not; later ones are not there yet."""
    d = F.datediff(F.lit(AS_OF), F.col("first_online"))
    return listings(spark, root).filter(F.col("first_online") <= F.lit(AS_OF)).groupBy(maturity_band(d).alias("band")).agg(F.count(F.lit(1)).alias("n"))


LEVELS = ["Non-adopters", "Low (1-2)", "Medium (3-5)", "High (6-7)", "Power (8+)"]
LEVEL_SQL = "CASE WHEN feature_count = 0 THEN 'Non-adopters' WHEN feature_count <= 2 THEN 'Low (1-2)' WHEN feature_count <= 5 THEN 'Medium (3-5)' WHEN feature_count <= 7 THEN 'High (6-7)' ELSE 'Power (8+)' END"


@query("adoption_levels", "C56", sql=LISTING_SQL + f" SELECT {LEVEL_SQL} AS level, count(*) AS n FROM lst GROUP BY 1")
def adoption_levels(spark, root):
    return listings(spark, root).groupBy(adoption_level(F.col("feature_count")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# result columns by level
BANDS = dict(zip(["none", "low", "medium", "high", "power"], LEVELS))


@query("adoption_cross_tab", "A25 C56", doubles=" ".join(BANDS),
       sql=LISTING_SQL + f""", x AS (SELECT value_tier, {LEVEL_SQL} AS l FROM lst)
  SELECT value_tier, """ + ", ".join(f"100.0::DOUBLE * count(*) FILTER (l = '{level}') / count(*) AS {name}" for name, level in BANDS.items()) + " FROM x GROUP BY 1")
def adoption_cross_tab(spark, root):
    d = listings(spark, root).withColumn("l", adoption_level(F.col("feature_count")))
    t = lift.cross_tab(d, "value_tier", "l", LEVELS)
    return t.select("value_tier", *[F.col(f"`{level}`").alias(name) for name, level in BANDS.items()])


@query("feature_combinations", "C57", doubles="total_value:2 share_pct:5",
       sql=LISTING_SQL + """, c AS (SELECT region_name, gmv_lifetime AS v, coalesce(nullif(concat_ws(' + ', CASE WHEN has_addons = 1 THEN 'Addons' END, CASE WHEN has_group = 1 THEN 'Group' END,
   CASE WHEN has_individual = 1 THEN 'Individual' END, CASE WHEN has_scale = 1 THEN 'Scale' END), ''), 'No features') AS combination FROM lst),
g AS (SELECT region_name, combination, count(*) AS n, sum(v) AS total_value FROM c GROUP BY 1, 2)
SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY region_name) AS share_pct FROM g""")
def feature_combinations(spark, root):
    return lift.feature_combinations(listings(spark, root), NAMES, "region_name", VALUE)


@query("feature_count_distribution", "C57", doubles="pct_0:5 pct_1:5 pct_2_3:5 pct_4_plus:5 avg_features:6",
       sql=LISTING_SQL + """, c AS (SELECT region_name, has_individual + has_group + has_addons + has_scale AS k FROM lst)
  SELECT region_name, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (k = 0) / count(*) AS pct_0, 100.0::DOUBLE * count(*) FILTER (k = 1) / count(*) AS pct_1,
    100.0::DOUBLE * count(*) FILTER (k BETWEEN 2 AND 3) / count(*) AS pct_2_3, 100.0::DOUBLE * count(*) FILTER (k >= 4) / count(*) AS pct_4_plus, avg(k) AS avg_features FROM c GROUP BY 1""")
def feature_count_distribution(spark, root):
    return lift.count_distribution(listings(spark, root), list(NAMES.values()), "region_name")


DEPTH = {"configs": ("num_configs", 2), "categories": ("max_individual", 2), "addons": ("max_addons", 1)}


@query("config_depth", "C58", doubles="adoption_pct:5 mean_items:6 median_items:6 overall_mean:6",
       sql=LISTING_SQL + ", us AS (SELECT supplier_id, " + ", ".join(f"max(({c} >= {n})::INTEGER) AS u_{m}" for m, (c, n) in DEPTH.items()) +
       " FROM lst GROUP BY 1), r AS (" + " UNION ALL ".join(
           f"SELECT region_name, supplier_id, '{m}' AS metric, u_{m} AS ad, {c}::DOUBLE AS items FROM lst JOIN us USING (supplier_id)" for m, (c, _) in DEPTH.items()) + """),
b AS (SELECT region_name, metric, count(DISTINCT supplier_id) AS suppliers FROM r GROUP BY 1, 2),
g AS (SELECT region_name, metric, count(DISTINCT supplier_id) AS adopters, count(*) AS listings, sum(items) AS s, avg(items) AS mean_items, quantile_cont(items, 0.5) AS median_items
  FROM r WHERE ad = 1 GROUP BY 1, 2),
o AS (SELECT *, sum(s) OVER (PARTITION BY metric) / sum(listings) OVER (PARTITION BY metric) AS overall_mean FROM b JOIN g USING (region_name, metric))
SELECT region_name, metric, suppliers, adopters, 100.0::DOUBLE * adopters / suppliers AS adoption_pct, listings, mean_items, median_items, overall_mean,
  CASE WHEN overall_mean < 2 THEN 'SHALLOW' WHEN overall_mean < 4 THEN 'MODERATE' ELSE 'DEEP' END AS depth FROM o""")
def config_depth(spark, root):
    return lift.config_depth(listings(spark, root), DEPTH, "region_name")


@query("market_outliers", "C59", doubles="adoption_pct:5 cohort_pct:5 gap_pp:5",
       sql=LISTING_SQL + """, g AS (SELECT country_name, count(*) AS n, sum(has_addons) AS s FROM lst GROUP BY 1),
h AS (SELECT *, 100.0::DOUBLE * sum(s) OVER () / sum(n) OVER () AS cohort_pct FROM g)
SELECT country_name, n, 100.0::DOUBLE * s / n AS adoption_pct, cohort_pct, 100.0::DOUBLE * s / n - cohort_pct AS gap_pp FROM h WHERE n >= 30 ORDER BY n DESC, country_name LIMIT 15""")
def market_outliers(spark, root):
    return lift.market_outliers(listings(spark, root), "has_addons", "country_name", 30, 15)


@query("supplier_segmentation", "C61", doubles="total_value:2 scale_adoption:6 avg_features:6 scale_opportunity:3 addon_opportunity:3 total_opportunity:3",
       sql=LISTING_SQL + """, g AS (SELECT supplier_id, count(*) AS listings, sum(coalesce(gmv_lifetime, 0)) AS total_value, avg(has_scale) AS scale_adoption, avg(feature_count) AS avg_features,
   sum(scale_uplift) AS scale_opportunity, sum(addon_uplift) AS addon_opportunity FROM lst GROUP BY 1)
SELECT *, scale_opportunity + addon_opportunity AS total_opportunity, CASE WHEN total_value >= 100000 AND avg_features < 2 THEN 'VIP - Low Adoption'
  WHEN total_value >= 50000 AND scale_adoption < 0.5 THEN 'High Value - Scale Opportunity' WHEN listings >= 10 AND avg_features < 1.5 THEN 'Portfolio - Enable Features' ELSE 'Standard' END AS segment_label
FROM g WHERE listings >= 3""")
def supplier_segmentation(spark, root):
    return lift.supplier_segmentation(listings(spark, root), VALUE)


@query("concentration_curve", "C72", doubles="supplier_value:2 entity_share:7 value_share:7",
       sql=SUP + """ SELECT supplier_id, supplier_value, row_number() OVER (ORDER BY supplier_value DESC, supplier_id) / count(*) OVER () AS entity_share,
  sum(supplier_value) OVER (ORDER BY supplier_value DESC, supplier_id ROWS UNBOUNDED PRECEDING) / sum(supplier_value) OVER () AS value_share FROM sv""")
def concentration_curve(spark, root):
    return ranking.concentration_curve(by_supplier(spark, root).select("supplier_id", "supplier_value"), "supplier_id", "supplier_value")


@query("supplier_size_bands", "C73", doubles="total_value:2 median_per_listing:6",
       sql=LISTING_SQL + """, a AS (SELECT supplier_id, count(*) AS listings, sum(gmv_lifetime) AS supplier_value FROM lst GROUP BY 1),
b AS (SELECT *, CASE WHEN listings <= 1 THEN '1' WHEN listings <= 3 THEN '2-3' WHEN listings <= 7 THEN '4-7' WHEN listings <= 15 THEN '8-15' ELSE '16+' END AS band FROM a)
SELECT band, count(*) AS suppliers, CAST(sum(listings) AS BIGINT) AS listings, sum(supplier_value) AS total_value, quantile_cont(supplier_value / listings, 0.5) AS median_per_listing FROM b GROUP BY 1""")
def supplier_size_bands(spark, root):
    a = listings(spark, root).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("listings"), F.sum(VALUE).alias("supplier_value"))
    return lift.size_bands(a)


@query("feature_count_gradient", "C77", doubles="total_value:2 avg_value:4 avg_avg_booking_value:4 avg_bookings_l12m:6",
       sql=SOLD + """ SELECT feature_count, count(*) AS n, sum(gmv_lifetime) AS total_value, avg(gmv_lifetime) AS avg_value, avg(avg_booking_value) AS avg_avg_booking_value,
  avg(bookings_l12m) AS avg_bookings_l12m FROM sold GROUP BY 1""")
def feature_count_gradient(spark, root):
    return lift.feature_count_gradient(sold(spark, root), "feature_count", VALUE, ["avg_booking_value", "bookings_l12m"])


@query("market_summary", "C78", doubles="total_value:2 " + " ".join(f"adoption_{f}" for f in FEATURES) + " total_scale_uplift:3 total_addon_uplift:3",
       sql=LISTING_SQL + """ SELECT country_name, count(*) AS listings, count(DISTINCT supplier_id) AS suppliers, sum(gmv_lifetime) AS total_value,
  """ + ", ".join(f"avg({f}) AS adoption_{f}" for f in FEATURES) + """, sum(scale_uplift) AS total_scale_uplift, sum(addon_uplift) AS total_addon_uplift FROM lst GROUP BY 1""")
def market_summary(spark, root):
    return lift.market_summary(listings(spark, root), "country_name", FEATURES, VALUE, ["scale_uplift", "addon_uplift"])


def summary_sections():
    c = F.col
    return {"Pricing": {"Individual": c("has_individual") == 1, "Group": c("has_group") == 1, "Add-ons": c("has_addons") == 1},
            "Operations": {"Cutoff": c("has_cutoff") == 1, "Capacity": c("has_capacity") == 1}}


@query("feature_summary_report", "U2", doubles="pct:5",
       sql=LISTING_SQL + " " + " UNION ALL ".join(
           f"SELECT '{s}' AS section, '{m}' AS metric, count(*) FILTER ({c} = 1) AS value, 100.0::DOUBLE * count(*) FILTER ({c} = 1) / count(*) AS pct FROM lst"
           for s, m, c in (("Pricing", "Individual", "has_individual"), ("Pricing", "Group", "has_group"), ("Pricing", "Add-ons", "has_addons"),
                           ("Operations", "Cutoff", "has_cutoff"), ("Operations", "Capacity", "has_capacity"))))
def feature_summary_report(spark, root):
    return lift.metric_union(listings(spark, root), summary_sections())
