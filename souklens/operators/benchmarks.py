"""Price benchmarks at nested levels and outlier audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.ordering import percent_rank_of
from souklens.functions.quantiles import exact_quantiles
from souklens.functions.ratios import flag, ratio
from souklens.functions.skew import broadcast_if_small, join_per_key
from souklens.functions.storage import materialise

HOT_PARENT = 1_000_000   # options of one activity up to which windows of one task hold its facts
TITLE_PREFIX = 50   # characters in which similar titles agree
PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Level:
    name: str
    keys: tuple[str, ...]
    min_activities: int


# fixed values: benchmark levels with their minimum number of activities
LEVELS = [Level("global", (), 0), Level("location", ("location",), 10), Level("activity", ("activity_type",), 10),
          Level("loc_act", ("location", "activity_type"), 5),
          Level("loc_act_cat", ("location", "activity_type", "category"), 3)]
CATEGORY_LEVELS = [Level("global", (), 0), Level("location", ("location",), 10), Level("category", ("category",), 10),
                   Level("loc_cat", ("location", "category"), 5)]


def hierarchical_benchmarks(options: DataFrame, levels: list[Level], price: str = "price_eur") -> DataFrame:
    """Quantiles, mean and spread of prices per level, long form.

    Mean, spread and quantiles are taken level by level from the narrow rows, so no row is repeated before
    a shuffle. Activities are counted for all levels at once where the rows of an activity lie together.
    Groups below the level's minimum number of activities are left out.
    """
    dims = sorted({k for lv in levels for k in lv.keys})
    pick = F.explode(F.array(*[F.struct(F.lit(lv.name).alias("level"), *[
        (F.col(d) if d in lv.keys else F.lit(None).cast("string")).alias(d) for d in dims]) for lv in levels]))
    rows = options.select(*dims, F.col(price).alias("_p"))
    placed = options.select(*dims, "activity_id").repartition("activity_id").select(pick.alias("_l"), "activity_id").select("_l.*", "activity_id")
    sizes = materialise(placed.distinct().groupBy("level", *dims).agg(F.count(F.lit(1)).alias("n_activities")))
    out = None
    for lv in levels:
        keys = list(lv.keys)
        stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_prices"), F.avg("_p").alias("avg_price"), F.stddev_samp("_p").alias("stddev_price"))
        enough = sizes.filter((F.col("level") == lv.name) & (F.col("n_activities") >= lv.min_activities)).select(*keys, "n_activities")
        one = _same_group(_same_group(stats, enough, keys), exact_quantiles(rows, "_p", PROBS, keys), keys)
        one = one.select(F.lit(lv.name).alias("level"), *[(F.col(d) if d in keys else F.lit(None).cast("string")).alias(d) for d in dims],
                         "n_prices", "avg_price", "stddev_price", "n_activities", *PROBS)
        out = one if out is None else out.unionByName(one)
    return out


def _same_group(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables with one row per group side by side; NULL keys match."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (left.join(r, cond) if keys else left.crossJoin(r)).drop(*[f"_k_{k}" for k in keys])


def attach_benchmarks(options: DataFrame, bench: DataFrame, levels: list[Level], cols: tuple[str, ...] = ("p50", "p95")) -> DataFrame:
    """Adds ``<level>_<col>``; options outside any benchmarked group keep NULL.

    A benchmark table has one row per group and is joined by equality; the single global
    row is joined on a constant key.
    """
    out = options
    for lv in levels:
        b = bench.filter(F.col("level") == lv.name).select(*lv.keys, *[F.col(c).alias(f"{lv.name}_{c}") for c in cols])
        if lv.keys:
            out = out.join(broadcast_if_small(b), list(lv.keys), "left")
        else:
            out = (out.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one", "left").drop("_one"))
    return out


def _pct_above(price: Column, ref: Column) -> Column:
    return F.floor(F.lit(100.0) * (price / ref - 1))


def price_outliers(options: DataFrame, order: list[tuple[str, int]], factor: float = 1.0) -> DataFrame:
    """Options above the P95 of the most specific level exceeded; ``order`` gives (level, severity)."""
    price = F.col("price_eur")
    hit = lambda lv: price > F.col(f"{lv}_p95") * factor
    sev = level = ref = None
    for lv, s in order:
        sev = F.when(hit(lv), s) if sev is None else sev.when(hit(lv), s)
        level = F.when(hit(lv), lv) if level is None else level.when(hit(lv), lv)
        ref = F.when(hit(lv), F.col(f"{lv}_p95")) if ref is None else ref.when(hit(lv), F.col(f"{lv}_p95"))
    out = options.withColumns({"severity": sev.cast("int"), "exceeded_level": level, "_ref": ref}).filter("severity IS NOT NULL")
    text = F.concat(F.lit("Price is "), _pct_above(price, F.col("_ref")).cast("string"), F.lit("% above P95 of "), F.col("exceeded_level"))
    return out.withColumns({
        "issue": F.lit("HIGH_PRICE"), "description": text,
        "benchmark_p50": F.coalesce(*[F.col(f"{lv}_p50") for lv, _ in order]),
        "benchmark_p95": F.coalesce(*[F.col(f"{lv}_p95") for lv, _ in order])}).drop("_ref")


def parent_stats(options: DataFrame) -> DataFrame:
    p = F.col("price_eur")
    return options.groupBy("activity_id").agg(
        F.countDistinct("option_id").alias("num_options"), F.countDistinct(p).alias("num_prices"),
        F.min(p).alias("parent_min"), F.max(p).alias("parent_max"), F.avg(p).alias("parent_avg"),
        F.coalesce(ratio(F.stddev_samp(p), F.avg(p)), F.lit(0.0)).alias("price_cv"),
        F.coalesce(ratio(F.max(p) - F.min(p), F.min(p)), F.lit(0.0)).alias("spread_ratio"),
        F.count(F.lit(1)).alias("parent_rows"))


def title_stats(options: DataFrame) -> DataFrame:
    p = F.col("price_eur")
    return options.groupBy("activity_id", "option_title").agg(
        F.countDistinct("pricing_id").alias("title_configs"), F.countDistinct(p).alias("title_prices"),
        F.min(p).alias("title_min"), F.max(p).alias("title_max"), F.count(F.lit(1)).alias("title_rows"))


def _largest_gap() -> Column:
    """Relative gap to the lowest or highest price of another option, from the two extremes on either side."""
    low = F.when(F.col("option_id") == F.col("lo1.option_id"), F.col("lo2")).otherwise(F.col("lo1.lo"))
    high = F.when(F.col("option_id") == F.col("hi1.option_id"), F.col("hi2")).otherwise(F.col("hi1.hi"))
    p = F.col("price_eur")
    gap = lambda other: F.abs(p - other) / F.nullif(F.least(p, other), F.lit(0.0))
    return F.greatest(gap(low), gap(high))


def similar_title_gap(options: DataFrame, prefix: int = TITLE_PREFIX, hot: int = HOT_PARENT) -> DataFrame:
    """Per option: largest relative price gap to another option of the same parent whose
    title starts with the same characters.

    The gap to any other price is largest at the lowest or the highest one, so each title
    group only needs the two extreme options on either side; no pairs are formed. Options without an
    activity or a title are left out. Activities of up to ``hot`` options take one exchange of the columns that
    are read; larger ones are joined with hot keys spread. Calling it costs the count of options by activity.
    """
    t = F.substring("option_title", 1, prefix)
    o = options.filter(F.col("activity_id").isNotNull() & t.isNotNull()).select("activity_id", "option_id", "pricing_id", "price_eur", t.alias("_t"))
    large = _large_activities(o, hot)
    if large.isEmpty():
        return _title_gap_in_windows(o)
    large = broadcast_if_small(large.withColumnRenamed("_large", "activity_id"))
    return (_title_gap_in_windows(o.join(large, "activity_id", "left_anti"))
            .unionByName(_title_gap_joined(materialise(o.join(large, "activity_id", "left_semi")))))


def _title_gap_in_windows(o: DataFrame) -> DataFrame:
    """Options dealt out by title group once and sorted once: the windows of an option lie inside those of its group."""
    c, p, keys = F.col, F.col("price_eur"), ["activity_id", "_t"]
    option, alike = Window.partitionBy(*keys, "option_id"), Window.partitionBy(*keys)
    o = o.repartition(*keys).withColumns({"lo": F.min(p).over(option), "hi": F.max(p).over(option)})
    o = o.withColumns({"lo1": F.min(F.struct("lo", "option_id")).over(alike), "hi1": F.max(F.struct("hi", "option_id")).over(alike)})
    o = o.withColumns({"lo2": F.min(F.when(c("option_id") != c("lo1.option_id"), c("lo"))).over(alike),
                       "hi2": F.max(F.when(c("option_id") != c("hi1.option_id"), c("hi"))).over(alike)})
    return o.select("activity_id", "option_id", "pricing_id", _largest_gap().alias("similar_gap"))


def _title_gap_joined(o: DataFrame) -> DataFrame:
    """The same for title groups of any size."""
    keys = ["activity_id", "_t"]
    per = o.groupBy(*keys, "option_id").agg(F.min("price_eur").alias("lo"), F.max("price_eur").alias("hi"))
    first = per.groupBy(*keys).agg(F.min(F.struct("lo", "option_id")).alias("lo1"), F.max(F.struct("hi", "option_id")).alias("hi1"),
                                   F.count(F.lit(1)).alias("n"))
    both = join_per_key(per, first, keys, "n", ["option_id"])
    second = both.groupBy(*keys).agg(
        F.min(F.when(F.col("option_id") != F.col("lo1.option_id"), F.col("lo"))).alias("lo2"),
        F.max(F.when(F.col("option_id") != F.col("hi1.option_id"), F.col("hi"))).alias("hi2"))
    sizes = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    j = join_per_key(o, first.drop("n").join(second, keys).join(sizes, keys), keys, "_rows", ["option_id"])
    return j.select("activity_id", "option_id", "pricing_id", _largest_gap().alias("similar_gap"))


def _parent_facts_in_windows(options: DataFrame) -> DataFrame:
    """Rank, parent, title and similar-title facts as windows under one partitioning by activity.

    Every window's keys begin with the activity, so one exchange serves them all, and two orders do: by price in the activity,
    and by prefix, title and price. Distinct prices are the largest dense rank, less one if NULL is among them; distinct ids
    are the size of a set. Options without an activity or a title have no similar ones.
    """
    c, p, keys = F.col, F.col("price_eur"), ["activity_id"]
    parent, title = Window.partitionBy(*keys), Window.partitionBy(*keys, "_t", "option_title")
    # whole groups; the order is that of the titles inside them
    alike = Window.partitionBy(*keys, "_t").orderBy("option_title", p).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    count = lambda rank, w: (F.max(rank).over(w) - F.max(flag(p.isNull())).over(w)).cast("long")
    ids = lambda col, w: F.size(F.collect_set(col).over(w)).cast("long")
    mean, lowest, highest = F.avg(p).over(parent), F.min(p).over(parent), F.max(p).over(parent)
    o = options.withColumns({"pr": F.percent_rank().over(parent.orderBy(p)), "_dp": F.dense_rank().over(parent.orderBy(p))})
    o = o.withColumns({"num_options": ids("option_id", parent), "num_prices": count("_dp", parent), "parent_min": lowest, "parent_max": highest,
                       "parent_avg": mean, "price_cv": F.coalesce(ratio(F.stddev_samp(p).over(parent), mean), F.lit(0.0)),
                       "spread_ratio": F.coalesce(ratio(highest - lowest, lowest), F.lit(0.0))})
    o = o.withColumn("_t", F.substring("option_title", 1, TITLE_PREFIX)).withColumn("_tp", F.dense_rank().over(title.orderBy(p)))
    o = o.withColumns({"title_prices": count("_tp", title), "title_configs": ids("pricing_id", title),
                       "title_min": F.min(p).over(title), "title_max": F.max(p).over(title)})
    o = o.withColumns({"lo1": F.min(F.struct(p.alias("lo"), "option_id")).over(alike), "hi1": F.max(F.struct(p.alias("hi"), "option_id")).over(alike)})
    o = o.withColumns({"lo2": F.min(F.when(c("option_id") != c("lo1.option_id"), p)).over(alike), "hi2": F.max(F.when(c("option_id") != c("hi1.option_id"), p)).over(alike)})
    return o.withColumn("similar_gap", F.when(c("activity_id").isNotNull() & c("option_title").isNotNull(), _largest_gap()))


def _parent_facts_joined(options: DataFrame) -> DataFrame:
    """The same facts for activities of any size: aggregated, then joined back with hot keys spread."""
    o = percent_rank_of(options, "price_eur", ["activity_id"], "pr", prepared=True)
    o = join_per_key(o, parent_stats(options), ["activity_id"], "parent_rows", ["option_id"])
    o = join_per_key(o, title_stats(options), ["activity_id", "option_title"], "title_rows", ["option_id"])
    alike = options.withColumn("_t", F.substring("option_title", 1, TITLE_PREFIX))
    return o.join(_title_gap_joined(alike), ["activity_id", "option_id", "pricing_id"], "left")


def _large_activities(options: DataFrame, hot: int) -> DataFrame:
    """Activities of more than ``hot`` options, stored."""
    return materialise(options.groupBy("activity_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select(F.col("activity_id").alias("_large")))


PARENT_FACTS = ["pr", "num_options", "num_prices", "parent_min", "parent_max", "parent_avg", "price_cv", "spread_ratio",
                "title_configs", "title_prices", "title_min", "title_max", "similar_gap"]


def parent_facts(options: DataFrame, hot: int | None = HOT_PARENT) -> DataFrame:
    """Options with their facts inside the activity (``PARENT_FACTS``).

    Activities of up to ``hot`` options share one exchange; larger ones, at most (number of
    options / ``hot``), are stored and take the joined way. Calling it costs the count of
    options by activity; ``hot`` is None if it is known that none is large. Options that are dealt out by activity stay where they are.
    """
    wanted = [*options.columns, *PARENT_FACTS]
    if hot is None:
        return _parent_facts_in_windows(options).select(*wanted)
    large = _large_activities(options, hot)
    if large.isEmpty():
        return _parent_facts_in_windows(options).select(*wanted)
    same, large = F.col("activity_id").eqNullSafe(F.col("_large")), broadcast_if_small(large)
    return (_parent_facts_in_windows(options.join(large, same, "left_anti")).select(*wanted)
            .unionByName(_parent_facts_joined(materialise(options.join(large, same, "left_semi"))).select(*wanted)))


def with_parent_issue(options: DataFrame, performance: DataFrame | None = None, hot: int | None = HOT_PARENT) -> DataFrame:
    """Every option with its price problem inside the activity: ``parent_sub_type`` and ``parent_severity``, NULL if it has none.

    Ordered sub-types with a severity ladder. ``performance`` has ``option_id`` and ``bookings_l12m``; without it ``options``
    has the latter. See ``parent_facts`` for ``hot``.
    """
    o = parent_facts(options, hot)
    if performance is not None:
        o = o.join(performance.select("option_id", "bookings_l12m"), "option_id", "left")
    c, n, p = F.col, F.coalesce("bookings_l12m", F.lit(0)), F.col("price_eur")
    dup = (c("title_configs") > 1) & (c("title_prices") > 1)
    over = lambda f: p > c("parent_avg") * f
    none, few = n == 0, (n > 0) & (n <= 5)
    sim = lambda g: F.coalesce(c("similar_gap") > g, F.lit(False))
    top = lambda r, s: (c("pr") >= r) & (c("spread_ratio") > s)
    trigger = ((dup & (c("title_max") > c("title_min") * 1.2)) | (none & over(1.2)) | (few & over(1.5)) | sim(0.3)
               | ((c("num_options") > 1) & top(0.75, 0.5)))
    sub = (F.when(dup, "DUPLICATE_PRICING_CONFIGS").when(none & over(1.2), "HIGH_PRICE_NO_DEMAND")
           .when(few & over(1.5), "HIGH_PRICE_LOW_DEMAND").when(sim(0.3), "UNCLEAR_DIFFERENTIATION")
           .when(top(0.75, 0.5), "HIGH_VARIANCE_OUTLIER").otherwise("OTHER"))
    sev = (F.when(c("title_configs") >= 4, 10).when(c("title_configs") >= 3, 9).when(none & over(1.5), 10)
           .when(none & over(1.2), 9).when((n <= 5) & over(1.5), 8).when(sim(1.0), 9).when(sim(0.5), 8)
           .when(top(0.9, 1.0), 10).when(top(0.9, 0.5), 9).when(top(0.75, 1.0), 8).when(top(0.75, 0.5), 7).otherwise(5))
    return o.withColumns({"parent_sub_type": F.when(trigger, sub), "parent_severity": F.when(trigger, sev)})


def parent_issues(options: DataFrame) -> DataFrame:
    """Of the options from ``with_parent_issue`` those with a problem, as issues."""
    return options.filter("parent_severity IS NOT NULL").withColumns({
        "issue": F.lit("PARENT_VARIANCE"), "sub_type": F.col("parent_sub_type"), "severity": F.col("parent_severity")}).drop("parent_sub_type", "parent_severity")


def within_parent_issues(options: DataFrame, performance: DataFrame | None = None, hot: int = HOT_PARENT) -> DataFrame:
    """Price problems inside one activity, one row per option that has one; see ``with_parent_issue``."""
    return parent_issues(with_parent_issue(options, performance, hot))


def price_mismatch(options: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Advertised price against the cheapest applicable tier (adult, else smallest group)."""
    p, r = F.col("price_eur"), F.col("retail_eur")
    high, low = p > r * (1 + tolerance), p < r * (1 - tolerance)
    return options.filter(r.isNotNull() & (high | low)).withColumns({
        "issue": F.lit("PRICE_MISMATCH"), "severity": F.when(high, 10).otherwise(8),
        "sub_type": F.when(high, "HIGHER").otherwise("LOWER"), "price_gap_pct": 100.0 * (p - r) / r})


def parent_variance_simple(options: DataFrame, min_spread: float = 0.3) -> DataFrame:
    """Plain rule: every option of an activity whose prices spread by more than ``min_spread``."""
    s = F.col("spread_ratio")
    return (parent_facts(options).filter((F.col("num_options") > 1) & (s > min_spread))
            .withColumn("severity", F.when(s > 2.0, 10).when(s > 1.0, 8).when(s > 0.5, 6).otherwise(4)))


REPORT = ["issue", "sub_type", "severity", "supplier_id", "activity_id", "option_id", "pricing_id", "price_eur"]


def issue_report(parts: list[DataFrame], performance: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """All issues with performance attached, by issue, then by impact (missing counts as 0).

    Without ``performance`` the parts have ``gmv_l12m`` and ``bookings_l12m``. The report is stored before it is
    sorted, as a sort reads its input twice, the first time for the bounds of its ranges; not if its parts
    are ``stored``, so that reading them again is cheap.
    """
    numbers = ["gmv_l12m", "bookings_l12m"]
    out = None
    for p in parts:
        if "sub_type" not in p.columns:
            p = p.withColumn("sub_type", F.lit(None).cast("string"))
        p = p.select(*REPORT, *([] if performance is not None else numbers))
        out = p if out is None else out.unionByName(p)
    if performance is not None:
        out = out.join(performance.select("option_id", *numbers), "option_id", "left").select("option_id", *[c for c in REPORT if c != "option_id"], *numbers)
    return (out if stored else materialise(out)).orderBy(
        "issue", "sub_type", F.coalesce("gmv_l12m", F.lit(0.0)).desc(), F.coalesce("bookings_l12m", F.lit(0)).desc(),
        F.desc("severity"), "option_id", "pricing_id")
