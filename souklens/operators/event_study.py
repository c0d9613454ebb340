"""Before/after metrics around an event, by country and window or week."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.labels import not_in_or_null
from souklens.functions.periods import (EventWindows, Window2, explode_windows, horizon_bucket, label_period_window,
                                        label_periods, with_week_index, within_months)
from souklens.functions.skew import broadcast_if_small
from souklens.functions.ratios import (capped_ratio, count_if, distinct_if, flag, pct_change, ratio, share_pct,
                                       sum_if, weighted_mean)

WINDOW_KEYS = ["country_name", "period_window"]
WEEK_KEYS = ["country_name", "period", "phase", "week_start", "week_index"]
WINDOWS = ["PRE_LY", "POST_LY", "PRE_CY", "POST_CY"]   # fixed values


def by_window(df: DataFrame, day: str, w: EventWindows) -> DataFrame:
    return label_period_window(df, day, w)


def by_week(df: DataFrame, day: str, w: EventWindows) -> DataFrame:
    return with_week_index(label_periods(df, day, w), day)


def with_status(bookings: DataFrame, status: DataFrame, keep: list[str]) -> DataFrame:
    """Equi join on the status code; a missing code means -1. Only listed names are kept.

    A status list is a handful of rows; shuffling bookings by status would be pure skew.
    """
    return (bookings.withColumn("status_id", F.coalesce("status_id", F.lit(-1)))
            .join(broadcast_if_small(status.filter(F.col("status_name").isin(keep)), limit=1000), "status_id"))


def booking_metrics(labelled: DataFrame, keys: list[str]) -> DataFrame:
    n = F.countDistinct("booking_id")
    gmv, nr, tickets = F.sum("gmv"), F.sum("nr"), F.sum("tickets")
    return labelled.groupBy(*keys).agg(
        n.alias("bookings"), F.countDistinct("activity_id").alias("total_activities"),
        F.countDistinct("supplier_id").alias("total_suppliers"), tickets.alias("tickets"), nr.alias("nr"),
        gmv.alias("gmv"), F.sum("supplier_share").alias("supplier_share_revenue"),
        ratio(gmv, tickets).alias("avg_gmv_per_ticket"), ratio(nr, tickets).alias("avg_nr_per_ticket"),
        ratio(gmv, n).alias("avg_gmv_per_booking"), ratio(nr, n).alias("avg_nr_per_booking"))


def cancellation_rates(labelled: DataFrame, keys: list[str], months: list[int], revenue: bool = True) -> DataFrame:
    """Cancelled share of bookings and of revenue, overall and by nested travel horizon.

    Bookings are first reduced to one row per booking and key, so the many conditional
    distinct counts become plain sums instead of one row expansion per count.
    """
    per = labelled.groupBy(*keys, "booking_id").agg(
        F.max(flag(F.col("status_id") == 2)).alias("c"),
        F.sum("nr").alias("nr"), F.sum(F.when(F.col("status_id") == 2, F.col("nr")).otherwise(0.0)).alias("c_nr"),
        *[e for m in months for h in [within_months(F.col("travel_date"), F.col("event_start"), m)] for e in (
            F.max(flag(h)).alias(f"b{m}"), F.max(flag(h & (F.col("status_id") == 2))).alias(f"c{m}"),
            F.sum(F.when(h, F.col("nr")).otherwise(0.0)).alias(f"nr{m}"),
            F.sum(F.when(h & (F.col("status_id") == 2), F.col("nr")).otherwise(0.0)).alias(f"cnr{m}"))])
    aggs = [F.count(F.lit(1)).alias("total_bookings"), F.sum("c").alias("cancelled_bookings"),
            ratio(F.sum("c"), F.count(F.lit(1))).alias("cancellation_rate"),
            F.sum("nr").alias("total_nr"), F.sum("c_nr").alias("cancelled_nr"),
            ratio(F.sum("c_nr"), F.sum("nr")).alias("cancellation_rate_nr")]
    for m in months:
        aggs += [F.sum(f"b{m}").alias(f"bookings_{m}m"), F.sum(f"c{m}").alias(f"cancelled_bookings_{m}m"),
                 ratio(F.sum(f"c{m}"), F.sum(f"b{m}")).alias(f"cancellation_rate_{m}m")]
        if revenue:
            aggs += [F.sum(f"nr{m}").alias(f"nr_{m}m"), F.sum(f"cnr{m}").alias(f"cancelled_nr_{m}m"),
                     ratio(F.sum(f"cnr{m}"), F.sum(f"nr{m}")).alias(f"cancellation_rate_nr_{m}m")]
    counts = labelled.groupBy(*keys).agg(F.countDistinct("activity_id").alias("total_activities"),
                                         F.countDistinct("supplier_id").alias("total_suppliers"))
    return per.groupBy(*keys).agg(*aggs).join(counts, keys)


def traffic_funnel(labelled: DataFrame, keys: list[str]) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return labelled.filter(F.col("activity_id").isNotNull()).groupBy(*keys).agg(
        s("bookings").alias("bookings"), s("clicks").alias("clicks"), s("customers").alias("customers"),
        s("visitors").alias("visitors"), s("impressions").alias("impressions"),
        s("add_to_cart_visitors").alias("add_to_cart_visitors"),
        s("unavailability_visitors").alias("unavailability_visitors"),
        s("stars").alias("total_stars"), s("reviews").alias("total_reviews"),
        F.countDistinct("activity_id").alias("total_activities"),
        F.countDistinct("supplier_id").alias("total_suppliers"),
        ratio(s("customers"), s("visitors")).alias("conversion_rate"),
        capped_ratio(F.sum("clicks"), F.sum("impressions")).alias("click_through_rate"),
        capped_ratio(F.sum("add_to_cart_visitors"), F.sum("visitors")).alias("add_to_cart_rate"),
        capped_ratio(F.sum("unavailability_visitors"), F.sum("visitors")).alias("unavailability_issue_rate"),
        ratio(s("stars"), s("reviews")).alias("avg_star_rating"),
        ratio(F.sum("bookings"), F.sum("clicks")).alias("bookings_per_click"),
        ratio(F.sum("impressions"), F.countDistinct("activity_id")).alias("avg_impressions_per_activity"))


def session_funnel(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Visitor rates from session arrays; conversion counts visitors with a purchase.

    Visitors are reduced to one row per key first; a missing array counts as empty.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    per = labelled.groupBy(*keys, "visitor_id").agg(
        F.max(flag(F.col("detail_views") > 0)).alias("v"), F.max(flag(size("checked_ids") > 0)).alias("k"),
        F.max(flag(size("cart_ids") > 0)).alias("a"), F.max(flag(F.col("purchased"))).alias("p"))
    n = F.count(F.lit(1))
    return per.groupBy(*keys).agg(
        n.alias("total_visitors"), F.sum("v").alias("detail_view_visitors"),
        ratio(F.sum("k"), F.sum("v")).alias("check_availability_rate"),
        ratio(F.sum("a"), F.sum("v")).alias("add_to_cart_rate"),
        F.sum("p").alias("customers"), ratio(F.sum("p"), n).alias("conversion_rate"))


def supply_availability(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Listed and online activities and suppliers, and mean days online per week.

    Needs ``week_start``. Several log rows of a day count once. The days-online means are
    taken over entity-weeks, so an entity with many log rows has no extra weight.
    """
    wk = list(dict.fromkeys(keys + ["week_start"]))
    state = labelled.groupBy(*wk, "supplier_id", "activity_id", "day").agg(
        F.max(F.col("is_online").cast("int")).alias("on"))
    act = state.groupBy(*wk, "activity_id").agg(F.sum("on").alias("d"))
    sup = (state.groupBy(*wk, "supplier_id", "day").agg(F.max("on").alias("on"))
           .groupBy(*wk, "supplier_id").agg(F.sum("on").alias("d")))
    on = F.col("d") > 0

    def side(df, key, name):
        d = df.groupBy(*keys, key).agg(F.sum("d").alias("sd"), F.count(F.lit(1)).alias("n"),
                                       F.sum(flag(on)).alias("on_weeks"))
        return d.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"total_{name}s"), count_if(F.col("sd") > 0).alias(f"active_{name}s"),
            ratio(count_if(F.col("sd") > 0), F.count(F.lit(1))).alias(f"share_active_{name}s"),
            ratio(F.sum("sd"), F.sum("n")).alias(f"avg_days_online_per_{name}_week"),
            ratio(F.sum("sd"), F.sum("on_weeks")).alias(f"avg_days_online_per_active_{name}_week"))

    act = act.withColumnRenamed("activity_id", "e")
    sup = sup.withColumnRenamed("supplier_id", "e")
    return side(act, "e", "activity").join(side(sup, "e", "supplier"), keys)


def activity_prices(prices: DataFrame, w: EventWindows, weekly: bool = False) -> DataFrame:
    """One mean per activity, window (or week) and travel day within a year of the event."""
    lab = by_week(prices, "snapshot_date", w) if weekly else by_window(prices, "snapshot_date", w)
    keys = WEEK_KEYS if weekly else WINDOW_KEYS
    return (lab.filter(within_months(F.col("travel_date"), F.col("event_start"), 12))
            .groupBy(*keys, "event_start", "activity_id", "supplier_id", "travel_date")
            .agg(F.avg("price_black").alias("price_black"), F.avg("price_red").alias("price_red"),
                 F.avg(F.coalesce(F.size("timeslots"), F.lit(0))).alias("slots")))


def price_levels(level: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and spread of list and paid prices and of time slots, by nested horizon."""
    med = lambda c: F.percentile_approx(c, 0.5)
    h = lambda m, c: F.when(within_months(F.col("travel_date"), F.col("event_start"), m), F.col(c))
    aggs = [F.countDistinct("supplier_id").alias("total_suppliers"),
            F.countDistinct("activity_id").alias("total_activities"),
            med("price_red").alias("median_red"), F.stddev_samp("price_red").alias("stddev_red"),
            med("price_black").alias("median_black"), F.stddev_samp("price_black").alias("stddev_black")]
    for m in (3, 6, 12):
        aggs += [med(h(m, "price_red")).alias(f"median_red_{m}m"), F.stddev_samp(h(m, "price_red")).alias(f"stddev_red_{m}m"),
                 med(h(m, "price_black")).alias(f"median_black_{m}m"), F.stddev_samp(h(m, "price_black")).alias(f"stddev_black_{m}m"),
                 med(h(m, "slots")).alias(f"median_slots_{m}m"), F.stddev_samp(h(m, "slots")).alias(f"stddev_slots_{m}m")]
    return level.groupBy(*keys).agg(*aggs)


def window_pivot(level: DataFrame, months: list[int]) -> DataFrame:
    """Balanced panel: activities seen in all four windows, one mean per window and horizon."""
    h = lambda m: F.when(within_months(F.col("travel_date"), F.col("event_start"), m), F.col("price_red"))
    aggs = [F.avg(F.when(F.col("period_window") == pw, h(m))).alias(f"{pw.lower()}_{m}m")
            for m in months for pw in WINDOWS]
    seen = [F.max(flag(F.col("period_window") == pw)) for pw in WINDOWS]
    return (level.groupBy("activity_id", "supplier_id", "country_name")
            .agg(*aggs, reduce(lambda a, b: a + b, seen).alias("_seen")).filter("_seen = 4").drop("_seen"))


def balanced_panel_medians(level: DataFrame, months: list[int]) -> DataFrame:
    """Median over activities of their own mean, only for activities seen in all windows."""
    h = lambda m, c: F.when(within_months(F.col("travel_date"), F.col("event_start"), m), F.col(c))
    panel = window_pivot(level, months[:1]).select("activity_id").distinct()
    per = level.join(panel, "activity_id", "left_semi").groupBy(*WINDOW_KEYS, "activity_id").agg(
        *[F.avg(h(m, c)).alias(f"{n}_{m}m") for m in months for c, n in (("price_red", "price"), ("slots", "slots"))])
    return per.groupBy(*WINDOW_KEYS).agg(*[
        F.percentile_approx(f"{n}_{m}m", 0.5).alias(f"median_{n}_{m}m") for m in months for n in ("price", "slots")])


def price_change_did(level: DataFrame, months: list[int], threshold: float = 0.01) -> DataFrame:
    """Share of activities and suppliers whose price moved by more than ``threshold``.

    LY rows use the plain change of last year, CY rows the change net of last year's.
    """
    p = window_pivot(level, months)
    out = None
    for year in ("LY", "CY"):
        cols = []
        for m in months:
            pre_l, post_l, pre_c, post_c = (F.col(f"{w.lower()}_{m}m") for w in WINDOWS)
            change = ((post_l - pre_l) / F.nullif(pre_l, F.lit(0)) if year == "LY"
                      else ((post_c - pre_c) - (post_l - pre_l)) / F.nullif(pre_c, F.lit(0)))
            cols.append(flag(F.abs(change) > threshold).alias(f"m{m}"))
        one = p.select(F.lit(year).alias("year"), "country_name", "activity_id", "supplier_id", *cols)
        out = one if out is None else out.unionByName(one)
    n_s, n_a = F.countDistinct("supplier_id"), F.countDistinct("activity_id")
    aggs = [n_s.alias("total_suppliers"), n_a.alias("total_activities")]
    for m in months:
        s, a = distinct_if(F.col(f"m{m}") == 1, F.col("supplier_id")), F.sum(f"m{m}")
        aggs += [s.alias(f"suppliers_changed_{m}m"), a.alias(f"activities_changed_{m}m"),
                 share_pct(s, n_s).alias(f"pct_suppliers_changed_{m}m"),
                 share_pct(a, n_a).alias(f"pct_activities_changed_{m}m")]
    return out.groupBy("year", "country_name").agg(*aggs)


def price_index_by_window(prices: DataFrame, windows: list[Window2]) -> DataFrame:
    """Median of weekly medians per window, currency and disjoint travel horizon, wide."""
    keys = ["period", "country_name", "window", "currency"]
    lab = (explode_windows(prices.filter(F.col("price_red") > 0), "snapshot_date", windows)
           .withColumn("horizon", horizon_bucket(F.col("travel_date"), F.col("anchor")))
           .filter(F.col("horizon").isNotNull()))
    med = lambda c: F.percentile_approx(c, 0.5)
    weekly = lab.groupBy(*keys, "horizon", F.date_trunc("week", "snapshot_date").alias("week")).agg(
        med("price_red").alias("red"), med("price_black").alias("black"),
        med(F.coalesce(F.size("timeslots"), F.lit(0))).alias("slots"))
    level = weekly.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("weeks"), med("red").alias("red"), med("black").alias("black"), med("slots").alias("slots"))
    return level.groupBy(*keys).agg(*[
        F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h.lower()}")
        for h in ("3M", "6M", "12M") for c in ("weeks", "red", "black", "slots")])


def latest_status(log: DataFrame, keys: list[str], day: str, tie: str, cols: list[str]) -> DataFrame:
    """Last log row per key and week.

    The maximum of a struct is combined before the shuffle, so a key with many rows is
    never sorted in one task.
    """
    last = F.max(F.struct(day, tie, *cols)).alias("_last")
    return (log.groupBy(*keys, F.to_date(F.date_trunc("week", day)).alias("status_week")).agg(last)
            .select(*keys, "status_week", *[F.col(f"_last.{c}").alias(c) for c in cols]))


def parity_rows(comp: DataFrame, status: DataFrame, rivals: list[str], bad: list[str]) -> DataFrame:
    """Rows that count for price parity: active, priced, at least one usable competitor,
    and no competitor marked inaccurate on the day or at the end of the week."""
    any_valid = reduce(lambda a, b: a | b, (F.col(f"{r}_valid") for r in rivals))
    ok_day = reduce(lambda a, b: a & b, (not_in_or_null(F.col(f"{r}_accuracy"), ["Inaccurate"]) for r in rivals))
    ok_week = reduce(lambda a, b: a & b, (not_in_or_null(F.col(f"{r}_status"), bad) for r in rivals))
    c = (comp.filter((F.col("own_price") != 0) | F.col("own_price").isNull())
         .filter((F.col("own_status") == "active") & any_valid & ok_day)
         .withColumn("status_week", F.to_date(F.date_trunc("week", "snapshot_date"))))
    return c.join(status, ["activity_id", "supplier_id", "status_week"], "left").filter(ok_week)


def price_parity(labelled: DataFrame, keys: list[str], rivals: list[str]) -> DataFrame:
    """Impression-weighted share of meet or beat, per competitor and overall."""
    w = F.col("impressions")
    return labelled.groupBy(*keys).agg(
        F.countDistinct("activity_id").alias("total_activities"),
        F.countDistinct("supplier_id").alias("total_suppliers"),
        *[ratio(F.sum((F.col(f"{r}_meet") + F.col(f"{r}_beat")) * w),
                F.sum(F.when(F.col(f"{r}_price").isNotNull(), w).otherwise(0.0))).alias(f"{r}_parity_rate")
          for r in rivals],
        ratio(F.sum(F.when(F.col("overall").isin("meet", "beat"), w).otherwise(0.0)), F.sum(w)).alias("overall_parity_rate"),
        F.sum(w).alias("total_impressions"))


def melt(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to ``(metric, value)`` rows with double values; NULL values stay."""
    return (df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(keys, metrics, "metric", "value"))


def did_pct(summary: DataFrame, unit: list[str], metrics: list[str]) -> DataFrame:
    """Relative change of CY minus that of LY, per unit and metric; zero bases give NULL."""
    v = lambda pw: F.avg(F.when(F.col("period_window") == pw, F.col("value")))
    g = melt(summary, unit + ["period_window"], metrics).groupBy(*unit, "metric").agg(
        *[v(pw).alias(pw.lower()) for pw in WINDOWS])
    cy = pct_change(F.col("post_cy"), F.col("pre_cy"))
    ly = pct_change(F.col("post_ly"), F.col("pre_ly"))
    return g.select(*unit, "metric", "pre_cy", "post_cy", cy.alias("cy_change"), ly.alias("ly_change"),
                    (cy - ly).alias("did"))


def did_multi_comparison(summary: DataFrame, unit: list[str], metrics: dict[str, str],
                         pairs: list[tuple[str, str]]) -> DataFrame:
    """DiD for several window pairs; ``metrics`` maps a metric to its group.

    Needs ``period`` and ``window``. A unit lacking a window stays, with ``complete`` false
    and no value.
    """
    names = sorted({w for p in pairs for w in p})
    g = melt(summary, unit + ["period", "window"], list(metrics)).groupBy(*unit, "metric").agg(*[
        F.max(F.when((F.col("period") == p) & (F.col("window") == w), F.col("value"))).alias(f"{p}_{w}")
        for p in ("CY", "LY") for w in names])
    rel = lambda p, a, b: (F.col(f"{p}_{b}") - F.col(f"{p}_{a}")) / F.nullif(F.abs(f"{p}_{a}"), F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a} to {b}").alias("comparison"),
                                        (rel("CY", a, b) - rel("LY", a, b)).alias("did")) for a, b in pairs]))
    seen = reduce(lambda a, b: a & b, (F.col(f"{p}_{w}").isNotNull() for p in ("CY", "LY") for w in names))
    group = None
    for m, name in metrics.items():
        group = F.when(F.col("metric") == m, name) if group is None else group.when(F.col("metric") == m, name)
    return (g.withColumns({"_r": rows, "complete": seen, "metric_group": group})
            .select(*unit, "metric_group", "metric", "_r.comparison", "_r.did", "complete"))


def require_windows(summary: DataFrame, periods: list[str], windows: list[str]) -> None:
    """Raise when a window is missing entirely; reads only the distinct labels."""
    have = {(r[0], r[1]) for r in summary.select("period", "window").distinct().collect()}
    missing = sorted((p, w) for p in periods for w in windows if (p, w) not in have)
    if missing:
        raise ValueError(f"missing windows: {missing}")


def weekly_did_line(weekly: DataFrame, unit: list[str], metric: str) -> DataFrame:
    """Per week offset: CY relative to its pre mean minus LY relative to its pre mean."""
    at = lambda p: F.max(F.when(F.col("period") == p, F.col(metric)))
    g = weekly.groupBy(*unit, "week_index").agg(
        at("CY").alias("cy"), at("LY").alias("ly"),
        F.max(F.when(F.col("period") == "CY", F.col("phase"))).alias("phase")).filter("cy IS NOT NULL AND ly IS NOT NULL")
    w = Window.partitionBy(*unit)
    base = lambda c: F.avg(F.when(F.col("phase") == "Pre", F.col(c))).over(w)
    return g.select(*unit, "week_index", "phase", (ratio(F.col("cy"), base("cy")) - ratio(F.col("ly"), base("ly"))).alias("did"))


def executive_summary(parts: list[tuple[DataFrame, dict[str, str]]], unit: list[str]) -> DataFrame:
    """One line per metric and unit: CY pre, post, change and DiD, from several summaries."""
    out = None
    for df, labels in parts:
        d = did_pct(df, unit, list(labels))
        name = None
        for m, label in labels.items():
            name = F.when(F.col("metric") == m, label) if name is None else name.when(F.col("metric") == m, label)
        d = d.withColumn("metric", name).select(*unit, "metric", "pre_cy", "post_cy", "cy_change", "did")
        out = d if out is None else out.unionByName(d)
    return out
