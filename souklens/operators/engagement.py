"""Portal engagement and action funnels of suppliers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.labels import engagement_tier
from souklens.functions.ratios import count_if, distinct_if, flag, ratio, share_pct


def relevant_entities(bookings: DataFrame, online: DataFrame, as_of: date, new_days: int = 30, min_bookings: int = 1) -> DataFrame:
    """Suppliers with a relevant activity that are active sellers or newly online.

    An activity is relevant when first online within ``new_days`` or with more than
    ``min_bookings`` bookings in 365 days; the supplier needs the same at its own level.
    Nothing after ``as_of`` counts.
    """
    year = F.col("checkout_date").between(F.lit(as_of - timedelta(days=365)), F.lit(as_of))
    online = online.filter(F.col("day") <= F.lit(as_of))
    b = bookings.filter(year & F.col("status_id").isin(1, 2))
    per_act = b.groupBy("supplier_id", "line_id").agg(F.count(F.lit(1)).alias("n"))
    first = online.filter("is_online").groupBy("supplier_id", "activity_id").agg(F.min("day").alias("first_online"))
    fresh = F.col("first_online") >= F.lit(as_of - timedelta(days=new_days))
    acts = online.select("supplier_id", "activity_id").distinct()
    j = (acts.join(first, ["supplier_id", "activity_id"], "left")
         .join(per_act.withColumnRenamed("line_id", "activity_id"), ["supplier_id", "activity_id"], "left"))
    n = F.coalesce("n", F.lit(0))
    sup = j.groupBy("supplier_id").agg(
        F.sum(flag(fresh | (n > min_bookings))).alias("relevant_activities"), F.sum(n).alias("bookings_l365"),
        F.max(flag(fresh)).alias("has_new"))
    return sup.filter((F.col("relevant_activities") > 0) & ((F.col("bookings_l365") > min_bookings) | (F.col("has_new") == 1)))


def last_logins(days: DataFrame, as_of: date) -> DataFrame:
    return days.filter((F.col("logins") > 0) & (F.col("day") <= F.lit(as_of))).groupBy("supplier_id").agg(F.max("day").alias("last_login"))


def login_rates(entities: DataFrame, key: str, as_of: date, value: str | None = None) -> DataFrame:
    """Share of entities that logged in within 7, 30 and 90 days, per group; needs ``last_login``."""
    days = F.datediff(F.lit(as_of), F.col("last_login"))
    n = F.count(F.lit(1))
    aggs = [n.alias("suppliers")] + [share_pct(count_if(days <= d), n).alias(f"l{d}_pct") for d in (7, 30, 90)]
    if value:
        aggs.append(F.avg(value).alias("avg_value"))
    g = entities.groupBy(key).agg(*aggs)
    # one row per group label
    return g.withColumn("share_pct", 100.0 * F.col("suppliers") / F.sum("suppliers").over(Window.partitionBy()))


def monthly_reach(days: DataFrame, bookings: DataFrame, start: date, end: date) -> DataFrame:
    """Suppliers logging in per month and the share of that month's value they sold."""
    month = lambda c: F.to_date(F.date_trunc("month", c))
    within = lambda c: (F.col(c) >= F.lit(start)) & (F.col(c) < F.lit(end))
    log = (days.filter(within("day") & F.col("is_active")).groupBy(month("day").alias("month"), "supplier_id")
           .agg(F.max(flag(F.col("logins") > 0)).alias("on")))
    val = (bookings.filter(within("checkout_date") & (F.col("gmv") > 0)).groupBy(month("checkout_date").alias("month"), "supplier_id")
           .agg(F.sum("gmv").alias("gmv")))
    j = log.join(val, ["month", "supplier_id"], "full")
    on = F.coalesce("on", F.lit(0)) == 1
    g = j.groupBy("month").agg(F.sum(flag(on)).alias("mau"), F.sum("gmv").alias("total_value"),
                               F.sum(F.when(on, F.col("gmv"))).alias("value_logged_in"))
    return g.select("month", F.date_format("month", "MMM yyyy").alias("label"), "mau", "total_value", "value_logged_in",
                    share_pct(F.col("value_logged_in"), F.col("total_value")).alias("value_weighted_pct"))


def frequency_bucket(x: Column) -> Column:
    return (F.when(x == 0, "No Login").when(x < 3, "1-2").when(x < 6, "3-5").when(x < 11, "6-10").otherwise("10+"))


def frequency_distribution(entities: DataFrame, days: DataFrame, tier: str, start: date, end: date) -> DataFrame:
    """Mean monthly logins bucketed, counted per value tier; entities without logins stay."""
    m = (days.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)) & F.col("is_active"))
         .groupBy("supplier_id", F.date_trunc("month", "day").alias("m")).agg(F.sum("logins").alias("l"))
         .groupBy("supplier_id").agg(F.avg("l").alias("avg_logins")))
    b = entities.join(m, "supplier_id", "left").withColumn("bucket", frequency_bucket(F.coalesce("avg_logins", F.lit(0.0))))
    names = {"No Login": "no_login", "1-2": "logins_1_2", "3-5": "logins_3_5", "6-10": "logins_6_10", "10+": "logins_10_plus"}
    return b.groupBy(tier).agg(F.count(F.lit(1)).alias("suppliers"),
                               *[count_if(F.col("bucket") == k).alias(v) for k, v in names.items()],
                               share_pct(count_if(F.col("bucket") == "10+"), F.count(F.lit(1))).alias("pct_10_plus"))


def surfaced(actions: DataFrame, start: date, as_of: date) -> DataFrame:
    """Actions surfaced up to ``as_of``, in the state they had then: a later resolution leaves them open."""
    later = F.coalesce(F.col("resolved_at") > F.lit(as_of), F.lit(False))
    return actions.filter(F.col("surfaced_at").between(F.lit(start), F.lit(as_of))).withColumns({
        "status": F.when(later & (F.col("status") == "resolved"), "active").otherwise(F.col("status")),
        "resolved_at": F.when(~later, F.col("resolved_at"))})


def reach_rate(entities: DataFrame, actions: DataFrame, key: str | None = None) -> DataFrame:
    """Entities with at least one action among all relevant entities."""
    seen = actions.select("supplier_id").distinct().withColumn("_r", F.lit(1))
    j = entities.join(seen, "supplier_id", "left")
    n, r = F.countDistinct("supplier_id"), distinct_if(F.col("_r") == 1, F.col("supplier_id"))
    return j.groupBy(*([key] if key else [])).agg(n.alias("relevant"), r.alias("reached"), share_pct(r, n).alias("reach_pct"))


def reach_by_type(actions: DataFrame) -> DataFrame:
    n, s = F.count(F.lit(1)), F.countDistinct("supplier_id")
    return actions.groupBy("action_type").agg(s.alias("suppliers_reached"), n.alias("actions_surfaced"), ratio(n, s).alias("avg_actions"))


def status_shares(actions: DataFrame) -> DataFrame:
    """Share per outcome; grouped by the shown label, so raw states with one label add up."""
    s = F.col("status")
    label = F.when(s == "resolved", "Resolved").when(s == "expired", "Expired").when(s == "dismissed", "Dismissed").otherwise("Active / In progress")
    g = actions.groupBy(label.alias("status_label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))   # four rows


def status_funnel(actions: DataFrame, keys: list[str], days: int = 28) -> DataFrame:
    """Resolution (overall and in time), dismissal among acted on, expiry among closed."""
    st = F.col("status")
    took = F.datediff("resolved_at", "surfaced_at")
    n, res, dis, exp = F.count(F.lit(1)), count_if(st == "resolved"), count_if(st == "dismissed"), count_if(st == "expired")
    return actions.groupBy(*keys).agg(
        n.alias("surfaced"), F.countDistinct("supplier_id").alias("suppliers"), res.alias("resolved"),
        share_pct(res, n).alias("resolution_pct"),
        share_pct(count_if((st == "resolved") & (took <= days)), n).alias("resolution_in_time_pct"),
        share_pct(dis, res + dis).alias("dismissal_pct"), share_pct(exp, res + exp + dis).alias("expiry_pct"),
        F.avg(F.when((st == "resolved") & F.col("resolved_at").isNotNull(), took)).alias("avg_days_to_resolve"))


def by_month(actions: DataFrame) -> DataFrame:
    return actions.withColumn("month", F.to_date(F.date_trunc("month", "surfaced_at")))


def dismissal_reasons(actions: DataFrame, top: int = 20) -> DataFrame:
    reason = F.coalesce("dismissal_reason", F.lit("None selected"))
    return (actions.filter("status = 'dismissed'").groupBy("action_type", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "action_type", "reason").limit(top))


def entity_conversion(actions: DataFrame, entities: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Reached entities with at least one resolved action."""
    per = actions.groupBy("supplier_id").agg(F.max(flag(F.col("status") == "resolved")).alias("r"))
    if entities is not None:
        per = per.join(entities.select("supplier_id", key), "supplier_id")
    n, r = F.count(F.lit(1)), F.sum("r")
    return per.groupBy(*([key] if key else [])).agg(n.alias("reached"), r.alias("converted"), share_pct(r, n).alias("conversion_pct"),
                                                   (n - r).alias("never_resolved"))


def _resolved_counts(actions: DataFrame) -> DataFrame:
    return actions.filter("status = 'resolved'").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"))


def engagement_tiers(actions: DataFrame) -> DataFrame:
    g = _resolved_counts(actions).groupBy(engagement_tier(F.col("n")).alias("tier")).agg(F.count(F.lit(1)).alias("suppliers"))
    return g.withColumn("share_pct", 100.0 * F.col("suppliers") / F.sum("suppliers").over(Window.partitionBy()))   # four rows


def time_to_event(actions: DataFrame) -> DataFrame:
    """Days from surfaced to resolved in buckets, with share and cumulative share."""
    d = F.datediff("resolved_at", "surfaced_at")
    # fixed values: upper ends and labels
    edges = [(0, "Same day"), (3, "Days 1-3"), (7, "Days 4-7"), (14, "Days 8-14"), (30, "Days 15-30"), (60, "Days 31-60")]
    lab, pos = F.when(d <= edges[0][0], edges[0][1]), F.when(d <= edges[0][0], 1)
    for i, (e, name) in enumerate(edges[1:], 2):
        lab, pos = lab.when(d <= e, name), pos.when(d <= e, i)
    r = actions.filter("status = 'resolved' AND resolved_at IS NOT NULL")
    g = r.groupBy(pos.otherwise(7).alias("sort_order"), lab.otherwise("60+ days").alias("time_window")).agg(F.count(F.lit(1)).alias("n"))
    all_, run = Window.partitionBy(), Window.orderBy("sort_order").rowsBetween(Window.unboundedPreceding, 0)   # seven rows
    return g.withColumns({"share_pct": 100.0 * F.col("n") / F.sum("n").over(all_),
                          "cumulative_pct": 100.0 * F.sum("n").over(run) / F.sum("n").over(all_)})


def cohort_migration(actions: DataFrame, a_start: date, a_end: date, b_end: date) -> DataFrame:
    """Entities with exactly one success in period A, by their tier at the end of B."""
    sf = F.col("surfaced_at")
    per = actions.filter("status = 'resolved'").groupBy("supplier_id").agg(
        count_if((sf >= F.lit(a_start)) & (sf < F.lit(a_end))).alias("in_a"), count_if(sf < F.lit(b_end)).alias("n"))
    g = per.filter("in_a = 1").groupBy(engagement_tier(F.greatest("n", F.lit(1))).alias("tier")).agg(F.count(F.lit(1)).alias("suppliers"))
    return g.withColumn("share_pct", 100.0 * F.col("suppliers") / F.sum("suppliers").over(Window.partitionBy()))   # four rows


def funnel_steps(events: DataFrame, steps: list[str], key: str) -> DataFrame:
    """Visitors per step, step conversion, overall conversion and step abandonment."""
    n = [F.countDistinct(F.when(F.col("event_type") == s, F.col("visitor_id"))) for s in steps]
    g = events.filter(F.col("event_type").isin(steps)).groupBy(key).agg(*[c.alias(f"n_{s}") for c, s in zip(n, steps)])
    cols = {}
    for a, b in zip(steps, steps[1:]):
        cols[f"{a}_to_{b}_pct"] = share_pct(F.col(f"n_{b}"), F.col(f"n_{a}"))
        cols[f"{b}_abandonment_pct"] = 100.0 - share_pct(F.col(f"n_{b}"), F.col(f"n_{a}"))
    cols["overall_pct"] = share_pct(F.col(f"n_{steps[-1]}"), F.col(f"n_{steps[0]}"))
    return g.withColumns(cols)
