"""Weekly country panels of a fixed supplier cohort around an intervention Monday."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.periods import spread_over_weeks, week_list
from souklens.functions.ratios import flag, ratio, sum_if
from souklens.functions.skew import broadcast_if_small
from souklens.functions.storage import materialise

KEYS = ["week_start", "country_name"]


@dataclass(frozen=True)
class Study:
    """Intervention date (a Monday), weeks on each side, forward window and clock."""

    event: date
    as_of: date
    weeks_before: int = 8
    weeks_after: int = 8
    horizon_days: int = 90
    shift_days: int = 364

    def __post_init__(self):
        if self.event.weekday() != 0:
            raise ValueError("the intervention date must be a Monday")

    @property
    def start(self) -> date:
        return self.event - timedelta(weeks=self.weeks_before)

    @property
    def end(self) -> date:
        """First day after the last week."""
        return self.event + timedelta(weeks=self.weeks_after)

    @property
    def weeks(self) -> list[date]:
        return week_list(self.start, self.weeks_before + self.weeks_after, self.as_of)

    @property
    def ly_end(self) -> date:
        """Last year is cut at the same elapsed day."""
        return min(self.end, self.as_of) - timedelta(days=self.shift_days)

    @property
    def ly_start(self) -> date:
        return self.start - timedelta(days=self.shift_days)

    def ranges(self) -> list[tuple[date, date]]:
        one = timedelta(days=1)
        return [(self.ly_start, self.ly_end - one), (self.start, self.end - one)]

    def in_study(self, d: Column) -> Column:
        return (d >= F.lit(self.start)) & (d < F.lit(self.end))

    def in_either(self, d: Column) -> Column:
        return self.in_study(d) | ((d >= F.lit(self.ly_start)) & (d < F.lit(self.ly_end)))

    def is_pre(self, col: str = "week_start") -> Column:
        return F.col(col) < F.lit(self.event)

    def period(self) -> Column:
        return F.when(self.is_pre(), "pre").otherwise("post").alias("period")


def week_of(day: str) -> Column:
    return F.to_date(F.date_trunc("week", F.col(day)))


def cohort_activities(pool: DataFrame, online: DataFrame, st: Study) -> DataFrame:
    """Activities the pool suppliers listed in the pre weeks."""
    listed = (online.filter((F.col("day") >= F.lit(st.start)) & (F.col("day") < F.lit(st.event)))
              .select("supplier_id", "activity_id").distinct())
    return pool.select("supplier_id", "country_name").join(listed, "supplier_id")


def cohort_sizes(pool: DataFrame, acts: DataFrame) -> DataFrame:
    """Suppliers with their number of activities; suppliers without any stay with 0."""
    n = acts.groupBy("supplier_id").agg(F.countDistinct("activity_id").alias("n_activities"))
    return (pool.select("supplier_id", "country_name").join(n, "supplier_id", "left")
            .withColumn("n_activities", F.coalesce("n_activities", F.lit(0))))


def online_by_supplier(online: DataFrame, acts: DataFrame, st: Study) -> DataFrame:
    on = online.filter(st.in_study(F.col("day")) & F.col("is_online"))
    return (on.join(acts.select("activity_id").distinct(), "activity_id", "left_semi")
            .groupBy(week_of("day").alias("week_start"), "supplier_id")
            .agg(F.countDistinct("activity_id").alias("online")))


def forward_rows(df: DataFrame, day: str, st: Study) -> DataFrame:
    """Snapshots taken on a study Monday for travel within the forward window."""
    return (df.filter(F.col(day).isin(st.weeks) & (F.col("travel_date") >= F.col(day))
                      & (F.col("travel_date") < F.date_add(F.col(day), st.horizon_days)))
            .withColumnRenamed(day, "week_start"))


def forward_availability(avail: DataFrame, acts: DataFrame, st: Study) -> DataFrame:
    """Share of the next days with open slots, per activity that has any slot.

    ``vacancies`` is only tested for being positive: the unlimited sentinel is never summed.
    """
    rows = forward_rows(avail, "day", st).join(acts.select("activity_id").distinct(), "activity_id", "left_semi")
    days = rows.groupBy("week_start", "supplier_id", "activity_id").agg(
        F.countDistinct(F.when(F.col("vacancies") > 0, F.col("travel_date"))).alias("d"))
    return days.groupBy("week_start", "supplier_id").agg(
        ratio(F.sum("d"), F.sum(flag(F.col("d") > 0)) * st.horizon_days).alias("coverage"))


def supplier_weeks(pool: DataFrame, acts: DataFrame, online: DataFrame, avail: DataFrame, st: Study) -> DataFrame:
    """Supplier × week spine with zero-filled activity."""
    spine = spread_over_weeks(cohort_sizes(pool, acts), st.weeks)
    on = ["week_start", "supplier_id"]
    j = (spine.join(online_by_supplier(online, acts, st), on, "left")
         .join(forward_availability(avail, acts, st), on, "left"))
    online0 = F.coalesce("online", F.lit(0))
    return j.select("week_start", "supplier_id", "country_name", "n_activities", online0.alias("online"),
                    flag(online0 > 0).alias("is_active"),
                    ratio(online0, F.col("n_activities")).alias("pct_online"), "coverage")


def cohort_supply_panel(weekly: DataFrame, st: Study) -> DataFrame:
    return weekly.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("cohort_suppliers"), F.sum("n_activities").alias("cohort_activities"),
        F.sum("is_active").alias("active_suppliers"), F.sum("online").alias("active_activities"),
        ratio(F.sum("is_active"), F.count(F.lit(1))).alias("pct_active_suppliers"),
        F.avg("pct_online").alias("pct_online_per_supplier"),
        F.avg("coverage").alias("pct_days_with_slots")).withColumn("period", st.period())


def activity_week_prices(prices: DataFrame, acts: DataFrame, st: Study) -> DataFrame:
    rows = forward_rows(prices, "snapshot_date", st).filter(F.col("price_black") > 0)
    return (rows.join(acts.select("activity_id").distinct(), "activity_id", "left_semi")
            .groupBy("week_start", "country_name", "supplier_id", "activity_id", "currency")
            .agg(F.avg("price_black").alias("black"), F.avg("price_red").alias("red")))


def with_own_index(week_prices: DataFrame, st: Study, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Price relative to the activity's own pre-period mean, clipped; needs a pre-period price."""
    w = Window.partitionBy("activity_id", "currency")
    base = lambda c: F.avg(F.when(st.is_pre(), F.col(c))).over(w)
    clip = lambda c: F.least(F.greatest(ratio(F.col(c), F.col(f"base_{c}")), F.lit(low)), F.lit(high))
    return (week_prices.withColumns({"base_black": base("black"), "base_red": base("red"),
                                     "has_base": F.max(flag(st.is_pre())).over(w)})
            .filter("has_base = 1").withColumns({"idx_black": clip("black"), "idx_red": clip("red")}))


def to_eur(df: DataFrame, fx: DataFrame, day: str, amounts: dict[str, str]) -> DataFrame:
    """Divide by the rate (units per EUR) of the day; EUR is 1, rows without a usable rate drop out."""
    r = fx.filter(F.col("rate") > 0).select("currency", F.col("rate_date").alias(day), "rate")
    # a row per currency and day; the days are those that the rates were asked for
    j = df.join(broadcast_if_small(r), ["currency", day], "left").filter((F.col("currency") == "EUR") | F.col("rate").isNotNull())
    rate = F.when(F.col("currency") == "EUR", F.lit(1.0)).otherwise(F.col("rate"))
    return j.withColumns({out: F.col(c) / rate for c, out in amounts.items()}).drop("rate")


def relative_price_index(prices: DataFrame, acts: DataFrame, fx: DataFrame, st: Study) -> DataFrame:
    """Mean over suppliers of their mean activity index, and EUR price levels."""
    wp = materialise(activity_week_prices(prices, acts, st))   # read for the index and for the levels
    per = with_own_index(wp, st).groupBy(*KEYS, "supplier_id").agg(
        F.avg("idx_black").alias("b"), F.avg("idx_red").alias("r"))
    idx = per.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("suppliers_with_price"),
                                 F.avg("b").alias("price_index_black"), F.avg("r").alias("price_index_effective"))
    eur = to_eur(wp, fx, "week_start", {"black": "eb", "red": "er"}).groupBy(*KEYS).agg(
        F.avg("eb").alias("avg_price_black_eur"), F.avg("er").alias("avg_price_effective_eur"))
    return idx.join(eur, KEYS, "left").withColumn("period", st.period())


def cohort_bookings(bookings: DataFrame, acts: DataFrame, st: Study) -> DataFrame:
    b = bookings.filter(F.col("status_id").isin(1, 2) & st.in_either(F.col("checkout_date")))
    return b.join(acts.select(F.col("activity_id").alias("line_id")).distinct(), "line_id", "left_semi")


def winsor_caps(df: DataFrame, keys: list[str], cols: list[str], p: float) -> DataFrame:
    """Upper caps per group from a mergeable sketch, one bounded row per group."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(c, p).alias(f"{c}_cap") for c in cols])


def realised_weekly(bookings: DataFrame, acts: DataFrame, st: Study, cap_at: float = 0.99) -> DataFrame:
    """Country-week sums of capped values, and the mean of supplier commission rates."""
    b = cohort_bookings(bookings, acts, st)
    # a row per country: broadcast after a count, so that the facts stay where they are
    capped = b.join(broadcast_if_small(winsor_caps(b, ["country_name"], ["gmv", "nr"], cap_at)), "country_name")
    paid = F.col("gmv") > 0
    per = capped.groupBy(week_of("checkout_date").alias("week_start"), "country_name", "supplier_id").agg(
        F.countDistinct("booking_id").alias("bookings"), F.sum("tickets").alias("tickets"),
        F.sum(F.least("gmv", "gmv_cap")).alias("gmv"), F.sum(F.least("nr", "nr_cap")).alias("nr"),
        F.sum(F.when(paid, F.col("gmv"))).alias("gmv_raw"), F.sum(F.when(paid, F.col("nr"))).alias("nr_raw"))
    s = lambda c: F.sum(c).alias(c)
    return per.groupBy(*KEYS).agg(s("bookings"), s("tickets"), s("gmv"), s("nr"), s("gmv_raw"), s("nr_raw"),
                                  F.avg(ratio(F.col("nr_raw"), F.col("gmv_raw"))).alias("commission_per_supplier"))


def shifted(df: DataFrame, st: Study, cols: list[str]) -> DataFrame:
    """Last year's rows moved forward onto this year's weeks."""
    return df.select(F.date_add("week_start", st.shift_days).alias("week_start"), "country_name",
                     *[F.col(c).alias(f"{c}_ly") for c in cols])


def realised_yoy_panel(weekly: DataFrame, sizes: DataFrame, st: Study) -> DataFrame:
    n = sizes.groupBy("country_name").agg(F.count(F.lit(1)).alias("cohort_suppliers"))
    cols = ["bookings", "tickets", "gmv", "nr", "commission_per_supplier"]
    c = F.col
    weekly = materialise(weekly)   # read for both years
    j = (weekly.filter(c("week_start") >= F.lit(st.start)).join(n, "country_name")
         .join(shifted(weekly, st, cols), KEYS, "left"))
    return j.select(*KEYS, st.period(), "cohort_suppliers",
                    *[(c(m) / c("cohort_suppliers")).alias(f"{m}_per_supplier") for m in cols[:4]],
                    c("commission_per_supplier").alias("commission_rate_per_supplier"),
                    ratio(c("commission_per_supplier"), c("commission_per_supplier_ly")).alias("commission_rate_per_supplier_yoy"),
                    ratio(c("nr_raw"), c("gmv_raw")).alias("commission_rate_pooled"),
                    *[ratio(c(m), c(f"{m}_ly")).alias(f"{m}_yoy") for m in cols[:4]])


def traffic_yoy_panel(traffic: DataFrame, sizes: DataFrame, st: Study) -> DataFrame:
    """Visits per cohort supplier, funnel rates, and ratios of those rates to last year's."""
    cols = ["visitors", "add_to_cart_visitors", "customers", "unavailability_visitors"]
    weekly = (traffic.filter(st.in_either(F.col("day"))).groupBy(week_of("day").alias("week_start"), "country_name")
              .agg(*[F.sum(x).alias(x) for x in cols]))
    n = sizes.groupBy("country_name").agg(F.count(F.lit(1)).alias("cohort_suppliers"))
    c = F.col
    j = (weekly.filter(c("week_start") >= F.lit(st.start)).join(n, "country_name")
         .join(shifted(weekly, st, cols), KEYS, "left"))
    names = {"add_to_cart_visitors": "add_to_cart_rate", "customers": "conversion_rate",
             "unavailability_visitors": "unavailability_rate"}
    return j.select(*KEYS, st.period(), "visitors", ratio(c("visitors"), c("cohort_suppliers")).alias("visitors_per_supplier"),
                    ratio(c("visitors"), c("visitors_ly")).alias("visitors_yoy"),
                    *[e for v, name in names.items() for e in (
                        ratio(c(v), c("visitors")).alias(name),
                        ratio(ratio(c(v), c("visitors")), ratio(c(f"{v}_ly"), c("visitors_ly"))).alias(f"{name}_yoy"))])


def merge_panels(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join panels on week and country; repeated columns keep the base's version."""
    out = base
    for o in others:
        out = out.join(o.select(*KEYS, *[c for c in o.columns if c not in out.columns]), KEYS, "left")
    return out


def entity_pre_post(pool: DataFrame, acts: DataFrame, online: DataFrame, avail: DataFrame, prices: DataFrame,
                    bookings: DataFrame, st: Study) -> DataFrame:
    """Per supplier: activity, portfolio, coverage, price index, bookings and value before and after."""
    pre = st.is_pre()
    mean = lambda cond, c: F.avg(F.when(cond, c))
    sw = supplier_weeks(pool, acts, online, avail, st).groupBy("supplier_id", "country_name", "n_activities").agg(*[
        mean(cond, F.col(c)).alias(f"{name}_{side}")
        for c, name in (("is_active", "active_share"), ("pct_online", "pct_online"), ("coverage", "coverage"))
        for side, cond in (("pre", pre), ("post", ~pre))])
    px = with_own_index(activity_week_prices(prices, acts, st), st).groupBy("supplier_id").agg(
        mean(~pre, F.col("idx_black")).alias("price_idx_post"))
    early = F.col("checkout_date") < F.lit(st.event)
    b = cohort_bookings(bookings, acts, st).filter(st.in_study(F.col("checkout_date"))).groupBy("supplier_id").agg(
        *[sum_if(cond, v).alias(f"{name}_{side}")
          for v, name in ((F.lit(1), "bookings"), (F.col("gmv"), "gmv"), (F.col("nr"), "nr"))
          for side, cond in (("pre", early), ("post", ~early))])
    zeros = {f"{n}_{s}": 0 for n in ("bookings", "gmv", "nr") for s in ("pre", "post")}
    return sw.join(px, "supplier_id", "left").join(b, "supplier_id", "left").fillna(zeros)
