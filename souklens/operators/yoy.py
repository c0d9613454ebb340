"""Quarterly performance against the same quarter one year earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.periods import YearToDate
from souklens.functions.ratios import distinct_if, flag, ratio

VOLUMES = ["sessions", "visitors", "new_visitors", "returning_visitors", "bookings", "transactions",
           "bookings_with_coupon", "gmv", "nr", "supplier_share"]
SHARES = ["new_visitor_share", "bounce_rate", "quoter_rate", "coupon_share", "take_rate", "supplier_take_rate",
          "conversion_rate"]
LEVELS = ["aov", "avg_price", "commission_rate"]   # money, or already in percent points


def _quarters(df: DataFrame, day: str, ytd: YearToDate) -> DataFrame:
    return (df.withColumn("period", ytd.period(F.col(day))).filter(F.col("period").isNotNull())
            .withColumn("quarter_start", F.to_date(F.date_trunc("quarter", day))))


def visitor_new_returning(sessions: DataFrame, ytd: YearToDate, keys: list[str]) -> DataFrame:
    """A visitor is new in a quarter when any of its sessions there is marked new."""
    per = _quarters(sessions, "day", ytd).groupBy(*keys, "period", "quarter_start", "visitor_id").agg(
        F.max(flag(F.coalesce(F.col("is_new_visitor"), F.lit(False)))).alias("new"),
        F.max(flag(F.col("detail_views") > 0)).alias("quoted"))
    n = F.count(F.lit(1))
    return per.groupBy(*keys, "period", "quarter_start").agg(
        n.alias("visitors"), F.sum("new").alias("new_visitors"), (n - F.sum("new")).alias("returning_visitors"),
        F.sum("quoted").alias("quoted_visitors"))


def session_quarters(sessions: DataFrame, ytd: YearToDate, keys: list[str]) -> DataFrame:
    on = [*keys, "period", "quarter_start"]
    s = _quarters(sessions, "day", ytd).groupBy(*on).agg(
        F.countDistinct("session_id").alias("sessions"),
        distinct_if(F.col("is_bounce"), F.col("session_id")).alias("bounced"))
    j = s.join(visitor_new_returning(sessions, ytd, keys), on, "left")
    c = F.col
    return j.select(*on, "sessions", "visitors", "new_visitors", "returning_visitors",
                    ratio(c("new_visitors"), c("visitors")).alias("new_visitor_share"),
                    ratio(c("bounced"), c("sessions")).alias("bounce_rate"),
                    ratio(c("quoted_visitors"), c("visitors")).alias("quoter_rate"))


def booking_quarters(bookings: DataFrame, ytd: YearToDate, keys: list[str]) -> DataFrame:
    """Active bookings per quarter; rows are reduced to bookings, then carts, then quarters."""
    c = F.col
    on = [*keys, "period", "quarter_start"]
    b = _quarters(bookings, "checkout_date", ytd).filter(F.coalesce(c("status_id"), F.lit(-1)) == 1)
    zero = F.lit(0.0)
    v = {"gmv": F.coalesce("gmv", zero), "nr": F.coalesce("nr", zero), "supplier_share": F.coalesce("supplier_share", zero),
         "rate_x": F.coalesce("commission_rate", zero) * F.coalesce("gmv", zero)}
    per_b = b.groupBy(*on, "cart_id", "booking_id").agg(F.max(flag(F.coalesce("coupon_id", F.lit(0)) > 0)).alias("coupon"),
                                                         *[F.sum(e).alias(n) for n, e in v.items()])
    per_t = per_b.groupBy(*on, "cart_id").agg(F.count(F.lit(1)).alias("n"), F.sum("coupon").alias("coupon"), *[F.sum(n).alias(n) for n in v])
    s, n, t = F.sum, F.sum("n"), F.count(F.lit(1))
    return per_t.groupBy(*on).agg(
        n.alias("bookings"), t.alias("transactions"), s("coupon").alias("bookings_with_coupon"), s("gmv").alias("gmv"), s("nr").alias("nr"),
        s("supplier_share").alias("supplier_share"), ratio(s("coupon"), n).alias("coupon_share"), ratio(s("nr"), s("gmv")).alias("take_rate"),
        ratio(s("supplier_share"), s("gmv")).alias("supplier_take_rate"), ratio(s("gmv"), t).alias("aov"), ratio(s("gmv"), n).alias("avg_price"),
        ratio(s("rate_x"), s("gmv")).alias("commission_rate"))


def yoy_quarters(sessions: DataFrame, bookings: DataFrame, ytd: YearToDate, keys: list[str]) -> DataFrame:
    """Sessions and bookings of a quarter, either side may be missing."""
    on = [*keys, "period", "quarter_start"]
    s, b = session_quarters(sessions, ytd, keys), booking_quarters(bookings, ytd, keys)
    j = s.join(b, on, "full")
    return j.withColumn("conversion_rate", ratio(F.col("bookings"), F.col("sessions")))


def yoy_long(quarters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(quarter_label, metric, value)`` with CY, PY, difference and relative change.

    Shares are given in percent; the commission rate already is in percent points.
    """
    metrics = VOLUMES + SHARES + LEVELS
    v = lambda m: F.col(m).cast("double")
    cy = quarters.filter("period = 'CY'").select(*keys, "quarter_start", *[v(m).alias(f"cy_{m}") for m in metrics])
    py = quarters.filter("period = 'PY'").select(
        *keys, F.add_months("quarter_start", 12).alias("quarter_start"), *[v(m).alias(f"py_{m}") for m in metrics])
    j = cy.join(py, [*keys, "quarter_start"], "left")
    label = F.concat(F.lit("Q"), F.quarter("quarter_start"), F.lit(" - "), F.year("quarter_start"))
    cols = []
    for m in metrics:
        unit = 100.0 if m in SHARES else 1.0
        a, b = F.col(f"cy_{m}"), F.col(f"py_{m}")
        cols += [(a * unit).alias(f"cy_{m}"), (b * unit).alias(f"py_{m}"), ((a - b) * unit).alias(f"yoy_{m}_abs"),
                 ((a / F.nullif(b, F.lit(0.0)) - 1) * 100).alias(f"yoy_{m}_pct")]
    wide = j.select(*keys, label.alias("quarter_label"), *cols)
    names = [c for c in wide.columns if c not in keys + ["quarter_label"]]
    return wide.unpivot([*keys, "quarter_label"], names, "metric", "value")


def pivot_quarters(long: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """One column per wanted quarter; ``labels`` maps label to column name."""
    return long.groupBy(*keys, "metric").pivot("quarter_label", list(labels)).agg(F.max("value")).select(
        *keys, "metric", *[F.col(f"`{q}`").alias(n) for q, n in labels.items()])
