"""Ranks, tiles, Pareto sets and trailing performance of entities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.functions.ordering import ntile_col, ordered, ranked
from souklens.functions.periods import shift_months
from souklens.functions.quantiles import is_after, rows_at
from souklens.functions.ratios import flag, ratio, share_pct
from souklens.functions.skew import join_per_key
from souklens.functions.storage import materialise


def since(day: Column, as_of: date, months: int) -> Column:
    """The trailing window of so many months that ends with ``as_of``."""
    return day.between(F.lit(shift_months(as_of, -months)), F.lit(as_of))


def without_resellers(bookings: DataFrame, resellers: DataFrame) -> DataFrame:
    return bookings.join(resellers.select("customer_id").distinct(), "customer_id", "left_anti")


def customer_frequency(bookings: DataFrame, as_of: date, months: list[int]) -> DataFrame:
    """Bookings per customer in every trailing window, in one pass; later bookings don't count."""
    bookings = bookings.filter(F.col("checkout_date") <= F.lit(as_of))
    w = {m: F.max(flag(since(F.col("checkout_date"), as_of, m))).alias(f"freq_{m}") for m in months}
    per = bookings.groupBy("customer_id", "booking_id").agg(*w.values(), F.count(F.lit(1)).alias("customer_rows"))
    return per.groupBy("customer_id").agg(*[F.sum(f"freq_{m}").alias(f"freq_{m}") for m in months],
                                          F.sum("customer_rows").alias("customer_rows"))


def trailing_performance(bookings: DataFrame, keys: list[str], as_of: date, months: tuple[int, ...] = (3, 6, 12),
                         by: list[str] | None = None) -> DataFrame:
    """Bookings, value, tickets and customers per trailing window and over the lifetime.

    The lifetime columns cover the whole input up to ``as_of``. A customer is a repeat customer of a
    window with more than one booking in it, anywhere. Rows are dealt out by the keys once (``by``: by these of them)
    and reduced to bookings, to customers and to the keys in place: every distinct count becomes a plain count, and
    no sum travels. Repeat customers take the rows of the longest window only. The columns read are stored
    once, as they are read several times. A booking belongs to one customer.
    """
    c, day = F.col, F.col("checkout_date")
    bookings = materialise(bookings.filter(day <= F.lit(as_of)).select(*keys, "customer_id", "booking_id", "checkout_date", "gmv", "nr", "tickets"))
    recent = since(day, as_of, max(months))
    freq = customer_frequency(bookings.filter(recent), as_of, list(months))
    late = join_per_key(bookings.filter(recent), freq, ["customer_id"], "customer_rows", keys)
    bookings = late.unionByName(bookings.filter(~recent), allowMissingColumns=True)
    ins = {m: since(day, as_of, m) for m in months}
    last = months[-1]
    sums = {f"{v}_{m}": F.sum(F.when(ins[m], c(v))) for m in months for v in ("gmv", "nr", "tickets")}
    sums.update({"gmv_all": F.sum("gmv"), "nr_all": F.sum("nr"),
                 "gmv_n": F.count(F.when(ins[last], c("gmv"))), "tickets_n": F.count(F.when(ins[last], c("tickets")))})
    ends = {"last_day": (F.max, day), "first_day": (F.min, day)}
    per_b = bookings.repartition(*(by or keys)).groupBy(*keys, "customer_id", "booking_id").agg(
        *[F.max(flag(ins[m])).alias(f"b_{m}") for m in months], *[F.max(flag(c(f"freq_{m}") > 1)).alias(f"again_{m}") for m in months],
        *[e.alias(n) for n, e in sums.items()], *[f(d).alias(n) for n, (f, d) in ends.items()])
    per_c = per_b.groupBy(*keys, "customer_id").agg(
        F.count(F.lit(1)).alias("b_all"), *[F.sum(f"b_{m}").alias(f"b_{m}") for m in months],
        *[F.max(f"b_{m}").alias(f"c_{m}") for m in months], *[F.max(f"again_{m}").alias(f"again_{m}") for m in months], *[F.sum(n).alias(n) for n in sums],
        *[f(n).alias(n) for n, (f, _) in ends.items()])
    aggs = []
    for m in months:
        cust, again = F.sum(f"c_{m}"), F.sum(flag((c(f"c_{m}") == 1) & (c(f"again_{m}") == 1)))
        aggs += [F.sum(f"b_{m}").alias(f"bookings_l{m}m"), F.sum(f"gmv_{m}").alias(f"gmv_l{m}m"), F.sum(f"nr_{m}").alias(f"nr_l{m}m"),
                 F.sum(f"tickets_{m}").alias(f"tickets_l{m}m"), cust.alias(f"customers_l{m}m"), share_pct(again, cust).alias(f"repeat_rate_l{m}m")]
    aggs += [F.sum("b_all").alias("bookings_lifetime"), F.sum("gmv_all").alias("gmv_lifetime"), F.sum("nr_all").alias("nr_lifetime"),
             ratio(F.sum(f"gmv_{last}"), F.sum("gmv_n")).alias("avg_booking_value"), ratio(F.sum(f"tickets_{last}"), F.sum("tickets_n")).alias("avg_tickets"),
             F.max("last_day").alias("last_booking_date"), F.min("first_day").alias("first_booking_date")]
    out = per_c.groupBy(*keys).agg(*aggs)
    l3, l6 = c(f"bookings_l{months[0]}m"), c(f"bookings_l{months[1]}m")
    return out.withColumns({"days_since_last_booking": F.datediff(F.lit(as_of), "last_booking_date"),
                            "growth_pct": F.when(l6 > 0, share_pct(l3 * 2 - l6, l6))})


VALUE_TIERS = ["no_revenue", "low_value", "medium_value", "high_value", "top_tier"]   # fixed values


def value_tier(value: str, at_least: dict[int, Column]) -> Column:
    """Tier of a value; ``at_least`` maps 9, 7 and 4 to whether its decile reaches that."""
    return (F.when(F.col(value).isNull() | (F.col(value) == 0), "no_revenue").when(at_least[9], "top_tier")
            .when(at_least[7], "high_value").when(at_least[4], "medium_value").otherwise("low_value"))


def with_value_tiers(perf: DataFrame, value: str, tie: list[str], others: list[str]) -> DataFrame:
    """Percent ranks, deciles, quartiles and the tiers derived from them.

    ``tie`` makes the tiles reproducible; missing values rank lowest.
    """
    names = {c: f"{c}_percentile" for c in [value, *others]}
    p = ranked(perf, names, tie, {"decile": 10, "quartile": 4}).withColumns({n: F.col(n) * 100 for n in names.values()})
    pct, none = F.col(f"{value}_percentile"), F.col(value).isNull() | (F.col(value) == 0)
    return p.withColumns({
        "percentile_tier": F.when(none, "no_revenue").when(pct >= 95, "top_5pct").when(pct >= 90, "top_10pct")
        .when(pct >= 75, "top_25pct").when(pct >= 50, "above_median").otherwise("below_median"),
        "value_tier": value_tier(value, {d: F.col("decile") >= d for d in (9, 7, 4)})})


TIER_DECILES = (9, 7, 4)   # fixed values: the least decile of each tier


def value_cuts(perf: DataFrame, value: str, tie: list[str]) -> dict[int, tuple]:
    """The last row (value, then ``tie``) before each of ``TIER_DECILES``, without a rank for every row.

    Where that row has no value there is no entry: every row with one comes after it.
    """
    n, empty = perf.agg(F.count(F.lit(1)), F.sum(flag(F.col(value).isNull()))).first()
    # rows with a value in the deciles before
    ends = {d: (d - 1) * (n // 10) + min(d - 1, n % 10) - (empty or 0) for d in TIER_DECILES}
    asked = [d for d, end in ends.items() if end > 0]
    return dict(zip(asked, rows_at(perf.filter(F.col(value).isNotNull()), [value, *tie], [ends[d] - 1 for d in asked])))


def tier_at_cuts(value: str, tie: list[str], cuts: dict[int, tuple]) -> Column:
    """The ``value_tier`` that ``with_value_tiers`` gives, by comparing each row with ``value_cuts``."""
    return value_tier(value, {d: is_after([value, *tie], cuts[d]) if d in cuts else F.lit(True) for d in TIER_DECILES})


def supplier_quartiles(perf: DataFrame, value: str = "gmv_l12m") -> DataFrame:
    """Quartile of a supplier's total among suppliers with a positive total."""
    t = perf.filter(F.col(value) > 0).groupBy("supplier_id").agg(F.sum(value).alias("total"))
    return ordered(t, "total", "supplier_id").select("supplier_id", "total", ntile_col(4).alias("quartile"))


def pareto_set(df: DataFrame, keys: list[str], entity: str, value: str, share: float = 0.8,
               include_crossing: bool = False) -> DataFrame:
    """Adds ``cumulative_share`` (largest first, within ``keys``) and ``in_set``.

    The plain rule keeps entities whose cumulative share is at most ``share``, so one
    dominant entity gives an empty set; ``include_crossing`` also keeps the entity that
    crosses the line.
    """
    o = ordered(df.filter(F.col(value) > 0), value, entity, keys, descending=True, running={"cum": value})
    s = ratio(F.col("cum"), F.col("cum_total"))
    hit = (F.col("cum") - F.col(value) < share * F.col("cum_total")) if include_crossing else (s <= share)
    return o.select(*df.columns, s.alias("cumulative_share"), hit.alias("in_set"))


def concentration_curve(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Cumulative share of value against cumulative share of entities, largest first."""
    o = ordered(df, value, entity, descending=True, running={"cum": value})
    return o.select(entity, value, (F.col("pos") / F.col("n_rows")).alias("entity_share"),
                    ratio(F.col("cum"), F.col("cum_total")).alias("value_share"))
