"""Marketplace facts expressed over the star-schema tables.

Each function reads only the columns it needs and takes the date range as Python dates,
compared with the raw timestamp column so that the range reaches the parquet scan.
Dimension tables are broadcast when their row count, read from the file footers, is small;
beyond that Spark shuffles, with adaptive skew splitting.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.functions.skew import broadcast_if_small
from souklens.sources.tables import read_table, row_count

CONFIG_DDL = (
    "struct<pricingCategories:struct<"
    "individual:array<struct<ticketCategory:string,prices:array<struct<minParticipants:int,retailPrice:decimal(10,3)>>>>,"
    "group:array<struct<isAdditionalPaxForGroup:boolean,prices:array<struct<maxParticipants:int,retailPrice:decimal(10,3)>>>>,"
    "addons:array<struct<prices:array<struct<retailPrice:decimal(10,3)>>>>>,"
    "group:array<struct<isAdditionalPaxForGroup:boolean,prices:array<struct<maxParticipants:int,retailPrice:decimal(10,3)>>>>,"
    "addons:array<struct<prices:array<struct<retailPrice:decimal(10,3)>>>>>"
)

#: The same arrays without prices and flags, for what only counts entries: numbers that are not asked for are skipped, not converted.
COUNT_DDL = (
    "struct<pricingCategories:struct<individual:array<struct<ticketCategory:string,prices:array<struct<minParticipants:int>>>>,"
    "group:array<struct<prices:array<struct<minParticipants:int>>>>,addons:array<struct<prices:array<struct<minParticipants:int>>>>>,"
    "group:array<struct<prices:array<struct<minParticipants:int>>>>,addons:array<struct<prices:array<struct<minParticipants:int>>>>>"
)


def in_days(ts: Column, first: date | None, last: date | None) -> Column:
    """Inclusive day range as a plain comparison of the timestamp column.

    Text literals take the column's own type, with or without time zone, so the range
    neither moves with the session's zone nor stops at a cast before the scan.
    """
    cond = F.lit(True)
    if first is not None:
        cond = ts >= F.lit(f"{first} 00:00:00")
    if last is not None:
        upper = ts < F.lit(f"{last + timedelta(days=1)} 00:00:00")
        cond = upper if first is None else cond & upper
    return cond


def in_ranges(ts: Column, ranges: list[tuple[date, date]] | None) -> Column | None:
    if not ranges:
        return None
    out = in_days(ts, *ranges[0])
    for r in ranges[1:]:
        out = out | in_days(ts, *r)
    return out


def event_ranges(w) -> list[tuple[date, date]]:
    return [(w.ly_pre_start, w.ly_post_end), (w.cy_pre_start, w.cy_post_end)]


def orders(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    o = read_table(spark, "orders", root)
    cond = in_ranges(F.col("o_orderdate"), ranges)
    return o if cond is None else o.filter(cond)


def lineitem(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, "lineitem", root)


def supplier_dim(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """Supplier columns for a join to facts; the inner joins to nation and region add no rows."""
    return broadcast_if_small(suppliers(spark, root).select("supplier_id", *cols), row_count(spark, "supplier", root))


def customer_dim(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    return broadcast_if_small(customers(spark, root).select("visitor_id", *cols), row_count(spark, "customer", root))


def activity_dim(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    # beyond a broadcast the shuffled dimension is hashed by task, so that the wider facts need no sort
    return broadcast_if_small(activities(spark, root).select("activity_id", *cols).hint("shuffle_hash"), row_count(spark, "part", root))


def suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Supplier with its country, region and the account flags."""
    s, n, r = (read_table(spark, t, root) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation_id"),
                    F.col("n_name").alias("country_name"), F.col("r_name").alias("region_name"),
                    (F.col("s_acctbal") > 5000).alias("is_managed"),
                    (F.col("s_suppkey") % 2 == 0).alias("is_connected")))


def activities(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, "part", root).select(
        F.col("p_partkey").alias("activity_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("activity_type"), F.col("p_brand").alias("category"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"))


def travel_day() -> Column:
    """Travel up to 399 days after the order."""
    o, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return F.date_add(o, F.abs(F.datediff(s, o)) % 400)


def order_week() -> Column:
    return F.to_date(F.date_trunc("week", "o_orderdate"))


def supplier_line() -> Column:
    """Activity as the n-th product line of a supplier."""
    return F.col("l_suppkey") * 8 + F.col("l_linenumber")


def status_code() -> Column:
    """2 cancelled, 1 active, NULL unknown."""
    return (F.when(F.col("l_returnflag") == "R", 2)
            .when((F.col("l_returnflag") == "A") | (F.col("l_linenumber") < 7), 1))


def bookings(spark: SparkSession, root: str, ranges=None, place: bool = True) -> DataFrame:
    """One row per order line."""
    o, li = orders(spark, root, ranges), lineitem(spark, root)
    b = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("booking_id"),
        F.col("o_orderkey").alias("cart_id"), F.col("l_partkey").alias("activity_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("o_custkey").alias("customer_id"),
        status_code().alias("status_id"), F.to_date("o_orderdate").alias("checkout_date"),
        travel_day().alias("travel_date"), F.col("l_quantity").alias("tickets"),
        F.col("l_extendedprice").alias("gmv"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("nr"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("supplier_share"),
        (F.col("l_discount") * 100).alias("commission_rate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("coupon_id"),
        supplier_line().alias("line_id"))
    if not place:
        return b
    return b.join(supplier_dim(spark, root, "country_name", "region_name"), "supplier_id")


def status_dim(spark: SparkSession) -> DataFrame:
    # fixed values: booking status
    return spark.createDataFrame([(-1, "Unknown"), (1, "Active"), (2, "Cancelled")],
                                 "status_id int, status_name string")


def prices(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Weekly price snapshots (Mondays) by travel day; ranges must hold whole weeks."""
    o, li = orders(spark, root, ranges), lineitem(spark, root)
    black = F.col("l_extendedprice") / F.col("l_quantity")
    p = li.join(o, li.l_orderkey == o.o_orderkey).select(
        order_week().alias("snapshot_date"), travel_day().alias("travel_date"),
        supplier_line().alias("activity_id"), F.col("l_suppkey").alias("supplier_id"),
        black.alias("price_black"), (black * (1 - F.col("l_discount"))).alias("price_red"),
        F.when(F.col("l_linenumber") > 1,
               F.array_repeat(F.lit("slot"), F.col("l_linenumber") - 1)).alias("timeslots"))
    s = suppliers(spark, root).select(
        "supplier_id", "country_name",
        F.when(F.col("nation_id") % 3 == 0, "EUR").when(F.col("nation_id") % 3 == 1, "USD")
        .otherwise("GBP").alias("currency"))
    return p.join(broadcast_if_small(s, row_count(spark, "supplier", root)), "supplier_id")


def fx_rates(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Units of currency per 1 EUR, one row per currency and order day of the ranges."""
    days = orders(spark, root, ranges).select(F.to_date("o_orderdate").alias("rate_date")).distinct()
    step = (F.dayofyear("rate_date") % 40) / 100.0
    return days.select("rate_date", F.explode(F.array(
        F.struct(F.lit("USD").alias("currency"), (1.0 + step).alias("rate")),
        F.struct(F.lit("GBP").alias("currency"), (0.6 + step).alias("rate")))).alias("r")).select(
        "rate_date", "r.currency", "r.rate")


def online_history(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Activity × supplier × day state: online on days with an open line."""
    li = lineitem(spark, root)
    cond = in_ranges(F.col("l_shipdate"), ranges)
    li = li if cond is None else li.filter(cond)
    h = li.select(F.to_date("l_shipdate").alias("day"), supplier_line().alias("activity_id"),
                  F.col("l_suppkey").alias("supplier_id"),
                  (F.col("l_linestatus") == "O").alias("is_online"))
    return h.join(supplier_dim(spark, root, "country_name"), "supplier_id")


def availability(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Open slots by travel day in weekly snapshots; 9,999,999 stands for unlimited."""
    o, li = orders(spark, root, ranges), lineitem(spark, root)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        order_week().alias("day"), travel_day().alias("travel_date"),
        supplier_line().alias("activity_id"), F.col("l_suppkey").alias("supplier_id"),
        F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_linenumber") == 7, 9999999)
        .otherwise(F.col("l_linenumber")).cast("int").alias("vacancies"))


def customers(spark: SparkSession, root: str) -> DataFrame:
    c, n, r = (read_table(spark, t, root) for t in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("visitor_id"), F.col("n_name").alias("country_name"),
                    F.col("r_name").alias("region_name"), F.col("c_mktsegment").alias("segment")))


def events(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, "events", root)
    return e.select("event_id", F.to_date("ts").alias("day"), "ts", F.col("user_id").alias("visitor_id"),
                    "event_type", "value",
                    F.get_json_object("props", "$.k").cast("bigint").alias("activity_id"))


def traffic(spark: SparkSession, root: str, day: Column | None = None) -> DataFrame:
    """Daily traffic per activity and visitor country; ``day`` replaces the day of an event, as a function of its ``ts``."""
    e = events(spark, root)
    e = (e if day is None else e.withColumn("day", day)).join(customer_dim(spark, root, "country_name"), "visitor_id")
    t = F.col("event_type")
    n = lambda kind: F.sum(F.when(t == kind, 1).otherwise(0)).alias(kind)
    star = F.when(t == "purchase", 1 + F.floor(F.col("value")) % 5).otherwise(0)
    # one row per visitor first: visitor counts become plain sums
    per = e.groupBy("day", "country_name", "activity_id", "visitor_id").agg(
        *[n(k) for k in ("click", "view", "purchase", "signup", "error")], F.sum(star).alias("stars"))
    total = lambda c, name: F.sum(c).alias(name)
    seen = lambda c, name: F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(name)
    return per.groupBy("day", "country_name", "activity_id").agg(
        F.count(F.lit(1)).alias("visitors"), total("click", "clicks"), total("view", "impressions"), seen("purchase", "customers"),
        total("purchase", "bookings"), seen("signup", "add_to_cart_visitors"), seen("error", "unavailability_visitors"),
        total("stars", "stars"), total("purchase", "reviews")).withColumn("supplier_id", F.col("activity_id") % 10)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """One session per visitor and day, with the touched activities as arrays.

    A day's arrays hold distinct activities of one visitor only.
    """
    e = events(spark, root)
    t, k = F.col("event_type"), F.col("activity_id")
    firsts = e.groupBy("visitor_id").agg(F.min("day").alias("first_day"))
    s = e.groupBy("visitor_id", "day").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.when(t == "view", 1).otherwise(0)).alias("detail_views"),
        F.nullif(F.collect_set(F.when(t == "click", k)), F.array().cast("array<bigint>")).alias("checked_ids"),
        F.collect_set(F.when(t == "signup", k)).alias("cart_ids"),
        F.max(F.when(t == "purchase", 1).otherwise(0)).alias("purchased"))
    s = s.join(firsts, "visitor_id").join(customer_dim(spark, root, "country_name", "region_name"), "visitor_id")
    return s.select("visitor_id", "day", "country_name", "region_name",
                    F.concat_ws("-", "visitor_id", F.date_format("day", "yyyyMMdd")).alias("session_id"),
                    "detail_views", "checked_ids", "cart_ids", (F.col("purchased") == 1).alias("purchased"),
                    (F.col("n_events") == 1).alias("is_bounce"),
                    (F.col("day") == F.col("first_day")).alias("is_new_visitor"))


def competitor_prices(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Own price beside two competitors, with the checks that decide whether a row counts."""
    o, li = orders(spark, root, ranges), lineitem(spark, root)
    own = F.col("l_extendedprice") / F.col("l_quantity")

    def rival(name, salt):
        k = (F.col("l_orderkey") + salt) % 5
        has = (F.col("l_linenumber") + salt) % 4 != 0
        acc = (F.col("l_orderkey") + salt) % 7
        return [F.when(has, own * (0.9 + 0.05 * k)).alias(f"{name}_price"),
                F.when(has, (k == 2).cast("int")).alias(f"{name}_meet"),
                F.when(has, (k > 2).cast("int")).alias(f"{name}_beat"),
                ((F.col("l_partkey") + salt) % 3 != 0).alias(f"{name}_valid"),
                F.when(acc == 0, "Inaccurate").when(acc < 4, "Accurate").alias(f"{name}_accuracy")]

    c = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.to_date("o_orderdate").alias("snapshot_date"), F.col("l_partkey").alias("activity_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("impressions"),
        own.alias("own_price"), F.when(F.col("l_linestatus") == "O", "active").otherwise("paused").alias("own_status"),
        *rival("alpha", 0), *rival("beta", 1),
        F.when(F.col("l_orderkey") % 5 == 2, "meet").when(F.col("l_orderkey") % 5 > 2, "beat")
        .otherwise("lose").alias("overall"))
    return c.join(supplier_dim(spark, root, "country_name"), "supplier_id")


def accuracy_history(spark: SparkSession, root: str) -> DataFrame:
    """Status log of the competitor price match, many rows per option and week."""
    return lineitem(spark, root).select(
        F.col("l_partkey").alias("activity_id"), F.col("l_suppkey").alias("supplier_id"),
        F.to_date("l_shipdate").alias("snapshot_date"), F.col("l_orderkey").alias("log_id"),
        F.when(F.col("l_orderkey") % 11 == 0, "Inaccurate data").otherwise("OK").alias("alpha_status"),
        F.when(F.col("l_orderkey") % 13 == 0, "Inaccurate Data").when(F.col("l_orderkey") % 13 < 9, "OK").alias("beta_status"))


def slot_configs(spark: SparkSession, root: str) -> DataFrame:
    """Slots with their price configuration as JSON text, built row by row."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    money = lambda c: F.coalesce((F.floor(c * 1000) / 1000).cast("decimal(10,3)").cast("string"), F.lit("null"))
    tier = lambda size_name, n: text(f'{{"{size_name}":{n},"retailPrice":', F.col(f"p{n}"), "}")
    three = F.col("l_linenumber") % 3
    tiers = lambda name: F.when(three == 0, F.concat_ws(",", tier(name, 1), tier(name, 2), tier(name, 3))).when(
        three == 1, tier(name, 1)).otherwise(F.concat_ws(",", tier(name, 1), tier(name, 2)))
    cat = lambda label, prices: text(f'{{"ticketCategory":"{label}","prices":[', prices, "]}")
    adult = cat("ADULT", F.col("adult_tiers"))
    child = cat("CHILD", tier("minParticipants", 2))
    senior = cat("SENIOR", tier("minParticipants", 3))
    array = lambda *items: text("[", F.concat_ws(",", *items), "]")
    individual = (F.when(F.col("l_returnflag") == "A", array(adult))
                  .when(F.col("l_returnflag") == "N", array(adult, child))
                  .when(F.col("l_linenumber") <= 4, array(adult, child, senior)).otherwise("null"))
    group = F.when(F.col("l_linestatus") == "O", array(
        text('{"isAdditionalPaxForGroup":false,"prices":[', tiers("maxParticipants"), "]}"))).otherwise("null")
    addon = lambda n: text('{"prices":[{"retailPrice":', money(price / n), "}]}")
    addons = F.when(F.col("l_discount") >= 0.05, array(addon(10), addon(20))).otherwise("null")
    rest = ['"group":', F.col("group"), ',"addons":', F.col("addons")]
    nested = text('{"pricingCategories":{"individual":', F.col("individual"), ",", *rest, "}}")
    flat = text('{"pricingCategories":{"individual":', F.col("individual"), "},", *rest, "}")
    # columns of their own for what is used several times; written as text, as the tree-to-JSON function takes 80 us a row
    items = (lineitem(spark, root).withColumns({f"p{n}": money(price / n) for n in (1, 2, 3)})
             .withColumn("adult_tiers", tiers("minParticipants"))
             .withColumns({"individual": individual, "group": group, "addons": addons}))
    return items.select(
        F.col("l_partkey").alias("activity_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("pricing_id"), F.col("l_orderkey").alias("update_seq"),
        F.to_date("l_shipdate").alias("slot_date"), price.alias("from_price"),
        F.when(F.col("l_orderkey") % 4 == 0, flat).otherwise(nested).alias("details"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("int") * 900).alias("cutoff_seconds"),
        F.when(F.col("l_linenumber") != 2, (F.col("l_quantity") / 25).cast("int")).alias("min_participants"),
        F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("int")).alias("max_participants"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(F.col("l_linenumber")).cast("int").alias("vacancies"),
        F.when(F.col("l_tax") > 0.03, 9999999).cast("int").alias("max_vacancies"),
        (F.col("l_tax") >= 0.08).alias("api_prices"), (F.col("l_tax") == 0.07).alias("live_prices"),
        (F.col("l_tax") == 0.06).alias("api_scales"))


def supplier_actions(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Suggested actions shown to suppliers."""
    o, li = orders(spark, root, ranges), lineitem(spark, root)
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    status = (F.when((s == "F") & (f == "A"), "resolved").when((s == "F") & (f == "N"), "expired")
              .when(f == "R", "dismissed").otherwise("active"))
    surfaced = F.to_date("o_orderdate")
    days = F.abs(F.datediff(F.to_date("l_shipdate"), surfaced)) % 90
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("supplier_id"), F.col("o_orderpriority").alias("action_type"),
        status.alias("status"), surfaced.alias("surfaced_at"),
        F.when(status == "resolved", F.date_add(surfaced, days)).alias("resolved_at"),
        F.when((status == "dismissed") & (F.col("l_linenumber") > 1),
               F.concat(F.lit("reason "), F.col("l_linenumber").cast("string"))).alias("dismissal_reason"))


def supplier_days(spark: SparkSession, root: str, ranges=None) -> DataFrame:
    """Portal logins per supplier and day."""
    li = lineitem(spark, root)
    cond = in_ranges(F.col("l_shipdate"), ranges)
    li = li if cond is None else li.filter(cond)
    return li.select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("supplier_id"),
                     (F.col("l_linenumber") % 3).alias("logins"),
                     (F.col("l_linestatus") == "O").alias("is_active"))
