"""Features of nested price configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.functions.ratios import flag, ratio, share_pct


def parse_config(df: DataFrame, text: str, ddl: str) -> DataFrame:
    """JSON text to three arrays; older rows keep group and add-on data at the top level."""
    d = df.withColumn("_d", F.from_json(text, ddl))
    return d.withColumns({
        "individual": F.coalesce(F.col("_d.pricingCategories.individual"), F.array()),
        "groups": F.coalesce(F.col("_d.pricingCategories.group"), F.col("_d.group"), F.array()),
        "addons": F.coalesce(F.col("_d.pricingCategories.addons"), F.col("_d.addons"), F.array()),
    }).drop("_d")


def latest_config(slots: DataFrame, keys: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Newest slot row per configuration, and the number of days the configuration covers.

    Rows are dealt out by the keys once and reduced to days first, so the day counts need no distinct;
    the maximum of a struct replaces the sorted window. ``by`` names the keys to deal out by, if later steps group by fewer. Every column of ``slots`` travels: give it those that are read.
    """
    rest = [c for c in slots.columns if c not in keys + order]
    day = slots.repartition(*(by or keys)).withColumn("_day", F.col("slot_date")).groupBy(*keys, "_day").agg(
        F.max(F.struct(*order, *rest)).alias("_r"), F.max(flag(F.col("vacancies").isNotNull())).alias("_v"),
        F.max(flag(F.col("vacancies") > 0)).alias("_a"))
    g = day.groupBy(*keys).agg(
        F.max("_r").alias("_r"), F.count(F.lit(1)).alias("dates_covered"), F.sum("_v").alias("dates_with_vacancies"),
        F.sum("_a").alias("dates_available"), F.min("_day").alias("valid_from"), F.max("_day").alias("valid_to"))
    return g.select(*keys, "_r.*", "dates_covered", "dates_with_vacancies", "dates_available", "valid_from", "valid_to")


def tiers(col: str) -> Column:
    """Number of price tiers over all entries of an array."""
    return F.aggregate(F.col(col), F.lit(0), lambda acc, x: acc + F.size(x["prices"]))


def has_scale(col: str) -> Column:
    return flag(F.exists(F.col(col), lambda x: F.size(x["prices"]) > 1))


def has_category(*names: str) -> Column:
    return flag(F.exists(F.col("individual"), lambda x: F.upper(x["ticketCategory"]).isin(*names)))


PARTS = ["individual", "groups", "addons"]   # fixed values: the arrays of a configuration


def counted_parts(cfg: DataFrame) -> DataFrame:
    """Counts, tiers and scale flags of the three arrays, in place of the arrays: all that features need of them."""
    return cfg.withColumns({
        "num_individual": F.size("individual"), "num_groups": F.size("groups"), "num_addons": F.size("addons"),
        "individual_tiers": tiers("individual"), "group_tiers": tiers("groups"), "addon_tiers": tiers("addons"),
        "scale_individual": has_scale("individual"), "scale_group": has_scale("groups"), "scale_addons": has_scale("addons"),
        "has_adult": has_category("ADULT"), "has_child": has_category("CHILD", "CHILDREN"), "has_senior": has_category("SENIOR")}).drop(*PARTS)


def config_features(cfg: DataFrame) -> DataFrame:
    """Counts, tiers, scale flags, cutoff, participants and capacity per configuration, parsed or already counted."""
    c = F.col
    out = counted_parts(cfg) if set(PARTS) <= set(cfg.columns) else cfg
    return out.withColumns({
        "total_tiers": c("individual_tiers") + c("group_tiers") + c("addon_tiers"),
        "has_individual": flag(c("num_individual") > 0), "has_group": flag(c("num_groups") > 0),
        "has_addons": flag(c("num_addons") > 0),
        "has_scale": F.greatest("scale_individual", "scale_group", "scale_addons"),
        "uses_external": flag(c("api_prices") | c("api_scales")),
        "native_scale": flag((F.greatest("scale_individual", "scale_group", "scale_addons") == 1) & ~F.coalesce("api_scales", F.lit(False))),
        "static_api": flag(c("api_prices") & ~F.coalesce("live_prices", F.lit(False))),
        "live_dynamic": flag(c("live_prices")),
        "cutoff_hours": c("cutoff_seconds") / 3600.0, "has_cutoff": flag(c("cutoff_seconds") > 0),
        "has_min_participants": flag(c("min_participants") > 1), "has_max_participants": flag(c("max_participants").isNotNull()),
        "has_capacity": flag(c("max_vacancies").isNotNull()), "has_slots": flag(c("vacancies") > 0),
        "pct_dates_with_vacancies": share_pct(c("dates_with_vacancies"), c("dates_covered"))})


FLAGS = ["has_individual", "has_group", "has_addons", "has_scale", "has_capacity", "has_cutoff", "has_min_participants",
         "has_max_participants", "uses_external", "native_scale", "static_api", "live_dynamic"]


def retail_price(cfg: DataFrame | None = None) -> Column:
    """Cheapest adult tier, else cheapest tier of a regular group; stays inside the row."""
    prices = lambda arr: F.flatten(F.transform(arr, lambda x: F.transform(x["prices"], lambda p: p["retailPrice"].cast("double"))))
    adult = F.filter(F.col("individual"), lambda x: F.upper(x["ticketCategory"]) == "ADULT")
    group = F.filter(F.col("groups"), lambda x: ~x["isAdditionalPaxForGroup"])
    return F.coalesce(F.array_min(prices(adult)), F.array_min(prices(group)))


def retail_kind() -> Column:
    adult = F.exists(F.col("individual"), lambda x: F.upper(x["ticketCategory"]) == "ADULT")
    group = F.exists(F.col("groups"), lambda x: ~x["isAdditionalPaxForGroup"])
    return F.when(adult, "ADULT_INDIVIDUAL").when(group, "SMALLEST_GROUP")


def parent_feature_rollup(features: DataFrame, keys: list[str]) -> DataFrame:
    """A parent has a feature when any of its configurations has it."""
    key_feats = ["has_scale", "has_addons", "has_group", "has_capacity", "has_cutoff"]
    avg = lambda c: F.avg(c).alias(f"avg_{c}")
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_configs"), *[F.max(f).alias(f) for f in FLAGS],
        *[F.max(f).alias(f) for f in ("has_adult", "has_child", "has_senior")],
        avg("num_individual"), avg("num_groups"), avg("num_addons"), avg("individual_tiers"), avg("group_tiers"),
        avg("addon_tiers"), avg("total_tiers"), avg("cutoff_hours"), avg("dates_covered"), avg("pct_dates_with_vacancies"),
        F.max("num_individual").alias("max_individual"), F.max("num_addons").alias("max_addons"),
        F.max("group_tiers").alias("max_group_tiers"), F.min("valid_from").alias("first_online"),
        sum((F.max(f) for f in key_feats), F.lit(0)).alias("feature_count"))


def tier_rows(cfg: DataFrame, part: str, outer: bool = False) -> DataFrame:
    """One row per price tier of ``part`` (two nested arrays); ``outer`` keeps empty parents."""
    ex = F.explode_outer if outer else F.explode
    one = cfg.withColumn("_x", ex(part))
    one = one.withColumn("_p", ex("_x.prices"))
    extra = {"individual": {"ticket_category": F.col("_x.ticketCategory")},
             "groups": {"max_participants_tier": F.col("_p.maxParticipants")}, "addons": {}}[part]
    return one.withColumns({**extra, "tier_price": F.col("_p.retailPrice").cast("double")}).drop("_x", "_p")


def relational_features(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Option features from long price rows (category, group size range, price).

    The volume discount compares the adult category's cheapest and dearest price.
    """
    c, cat = F.col, F.col("ticket_category")
    scale = F.concat_ws("-", "size_min", "size_max")
    adult = cat == "adult"
    priced = c("price") > 0
    a_max = F.max(F.when(adult & priced, c("price")))
    a_min = F.min(F.when(adult & priced, c("price")))
    breadth = sum((F.max(flag(cat == k)) for k in categories), F.lit(0))
    g = rows.groupBy("activity_id", "option_id").agg(
        F.countDistinct(F.nullif(cat, F.lit(""))).alias("total_categories"), breadth.alias("category_breadth"),
        *[F.max(F.when((cat == k) & (c("size_min") == 1), c("price"))).alias(f"{k}_base_price") for k in categories],
        F.countDistinct(F.when(priced, scale)).alias("total_scales"), F.max(F.when(priced, c("size_max"))).alias("max_group_size"),
        F.countDistinct(F.when(priced & adult, scale)).alias("adult_scales"),
        (100.0 * ratio(a_max - a_min, a_max)).alias("volume_discount_pct"),
        F.max(flag(priced & (c("size_max") > 1))).alias("has_scale"), F.max(flag(priced)).alias("has_price"),
        F.max(flag(c("api_scales"))).alias("api_scales"), F.max(flag(c("api_prices"))).alias("api_prices"))
    return g.withColumn("mechanism", F.when(c("api_scales") == 1, "API_SCALES").when(c("api_prices") == 1, "API_PRICES")
                        .when(c("has_scale") == 1, "CONFIG_SCALES").when(c("has_price") == 1, "CONFIG_PRICES").otherwise("NO_PRICING"))


def relational_rollup(options: DataFrame) -> DataFrame:
    """Activity score from option features: categories, scales, several options, API use."""
    c = F.col
    g = options.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("total_options"), F.max("total_categories").alias("max_categories"),
        F.sum("has_scale").alias("options_with_scale"), F.sum(F.greatest("api_prices", "api_scales")).alias("options_with_api"),
        F.avg("volume_discount_pct").alias("avg_volume_discount_pct"), F.max("max_group_size").alias("max_group_size"))
    score = (flag(c("max_categories") >= 2) + flag(c("options_with_scale") > 0) + flag(c("total_options") > 1)
             + flag(c("options_with_api") > 0))
    return g.withColumn("feature_score", score)
