"""Feature adoption and its relation to outcomes.

Input is one row per listing: 0/1 feature columns, outcomes and descriptive columns.
Feature columns are turned into rows with ``unpivot`` once, so that any number of
features costs a single aggregation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.labels import depth_level, size_band
from souklens.functions.ordering import ordered
from souklens.functions.quantiles import GROUP, exact_quantiles, quantile_values
from souklens.functions.ratios import flag, ratio, share_pct
from souklens.functions.skew import broadcast_if_small
from souklens.functions.storage import materialise


def feature_rows(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row per listing and feature: ``feature``, ``has`` and the kept columns."""
    return df.select(*keep, *[F.col(f).cast("int").alias(f) for f in features]).unpivot(keep, features, "feature", "has")


def _avg(cond: Column, c: str) -> Column:
    return F.avg(F.when(cond, F.col(c)))



def _sides() -> tuple[Column, Column]:
    return F.col("has") == 1, F.col("has") == 0


def lift_pct(a: Column, b: Column) -> Column:
    return (a / F.nullif(b, F.lit(0.0)) - 1) * 100


def raw_lift(df: DataFrame, features: list[str], value: str, order_value: str) -> DataFrame:
    """Mean outcome with and without a feature, adoption, and what the rest could gain."""
    w, o = _sides()
    g = feature_rows(df, features, [value, order_value]).groupBy("feature").agg(
        F.sum(flag(w)).alias("n_with"), F.sum(flag(o)).alias("n_without"),
        _avg(w, value).alias("mean_with"), _avg(o, value).alias("mean_without"),
        _avg(w, order_value).alias("aov_with"), _avg(o, order_value).alias("aov_without"))
    c = F.col
    lift = lift_pct(c("mean_with"), c("mean_without"))
    return g.withColumns({
        "adoption_pct": share_pct(c("n_with"), c("n_with") + c("n_without")), "lift_pct": lift,
        "aov_lift_pct": lift_pct(c("aov_with"), c("aov_without")),
        "potential": c("n_without") * c("mean_without") * lift / 100})


def opportunity_score(lifts: DataFrame, difficulty: dict[str, int], default: int = 2) -> DataFrame:
    """(potential in millions × lift) / (difficulty × adoption, at least 10), with priority
    and the running total of potential from the largest."""
    d = None
    for f, v in difficulty.items():
        d = F.when(F.col("feature") == f, v) if d is None else d.when(F.col("feature") == f, v)
    pot = F.col("potential") / 1e6
    score = pot * F.col("lift_pct") / (F.col("difficulty") * F.greatest(F.col("adoption_pct"), F.lit(10.0)))
    # one row per feature: the feature list is the caller's literal list
    w = Window.orderBy(F.desc("potential"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return (lifts.withColumn("difficulty", (F.lit(default) if d is None else d.otherwise(default)))
            .withColumn("score", score)
            .select("feature", "difficulty", pot.alias("potential_m"), "lift_pct", "adoption_pct", "score",
                    F.when(F.col("score") > 100, "P0").when(F.col("score") > 50, "P1").otherwise("P2").alias("priority"),
                    F.sum(pot).over(w).alias("cumulative_m")))


PRIME = 2147483647   # fixed value: modulus of the replicate hash


# fixed values: cumulative Poisson(1) probabilities for 0..6
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991675]


#: Rows whose weights are held at once: 0.8 MB of them, so that the steps stay in a core's cache.
BOOT_ROWS = 256
#: The smallest hash whose share of ``PRIME`` reaches each probability, as doubles compare.
BOOT_STEPS = [next(t for t in range(int(p * PRIME) - 2, PRIME) if t / float(PRIME) >= p) for p in POISSON]


def _modulo(t: np.ndarray) -> np.ndarray:
    """``t`` modulo ``PRIME`` for 0 <= t < 2 ** 63, in place, by adding the halves, as the modulus is a power of two less one."""
    high = np.empty_like(t)
    for _ in range(2):
        np.right_shift(t, 31, out=high)
        t &= PRIME
        t += high
    # without a sign: what is below zero is the larger one
    np.subtract(t, PRIME, out=high)
    return np.minimum(t, high, out=t)


def bootstrap_weights(key: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson weights, one row per key (reduced modulo ``PRIME``) and one column per replicate, from whole-number steps only."""
    k, r = key.astype(np.uint64)[:, None], np.arange(1, replicates + 1, dtype=np.uint64)[None, :]
    t = _modulo((k * 48271 + 1) + r * 69621)
    for step in (r * 40692 + k, k * 16807):
        t *= t
        t += step
        t = _modulo(t)
    short, weight = t.astype(np.uint32), np.zeros(t.shape, np.int8)
    for step in BOOT_STEPS:
        weight += short >= step
    return weight.astype(np.float64)


def bootstrap_lift(df: DataFrame, key: str, features: list[str], outcome: str, replicates: int = 400,
                   trim: float = 0.01, min_side: int = 200) -> DataFrame:
    """Mean lift with a 95 % interval from Poisson bootstrap weights.

    Outcomes are clipped at their 1 % and 99 % points per feature side. Each row draws its
    weight for every replicate from its own key (rows without a key draw none), so replicates
    are independent of partitioning. Rows are not repeated: a block of rows is a matrix of weights, multiplied
    by the clipped outcomes of every feature side, and each task gives one row of sums per replicate.
    """
    base = materialise(df.filter(F.col(outcome).isNotNull()).select(key, outcome, *features))
    rows = feature_rows(base, features, [outcome])
    caps = exact_quantiles(rows, outcome, {"lo": trim, "hi": 1 - trim}, ["feature", "has"])
    n = rows.groupBy("feature", "has").agg(F.count(F.lit(1)).alias("n"))
    # two rows per feature reach the driver and become literals
    side = {(r["feature"], r["has"]): r for r in caps.join(n, ["feature", "has"]).collect()}
    usable = [f for f in features if all((f, h) in side and side[f, h]["n"] >= min_side for h in (0, 1))]
    schema = "feature string, lift_mean_pct double, ci_low_pct double, ci_high_pct double, n_with bigint, n_without bigint"
    if not usable:
        return df.sparkSession.createDataFrame([], schema)
    sides = [(f, h) for f in usable for h in (0, 1)]
    x = F.col(outcome).cast("double")
    clip = lambda r: F.least(F.greatest(x, F.lit(r["lo"])), F.lit(r["hi"]))
    # per side the clipped outcome and 1; nothing where the row is on the other side
    cells = [e for f, h in sides for e in (F.when(F.col(f) == h, clip(side[f, h])), F.when(F.col(f) == h, 1.0))]
    blocks = base.select(F.pmod(F.col(key), F.lit(PRIME)).cast("long").alias("k"), *[F.coalesce(e, F.lit(0.0)).alias(f"c{i}") for i, e in enumerate(cells)])
    blocks = blocks.filter("k IS NOT NULL")
    names = [f"{s}{h}_{f}" for f, h in sides for s in "sw"]
    width = len(names)

    def fold(batches):
        total = np.zeros((replicates, width))
        for batch in batches:
            keys = batch.column(0).to_numpy()
            values = np.column_stack([batch.column(i + 1).to_numpy() for i in range(width)])
            for at in range(0, len(keys), BOOT_ROWS):
                total += bootstrap_weights(keys[at:at + BOOT_ROWS], replicates).T @ values[at:at + BOOT_ROWS]
        columns = [pa.array(np.arange(1, replicates + 1), pa.int64()), *[pa.array(total[:, i]) for i in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["r", *names])

    parts = blocks.mapInArrow(fold, "r bigint, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in names])
    mean = lambda h, f: F.col(f"s{h}_{f}") / F.nullif(F.col(f"w{h}_{f}"), F.lit(0.0))
    long = s.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), mean(1, f).alias("a"), mean(0, f).alias("b"), F.lit(side[f, 1]["n"]).cast("bigint").alias("n_with"),
        F.lit(side[f, 0]["n"]).cast("bigint").alias("n_without")) for f in usable])).alias("x")).select("x.*").filter("b > 0")
    long = long.withColumn("lift", lift_pct(F.col("a"), F.col("b")))
    # at most ``replicates`` values per feature
    return long.groupBy("feature").agg(
        F.avg("lift").alias("lift_mean_pct"), F.percentile("lift", 0.025).alias("ci_low_pct"),
        F.percentile("lift", 0.975).alias("ci_high_pct"), F.max("n_with").alias("n_with"), F.max("n_without").alias("n_without"))


def top_values(df: DataFrame, col: str, n: int, other: str) -> DataFrame:
    """Adds ``<col>_top``: the ``n`` most frequent values, everything else as ``other``."""
    top = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), col).limit(n)
    names = [r[0] for r in top.select(col).collect()]     # n values at most
    return df.withColumn(f"{col}_top", F.when(F.col(col).isin(names), F.col(col)).otherwise(other))


def stratified_lift(df: DataFrame, features: list[str], outcome: str, strata: list[str], min_side: int = 40) -> DataFrame:
    """Lift of mean and median inside every stratum with enough rows on both sides."""
    held = df.filter(F.col(outcome).isNotNull()).select(*strata, outcome, *features)
    keys = ["feature", *strata]
    w, o = _sides()
    g = feature_rows(held, features, [*strata, outcome]).groupBy(*keys).agg(
        F.sum(flag(w)).alias("n_with"), F.sum(flag(o)).alias("n_without"), _avg(w, outcome).alias("_mw"), _avg(o, outcome).alias("_mo"))
    g = g.filter((F.col("n_with") >= min_side) & (F.col("n_without") >= min_side))
    j = g.join(side_medians(held, features, outcome, strata), keys)
    return j.select(*keys, "n_with", "n_without", lift_pct(F.col("_mw"), F.col("_mo")).alias("lift_mean_pct"),
                    lift_pct(F.col("_dw"), F.col("_do")).alias("lift_median_pct"),
                    (F.col("n_with") + F.col("n_without")).alias("weight"))


def side_medians(held: DataFrame, features: list[str], outcome: str, strata: list[str], group: int = GROUP) -> DataFrame:
    """Median outcome with (``_dw``) and without (``_do``) every feature per stratum, where there are both.

    Rows of strata of up to ``group`` rows are dealt out by stratum once, not once per feature; only larger strata, at most
    (number of rows / ``group``), are turned into a row per feature.
    """
    keys = ["feature", *strata]
    n = held.groupBy(*[F.col(k).alias(f"_l_{k}") for k in strata]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group)
    large = broadcast_if_small(materialise(n))
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in strata]
    median = lambda f, h: F.percentile(F.when(F.col(f).cast("int") == h, F.col(outcome)), 0.5)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"w{i}").alias("_dw"), F.col(f"o{i}").alias("_do")) for i, f in enumerate(features)]))
    few = held.join(large, same, "left_anti").repartition(*strata).groupBy(*strata).agg(
        *[median(f, h).alias(f"{s}{i}") for i, f in enumerate(features) for s, h in (("w", 1), ("o", 0))])
    few = few.select(*strata, cells.alias("_x")).select("_x.feature", *strata, "_x._dw", "_x._do").filter("_dw IS NOT NULL AND _do IS NOT NULL")
    if large.isEmpty():
        return few
    med = exact_quantiles(feature_rows(held.join(large, same, "left_semi"), features, [*strata, outcome]), outcome, {"m": 0.5}, [*keys, "has"])
    at = lambda h: F.max(F.when(F.col("has") == h, F.col("m")))
    many = med.groupBy(*keys).agg(at(1).alias("_dw"), at(0).alias("_do")).filter("_dw IS NOT NULL AND _do IS NOT NULL")
    return few.unionByName(many)


def segment_lift(df: DataFrame, features: list[str], segment: str, outcome: str, order_value: str) -> DataFrame:
    """With/without means per segment, for segments that have both sides."""
    w, o = _sides()
    g = feature_rows(df, features, [segment, outcome, order_value]).groupBy(segment, "feature").agg(
        F.sum(flag(w)).alias("n_with"), F.sum(flag(o)).alias("n_without"), _avg(w, outcome).alias("avg_with"),
        _avg(o, outcome).alias("avg_without"), _avg(w, order_value).alias("aov_with"), _avg(o, order_value).alias("aov_without"))
    g = g.filter((F.col("n_with") > 0) & (F.col("n_without") > 0))
    return g.withColumns({"adoption_pct": share_pct(F.col("n_with"), F.col("n_with") + F.col("n_without")),
                          "lift_pct": lift_pct(F.col("avg_with"), F.col("avg_without"))})


def segment_lift_matrix(df: DataFrame, features: list[str], segment: str, outcome: str, top: int = 8, min_side: int = 120) -> DataFrame:
    """Lift per feature and large segment as a wide matrix; thin cells are NULL."""
    t = top_values(df, segment, top, "")
    t = t.filter(F.col(f"{segment}_top") != "")
    w, o = _sides()
    g = feature_rows(t, features, [segment, outcome]).groupBy(segment, "feature").agg(
        F.sum(flag(w & F.col(outcome).isNotNull())).alias("a"), F.sum(flag(o & F.col(outcome).isNotNull())).alias("b"),
        _avg(w, outcome).alias("mw"), _avg(o, outcome).alias("mo"))
    cell = F.when((F.col("a") >= min_side) & (F.col("b") >= min_side) & (F.col("mo") > 0), lift_pct(F.col("mw"), F.col("mo")))
    return g.withColumn("cell", cell).groupBy(segment).pivot("feature", features).agg(F.max("cell"))


def adoption_by_group(df: DataFrame, features: list[str], keys: list[str], value: str) -> DataFrame:
    return feature_rows(df, features, [*keys, value]).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_value"), (F.avg("has") * 100).alias("adoption_pct"))


def supplier_adoption(df: DataFrame, features: list[str], keys: list[str], value: str) -> DataFrame:
    """Suppliers adopt a feature when any of their listings has it."""
    return df.groupBy("supplier_id", *keys).agg(
        *[F.max(f).alias(f) for f in features], F.sum(value).alias("supplier_value"), F.count(F.lit(1)).alias("listings"))


def reach_activation(df: DataFrame, features: dict[str, Column | None], keys: list[str], value: str) -> DataFrame:
    """Eligible share, adoption among eligible rows, and the same weighted by value.

    ``features`` maps a 0/1 column to its eligibility rule; no rule means everyone.
    """
    cols = []
    for f, rule in features.items():
        ok = F.lit(True) if rule is None else rule
        cols.append(F.struct(F.lit(f).alias("feature"), ok.alias("ok"), F.col(f).cast("int").alias("has")))
    # the suppliers of a group are the same for every feature: they are counted before rows are repeated
    sellers = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.countDistinct("supplier_id").alias("suppliers"))
    rows = df.select(*keys, F.col(value).alias("v"), F.explode(F.array(*cols)).alias("f")).select(*keys, "v", "f.*")
    ok = F.col("ok")
    v = F.coalesce(F.col("v"), F.lit(0.0))
    cond = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return rows.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("listings"), F.sum(v).alias("total_value"),
        share_pct(F.sum(flag(ok)), F.count(F.lit(1))).alias("reach_pct"),
        share_pct(F.sum(F.when(ok, F.col("has"))), F.sum(flag(ok))).alias("activation_pct"),
        share_pct(F.sum(F.when(ok, F.col("has") * v)), F.sum(F.when(ok, v))).alias("activation_value_pct")).join(sellers, cond).select(
        *keys, "feature", "listings", "suppliers", "total_value", "reach_pct", "activation_pct", "activation_value_pct")


def group_delta(reach: DataFrame, group: str, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Activation of group ``a`` minus group ``b`` in percent points."""
    at = lambda g: F.max(F.when(F.col(group) == g, F.col("activation_pct")))
    return reach.groupBy(*(keys or []), "feature").agg(at(a).alias("activation_a"), at(b).alias("activation_b"),
                                                       (at(a) - at(b)).alias("delta_pp"))


def conditional_split(df: DataFrame, eligible: Column, feature: str, bucket: str) -> DataFrame:
    return df.filter(eligible).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), (F.avg(feature) * 100).alias("with_pct"),
                                                   (100 - F.avg(feature) * 100).alias("without_pct"))


def market_outliers(df: DataFrame, feature: str, market: str, min_n: int, top: int) -> DataFrame:
    """Adoption of the largest markets against the whole cohort's adoption."""
    g = df.groupBy(market).agg(F.count(F.lit(1)).alias("n"), F.sum(feature).alias("s"))
    w = Window.partitionBy()      # one row per market
    g = g.withColumn("cohort_pct", 100.0 * F.sum("s").over(w) / F.sum("n").over(w))
    g = g.filter(F.col("n") >= min_n).orderBy(F.desc("n"), market).limit(top)
    pct = 100.0 * F.col("s") / F.col("n")
    return g.select(market, "n", pct.alias("adoption_pct"), "cohort_pct", (pct - F.col("cohort_pct")).alias("gap_pp"))


def value_tiers(df: DataFrame, value: str, probs: list[float], labels: list[str], zero: str, out: str) -> DataFrame:
    """Tiers at quantiles of the positive values; zero and missing values form their own."""
    cuts = quantile_values(df.filter(F.col(value) > 0), value, probs)
    col = F.when(F.coalesce(F.col(value), F.lit(0.0)) <= 0, zero)
    for q, lab in zip(cuts, labels):
        col = col.when(F.col(value) <= F.lit(q), lab)
    return df.withColumn(out, col.otherwise(labels[-1]))


QUARTILES = ["Q1", "Q2", "Q3", "Q4"]   # fixed values


def quartiles_within(df: DataFrame, segment: str, value: str, out: str = "quartile") -> DataFrame:
    """Value quartile of every row among the positive rows of its own segment."""
    cuts = exact_quantiles(df.filter(F.col(value) > 0), value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, [segment])
    v = F.col(value)
    tier = (F.when(F.coalesce(v, F.lit(0.0)) <= 0, "none").when(v <= F.col("q1"), "Q1").when(v <= F.col("q2"), "Q2")
            .when(v <= F.col("q3"), "Q3").otherwise("Q4"))
    return df.join(broadcast_if_small(cuts), segment, "left").withColumn(out, tier).drop("q1", "q2", "q3")


def quartile_gap(df: DataFrame, features: list[str], segment: str) -> DataFrame:
    """Adoption in the top minus the bottom value quartile; needs ``quartile``."""
    at = lambda q: F.avg(F.when(F.col("quartile") == q, F.col("has"))) * 100
    return feature_rows(df, features, [segment, "quartile"]).groupBy(segment, "feature").agg(
        at("Q1").alias("bottom_pct"), at("Q4").alias("top_pct"), (at("Q4") - at("Q1")).alias("gap_pp"))


def combo_label(features: dict[str, str]) -> Column:
    """Sorted names of the features a row has, joined by plus signs."""
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(n)) for n, c in features.items()]))
    text = F.array_join(F.array_sort(names), " + ")
    return F.when(text == "", "No features").otherwise(text)


def feature_combinations(df: DataFrame, features: dict[str, str], segment: str, value: str) -> DataFrame:
    w = Window.partitionBy(segment)      # at most 2^features combinations per segment
    g = df.withColumn("combination", combo_label(features)).groupBy(segment, "combination").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_value"))
    return g.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(w))


def count_distribution(df: DataFrame, features: list[str], segment: str) -> DataFrame:
    """Share of rows with 0, 1, 2-3 and 4 or more features."""
    n = sum((F.col(f) for f in features), F.lit(0))
    b = df.withColumn("_n", n)
    share = lambda cond: F.avg(flag(cond)) * 100
    c = F.col("_n")
    return b.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), share(c == 0).alias("pct_0"), share(c == 1).alias("pct_1"),
                                  share(c.between(2, 3)).alias("pct_2_3"), share(c >= 4).alias("pct_4_plus"),
                                  F.avg("_n").alias("avg_features"))


def config_depth(df: DataFrame, metrics: dict[str, tuple[str, int]], segment: str) -> DataFrame:
    """Items per listing among suppliers that use a feature at all.

    ``metrics`` maps a name to (count column, smallest count that makes an adopter). Adds
    the listing-weighted mean over segments and its depth class.
    """
    c, keys = F.col, [segment, "metric"]
    cells = lambda item: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *item(i, m, col)) for i, (m, (col, _)) in enumerate(metrics.items())])).alias("f")
    # one row per supplier and segment; listings are told apart by their numbers of items only
    held = materialise(df.groupBy(segment, "supplier_id", *{col: 0 for col, _ in metrics.values()}).agg(F.count(F.lit(1)).alias("_n")))
    use = held.groupBy("supplier_id").agg(*[F.max(flag(c(col) >= n)).alias(f"_u_{m}") for m, (col, n) in metrics.items()])
    j = held.join(use, "supplier_id").select(segment, "supplier_id", "_n", cells(
        lambda i, m, col: [c(f"_u_{m}").alias("adopter"), c(col).cast("double").alias("items")])).select(segment, "supplier_id", "_n", "f.*")
    rows = materialise(j.groupBy(*keys, "supplier_id", "adopter", "items").agg(F.sum("_n").alias("_n")))
    per = rows.groupBy(*keys, "supplier_id").agg(F.max("adopter").alias("adopter"), F.sum("_n").alias("_n"),
                                                 F.sum(F.col("items") * F.col("_n")).alias("_s"), F.sum(F.when(F.col("items").isNotNull(), F.col("_n"))).alias("_k"))
    base = per.groupBy(*keys).agg(F.count("supplier_id").alias("suppliers"))
    g = per.filter("adopter = 1").groupBy(*keys).agg(F.count("supplier_id").alias("adopters"), F.sum("_n").alias("listings"), F.sum("_s").alias("_s"),
                                                     (F.sum("_s") / F.sum("_k")).alias("mean_items"))
    counted = rows.filter("adopter = 1").groupBy(*keys, "items").agg(F.sum("_n").alias("_n"))
    med = exact_quantiles(materialise(counted), "items", {"median_items": 0.5}, keys, weight="_n")
    w = Window.partitionBy("metric")      # one row per segment
    overall = F.sum("_s").over(w) / F.sum("listings").over(w)
    out = base.join(g, keys).join(med, keys).withColumn("overall_mean", overall)
    return out.select(*keys, "suppliers", "adopters", share_pct(F.col("adopters"), F.col("suppliers")).alias("adoption_pct"),
                      "listings", "mean_items", "median_items", "overall_mean", depth_level(F.col("overall_mean")).alias("depth"))


def quantile_trend(df: DataFrame, x: str, outcomes: list[str], bins: int = 10) -> DataFrame:
    """Means of ``outcomes`` over quantile bins of ``x``; equal edges are merged."""
    edges = sorted(set(quantile_values(df, x, [i / bins for i in range(bins + 1)])))
    cond = None
    for i, e in enumerate(edges[1:]):
        c = F.col(x) <= F.lit(e)
        cond = F.when(c, i) if cond is None else cond.when(c, i)
    return (df.filter(F.col(x).isNotNull()).withColumn("bin", cond if cond is not None else F.lit(0)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), *[F.avg(o).alias(f"mean_{o}") for o in outcomes]))


def fixed_width_trend(df: DataFrame, x: str, outcome: str, width: float, min_n: int = 30) -> DataFrame:
    """Median outcome over fixed-width bins (left-open), bins with enough rows only."""
    b = df.withColumn("bin", F.ceil((F.coalesce(F.col(x), F.lit(0.0)) + 0.01) / width) - 1)
    med = exact_quantiles(b, outcome, {"median_outcome": 0.5}, ["bin"])
    n = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") >= min_n).join(med, "bin", "left")


def feature_count_gradient(df: DataFrame, count: str, value: str, others: list[str]) -> DataFrame:
    return df.groupBy(count).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_value"), F.avg(value).alias("avg_value"),
                                 *[F.avg(o).alias(f"avg_{o}") for o in others])


def market_summary(df: DataFrame, market: str, features: list[str], value: str, opportunities: list[str]) -> DataFrame:
    return df.groupBy(market).agg(
        F.count(F.lit(1)).alias("listings"), F.countDistinct("supplier_id").alias("suppliers"), F.sum(value).alias("total_value"),
        *[F.avg(f).alias(f"adoption_{f}") for f in features], *[F.sum(o).alias(f"total_{o}") for o in opportunities])


def supplier_segmentation(df: DataFrame, value: str, min_listings: int = 3, high: float = 100000.0, mid: float = 50000.0,
                          portfolio: int = 10) -> DataFrame:
    """Rule ladder on value, features and portfolio size, for suppliers with enough listings."""
    c = F.col
    g = df.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("listings"), F.sum(F.coalesce(c(value), F.lit(0.0))).alias("total_value"), F.avg("has_scale").alias("scale_adoption"),
        F.avg("feature_count").alias("avg_features"), F.sum("scale_uplift").alias("scale_opportunity"), F.sum("addon_uplift").alias("addon_opportunity"))
    label = (F.when((c("total_value") >= high) & (c("avg_features") < 2), "VIP - Low Adoption")
             .when((c("total_value") >= mid) & (c("scale_adoption") < 0.5), "High Value - Scale Opportunity")
             .when((c("listings") >= portfolio) & (c("avg_features") < 1.5), "Portfolio - Enable Features").otherwise("Standard"))
    return g.filter(c("listings") >= min_listings).withColumns({
        "total_opportunity": c("scale_opportunity") + c("addon_opportunity"), "segment_label": label})


def size_bands(suppliers: DataFrame) -> DataFrame:
    """Suppliers by number of listings: counts, totals and median value per listing."""
    s = suppliers.withColumn("band", size_band(F.col("listings"))).withColumn("per_listing", F.col("supplier_value") / F.col("listings"))
    g = s.groupBy("band").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("listings").alias("listings"), F.sum("supplier_value").alias("total_value"))
    return g.join(exact_quantiles(s, "per_listing", {"median_per_listing": 0.5}, ["band"]), "band")


def ecdf_by_bucket(df: DataFrame, bucket: str, x: str, min_n: int = 50) -> DataFrame:
    """Empirical distribution at every distinct value, for buckets with enough rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(bucket, x).agg(F.count(F.lit(1)).alias("c"))
    o = ordered(counts, x, keys=[bucket], running={"cum": "c"})
    return o.filter(F.col("cum_total") >= min_n).select(bucket, x, (F.col("cum") / F.col("cum_total")).alias("ecdf"))


def pricing_model() -> Column:
    i, g = F.col("has_individual") == 1, F.col("has_group") == 1
    return (F.when(i & g, "Individual + Group").when(i, "Individual Only").when(g, "Group Only").otherwise("No Pricing Model"))


def pricing_system() -> Column:
    return F.when(F.col("uses_external") == 1, "External API").when(F.col("live_dynamic") == 1, "Live Dynamic").otherwise("Native")


def bundle_label() -> Column:
    base = (F.when((F.col("has_individual") == 1) & (F.col("has_group") == 1), "Flexible").when(F.col("has_individual") == 1, "Individual")
            .when(F.col("has_group") == 1, "Group"))
    extra = [F.when(F.col(c) == 1, n) for c, n in (("has_addons", "Addons"), ("has_scale", "Scale"), ("has_capacity", "Capacity"), ("has_cutoff", "Cutoff"))]
    enh = F.concat_ws("+", *extra)
    none = base.isNull() & (enh == "")
    return F.when(none, "No pricing features").otherwise(
        F.concat_ws(" + ", F.coalesce(base, F.lit("None")), F.nullif(enh, F.lit(""))))


def group_performance(df: DataFrame, key: str, value: str) -> DataFrame:
    """Listings, suppliers, mean, median and total value per label."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("listings"), F.countDistinct("supplier_id").alias("suppliers"),
                            F.avg(value).alias("avg_value"), F.sum(value).alias("total_value"), F.avg("avg_booking_value").alias("avg_aov"),
                            F.avg("bookings_l12m").alias("avg_bookings"))
    return g.join(exact_quantiles(df, value, {"median_value": 0.5}, [key]), key, "left")


def bundle_performance(df: DataFrame, value: str, min_n: int = 200) -> DataFrame:
    """Performance per bundle with shares of listings and value among the bundles kept."""
    b = df.withColumn("bundle", bundle_label())
    g = b.groupBy("bundle").agg(F.count(F.lit(1)).alias("listings"), F.countDistinct("supplier_id").alias("suppliers"),
                                F.sum(value).alias("total_value"), F.sum("bookings_l12m").alias("total_bookings"))
    g = g.filter(F.col("listings") >= min_n).join(exact_quantiles(b, value, {"median_value": 0.5}, ["bundle"]), "bundle", "left")
    w = Window.partitionBy()      # one row per bundle, at most 4 × 16
    return g.withColumns({"listing_share_pct": 100.0 * F.col("listings") / F.sum("listings").over(w),
                          "value_share_pct": 100.0 * F.col("total_value") / F.sum("total_value").over(w)})


# name -> the exact 0/1 state of (individual, group, add-ons, scale); fixed values
COMBINATIONS: dict[str, tuple[int, int, int, int]] = {
    "Individual Only": (1, 0, 0, 0), "Group Only": (0, 1, 0, 0), "Individual + Group (Flexible)": (1, 1, 0, 0),
    "Individual + Addons": (1, 0, 1, 0), "Individual + Scale": (1, 0, 0, 1), "Individual + Addons + Scale": (1, 0, 1, 1),
    "Flexible + Addons": (1, 1, 1, 0), "Group + Addons": (0, 1, 1, 0), "Full Featured": (1, 1, 1, 1)}


def combination_performance(df: DataFrame, value: str, baseline: str = "Individual Only") -> DataFrame:
    """Native listings by exact feature state, against the mean of a baseline state.

    The states exclude each other, so one grouping replaces a scan per state.
    """
    cols = ("has_individual", "has_group", "has_addons", "has_scale")
    label = None
    for name, state in COMBINATIONS.items():
        cond = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(cols, state)))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    d = df.filter(F.col("uses_external") == 0).withColumn("combination", label).filter(F.col("combination").isNotNull())
    g = group_performance(d, "combination", value)
    base = F.max(F.when(F.col("combination") == baseline, F.col("avg_value"))).over(Window.partitionBy())   # nine rows
    return g.withColumn("lift_vs_baseline_pct", lift_pct(F.col("avg_value"), base))


def beside(features: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """A full join of two tables that hold a key once each; NULL keys match nothing.

    Written as a union reduced by key: tables that were dealt out by the keys, or by the same few of them, are not shuffled again,
    and the result is still dealt out that way, for a join on those few. A full join would deal both out by all keys.
    """
    part = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    sides = [d.withColumn("_side", F.when(part, i).otherwise(0)) for i, d in ((1, features), (2, outcomes))]
    u = sides[0].unionByName(sides[1], allowMissingColumns=True)
    rest = [c for c in u.columns if c not in keys and c != "_side"]
    return u.groupBy(*keys, "_side").agg(*[F.max(c).alias(c) for c in rest]).drop("_side")


def with_opportunities(df: DataFrame, value: str) -> DataFrame:
    """Segment, opportunity flags, expected uplift and data quality of a listing.

    Uplift = value × lift × achievable share: 15 % for scale prices and 10 % for add-ons,
    half of it achievable.
    """
    c = F.col
    top2, top3 = c("value_tier").isin("top_tier", "high_value"), c("value_tier").isin("top_tier", "high_value", "medium_value")
    n, native = c("bookings_l12m"), c("uses_external") == 0
    seg = (F.when(c("uses_external") == 1, "external_pricing").when(top2 & (c("feature_count") >= 4), "high_value_full_features")
           .when(top2 & (c("feature_count") <= 1), "high_value_low_features")
           .when((c("value_tier") == "medium_value") & (c("feature_count") <= 2), "medium_value_opportunity")
           .when(n == 0, "no_bookings").otherwise("standard"))
    up = lambda missing, lift: F.when((c(missing) == 0) & (c(value) > 0), c(value) * lift * 0.5).otherwise(0.0)
    return df.withColumns({
        "listing_segment": seg,
        "scale_opportunity": flag((c("has_scale") == 0) & top3 & (n >= 30) & (c("has_individual") == 1) & native),
        "addon_opportunity": flag((c("has_addons") == 0) & top2 & (n >= 20) & native),
        "group_opportunity": flag((c("has_group") == 0) & (c("avg_tickets") >= 3.0) & top3 & (n >= 20) & native),
        "scale_uplift": up("has_scale", 0.15), "addon_uplift": up("has_addons", 0.10),
        "aov_l12m": F.when(n > 0, c(value) / n), "bookings_per_customer": F.when(c("customers_l12m") > 0, n / c("customers_l12m")),
        "data_quality": F.when(c("bookings_lifetime").isNull(), "no_bookings_data").when(c("num_configs") == 0, "no_pricing_config")
        .when(c("avg_dates_covered") < 2, "limited_availability").otherwise("complete")})


def cross_tab(df: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    """Row-normalised percentages; ``values`` lists the wanted columns."""
    p = df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).fillna(0)
    total = reduce(lambda a, b: a + b, (F.col(f"`{v}`") for v in values))
    return p.select(rows, *[(100.0 * F.col(f"`{v}`") / F.nullif(total, F.lit(0))).alias(v) for v in values])


def tier_stats(tiers: DataFrame, keys: list[str], min_activities: int) -> DataFrame:
    """Activities, mean and median tier price per group of at least ``min_activities``."""
    g = tiers.groupBy(*keys).agg(F.countDistinct("activity_id").alias("activities"), F.avg("tier_price").alias("avg_price"))
    med = exact_quantiles(tiers, "tier_price", {"median_price": 0.5}, keys)
    return g.filter(F.col("activities") >= min_activities).join(med, keys)


def metric_union(df: DataFrame, sections: dict[str, dict[str, Column]]) -> DataFrame:
    """Labelled counts and shares ``(section, metric, value, pct)`` from one aggregation."""
    names = [(s, m) for s, ms in sections.items() for m in ms]
    g = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(flag(sections[s][m])).alias(f"m{i}") for i, (s, m) in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"m{i}").alias("value"),
                              share_pct(F.col(f"m{i}"), F.col("_n")).alias("pct")) for i, (s, m) in enumerate(names)])
    return g.select(F.explode(rows).alias("r")).select("r.*")
