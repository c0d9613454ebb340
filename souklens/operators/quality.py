"""Data checks and reconciliation as tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.functions.ratios import flag


def _row(name: str, ok: Column, found: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), F.when(ok, "PASS").otherwise("FAIL").alias("result"),
                    found.cast("string").alias("found"))


def _one_pass(df: DataFrame, checks: list[tuple[str, Column, object]]) -> DataFrame:
    """All rules of a table in one aggregate: counts of offending rows, then one row per rule."""
    g = df.agg(*[agg.alias(f"a{i}") for i, (_, agg, _) in enumerate(checks)])
    rows = [_row(n, ok(F.col(f"a{i}")), F.col(f"a{i}")) for i, (n, _, ok) in enumerate(checks)]
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bad_rows(cond: Column) -> Column:
    """Rows that violate ``cond``; unknown counts as a violation."""
    return F.sum(flag(~F.coalesce(cond, F.lit(False))))


zero = lambda c: F.coalesce(c, F.lit(0)) == 0


def frame_checks(frame: DataFrame, name: str, units: int, weeks: int, event: date) -> DataFrame:
    """Units present, weeks per unit and balanced sides of one frame."""
    per = frame.groupBy("country_name").agg(F.countDistinct("week_start").alias("w"),
                                            F.countDistinct(F.when(F.col("week_start") < F.lit(event), F.col("week_start"))).alias("pre"))
    return _one_pass(per, [
        (f"{name}: {units} units present", F.count(F.lit(1)), lambda c: c == units),
        (f"{name}: {weeks} weeks per unit", bad_rows(F.col("w") == weeks), zero),
        (f"{name}: same number of weeks before and after", bad_rows(F.col("pre") * 2 == F.col("w")), zero)])


def panel_checks(panel: DataFrame, no_nulls: list[str], bounds: dict[str, tuple[float, float]],
                 not_above: dict[str, tuple[str, float]]) -> DataFrame:
    """Missing values, bounds, and columns that may not exceed another (times a tolerance); one pass over the panel."""
    rules = [(f"{c} has no missing value", bad_rows(F.col(c).isNotNull()), zero) for c in no_nulls]
    rules += [(f"{c} in [{lo}, {hi}]", F.sum(flag(~F.col(c).between(lo, hi))), zero) for c, (lo, hi) in bounds.items()]
    rules += [(f"{a} <= {b}", bad_rows(F.col(a) <= k * F.col(b)), zero) for a, (b, k) in not_above.items()]
    return _one_pass(panel, rules)


def unique_check(df: DataFrame, key: str) -> DataFrame:
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _one_pass(dup, [(f"{key} is unique", F.sum(flag(F.col("n") > 1)), zero)])


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], ok: float = 0.01, check: float = 0.05) -> DataFrame:
    """Largest relative difference per metric between two tables, and a verdict; a row that only one has is a mismatch."""
    one, two = F.lit(True).alias("_a"), F.lit(True).alias("_b")
    j = a.select(*keys, one, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(
        b.select(*keys, two, *[F.col(m).alias(f"b_{m}") for m in metrics]), keys, "full")
    g = j.agg(F.sum(flag(F.col("_a") & F.col("_b"))).alias("n"), F.sum(flag(F.col("_b").isNull())).alias("l"), F.sum(flag(F.col("_a").isNull())).alias("r"), *[
        F.max(F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")) / F.nullif(F.abs(f"b_{m}"), F.lit(0.0))).alias(m) for m in metrics])
    long = g.unpivot(["n", "l", "r"], metrics, "metric", "max_rel_diff")
    d = F.col("max_rel_diff")
    verdict = F.when(F.col("l") + F.col("r") > 0, "MISMATCH").when(d < ok, "OK").when(d < check, "check").otherwise("MISMATCH")
    return long.select("metric", F.coalesce("n", F.lit(0)).alias("matched_rows"), F.coalesce("l", F.lit(0)).alias("only_left"), F.coalesce("r", F.lit(0)).alias("only_right"), "max_rel_diff", verdict.alias("verdict"))


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], buckets: int = 4096) -> DataFrame:
    """Rows of two sources that don't agree: keys, ``a_*`` and ``b_*`` values, and which side has the key.

    Each source is first reduced to a count and two checksums per bucket of keys, so what agrees is neither
    joined nor shuffled as rows; only keys of the buckets that differ are compared one by one. Keys are unique
    within a source and compare null-safe; values are compared exactly, so amounts should be whole numbers.
    """
    parts = lambda df: df.select(*keys, *values, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"))
    mark = lambda seed: F.sum(F.xxhash64(*keys, *values, F.lit(seed)).cast("decimal(20,0)"))
    sums = lambda df, side: df.groupBy("_bucket").agg(F.struct(F.count(F.lit(1)), mark(1), mark(2)).alias(f"_{side}"))
    one, two = parts(a), parts(b)
    open_ = sums(one, "a").join(sums(two, "b"), "_bucket", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket")
    side = lambda df, name: df.join(F.broadcast(open_), "_bucket", "left_semi").select(  # noqa: E731  a row per bucket at most
        *[F.col(k).alias(f"{name}_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"{name}_{v}") for v in values], F.lit(True).alias(f"_{name}"))
    same = [F.col(f"a_k{i}").eqNullSafe(F.col(f"b_k{i}")) for i in range(len(keys))]
    j = side(one, "a").join(side(two, "b"), same, "full")
    equal = [F.col("_a") & F.col("_b")] + [F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values]
    found = F.when(F.col("_b").isNull(), "only in a").when(F.col("_a").isNull(), "only in b").otherwise("differs")
    bad = ~F.coalesce(F.array_min(F.array(*equal)), F.lit(False))
    return j.filter(bad).select(*[F.coalesce(f"a_k{i}", f"b_k{i}").alias(k) for i, k in enumerate(keys)],
                                *[F.col(f"{n}_{v}") for v in values for n in ("a", "b")], found.alias("found"))
