"""Exact quantiles of groups of any size.

``percentile`` keeps a map of all distinct values of a group in one task, which suits groups
up to a limit. Rows of larger groups are counted by cells of the value, combined before the
shuffle; only rows of the cells that hold a wanted rank go on. They are counted by value, the
counts are accumulated with the bucketed order of :mod:`souklens.functions.ordering`, and only
the one or two values at the wanted ranks are kept. Interpolation is linear between the
neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from souklens.functions.ordering import SMALL, ordered
from souklens.functions.skew import broadcast_if_small
from souklens.functions.storage import materialise

GROUP = 200_000   # values of a group up to which one task holds their counts, about 20 MB
MANY = 128        # groups from which on rows are dealt out by group first, as partial maps of so many groups are sorted
CELLS = 64        # cells of the value per factor of e
PARTS = 1024      # parts of a cell that holds too many rows

Rank = Callable[[Column], Column]   # from the number of values to a wanted place, from 0


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None,
                    weight: str | None = None, small: int | None = None, group: int | None = None) -> DataFrame:
    """One row per key with one column per wanted quantile; NULL values are ignored.

    ``weight`` names a column of whole-number multiplicities, for pre-counted input. Groups of
    more than ``group`` rows take the bucketed way. Calling it costs the count of rows by key.
    """
    keys = list(keys or [])
    group = GROUP if group is None else group
    held = df.filter(F.col(value).isNotNull())
    counted = materialise(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(k).alias(f"_l_{k}") for k in keys], "_n"))
    # at most (number of rows / ``group``) keys
    large = counted.filter(F.col("_n") > group)
    many = counted.count() > MANY
    if large.isEmpty():
        return _in_groups(held, value, probs, keys, weight, many)
    if not keys:
        return _bucketed(held, value, probs, keys, weight, small)
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    large = broadcast_if_small(large)
    return (_in_groups(held.join(large, same, "left_anti"), value, probs, keys, weight, many)
            .unionByName(_bucketed(held.join(large, same, "left_semi"), value, probs, keys, weight, small)))


def _in_groups(held: DataFrame, value: str, probs: dict[str, float], keys: list[str], weight: str | None, many: bool) -> DataFrame:
    q = F.percentile(value, [float(p) for p in probs.values()], F.col(weight) if weight else 1)
    rows = held.select(*keys, value, *([weight] if weight else []))
    got = (rows.repartition(*keys) if many else rows).groupBy(*keys).agg(q.alias("_q")).filter(F.col("_q").isNotNull())
    return got.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def _wanted_cells(cells: DataFrame, keys: list[str], ranks: list[Rank]) -> DataFrame:
    """Of ``cells`` (keys, ``_cell``, ``_n``, and ``_pre``, ``_all`` of the level above) those that hold a wanted rank."""
    before = Window.partitionBy(*keys, "_pre").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    o = cells.withColumn("_pre", F.col("_pre") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = F.lit(False)
    for rank in ranks:
        r = rank(F.col("_all"))
        hit = hit | ((F.floor(r) < F.col("_pre") + F.col("_n")) & (F.ceil(r) >= F.col("_pre")))
    return materialise(o.filter(hit))


def _coarse(value: Column) -> Column:
    """A cell that never falls as the value rises."""
    v = value.cast("double")
    return F.when(F.isnan(v), F.lit(9223372036854775807)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS))


def _narrowed(held: DataFrame, value: str, ranks: list[Rank], keys: list[str], weight: str | None = None) -> DataFrame:
    """Rows whose cell holds a wanted rank: keys, value, weight, ``_cell``, and ``_pre`` rows of the group before it of ``_all``.

    Cells that together hold more than a million rows are cut once more, evenly between their extremes. Whatever the
    values are like, the rows that are left hold every wanted rank.
    """
    c, v = F.col, F.col(value)
    extra = [weight] if weight else []
    n = (F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_n")
    cells = [n, F.count(F.lit(1)).alias("_rows"), F.min(v.cast("double")).alias("_min"), F.max(v.cast("double")).alias("_max")]
    rows = held.select(*keys, value, *extra).withColumn("_cell", _coarse(v))
    whole = Window.partitionBy(*keys)
    first = rows.groupBy(*keys, "_cell").agg(*cells).withColumns({"_all": F.sum("_n").over(whole), "_pre": F.lit(0).cast("long")})
    wanted = _wanted_cells(first, keys, ranks)

    def inside(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        w = wanted.select(*[c(k).alias(f"_w_{k}") for k in keys], c("_cell").alias("_w"), "_pre", "_all", "_min", "_max")
        cond = c("_cell") == c("_w")
        for k in keys:
            cond = cond & c(k).eqNullSafe(c(f"_w_{k}"))
        return rows.join(broadcast_if_small(w), cond).select(*keys, value, *extra, "_cell", "_pre", "_all", "_min", "_max")

    found = inside(rows, wanted)
    if (wanted.agg(F.sum("_rows")).first()[0] or 0) > SMALL:
        span = c("_max") - c("_min")
        part = F.when((span > 0) & (span < float("inf")), F.floor((v.cast("double") - c("_min")) / span * PARTS)).otherwise(0)
        rows = found.select(*keys, value, *extra, part.alias("_part"), "_cell", "_pre", "_all")
        # the offset tells the cells of a group apart
        second = rows.groupBy(*keys, "_pre", "_all", c("_part").alias("_cell"), c("_cell").alias("_above")).agg(*cells)
        wanted = _wanted_cells(second, keys, ranks).select(*[c(k).alias(f"_w_{k}") for k in keys], c("_cell").alias("_w"), c("_above").alias("_wa"), c("_pre").alias("_o"))
        cond = (c("_part") == c("_w")) & (c("_cell") == c("_wa"))
        for k in keys:
            cond = cond & c(k).eqNullSafe(c(f"_w_{k}"))
        found = rows.join(broadcast_if_small(wanted), cond).withColumn("_pre", c("_o"))
    return found.select(*keys, value, *extra, "_pre", "_all")


def _bucketed(held: DataFrame, value: str, probs: dict[str, float], keys: list[str], weight: str | None,
              small: int | None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    if isinstance(held.schema[value].dataType, NumericType):
        held = _narrowed(held, value, [lambda n, p=p: F.lit(float(p)) * (n - 1) for p in probs.values()], keys, weight)
    else:
        rows = held.groupBy(*keys).agg(n.alias("_all")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_all", F.lit(0).cast("long").alias("_pre"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        held = held.join(broadcast_if_small(rows), same) if keys else held.crossJoin(rows)
    counts = held.groupBy(*keys, "_pre", "_all", value).agg(n.alias("_c"))
    o = ordered(counts, value, keys=[*keys, "_pre"], running={"_cum": "_c"}, small=small)
    lo_pos, hi_pos = F.col("_pre") + F.col("_cum") - F.col("_c"), F.col("_pre") + F.col("_cum") - 1   # 0-based places held
    aggs, keep = [], F.lit(False)
    for name, p in probs.items():
        r = F.lit(float(p)) * (F.col("_all") - 1)
        lo, hi = F.floor(r), F.ceil(r)
        at_lo, at_hi = lo.between(lo_pos, hi_pos), hi.between(lo_pos, hi_pos)
        keep = keep | at_lo | at_hi
        aggs += [F.max(F.when(at_lo, F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(at_hi, F.col(value))).alias(f"_hi_{name}"),
                 F.max(r - lo).alias(f"_f_{name}")]
    picked = o.filter(keep).groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") * (F.lit(1.0) - F.col(f"_f_{n}")) + F.col(f"_hi_{n}") * F.col(f"_f_{n}")).alias(n)
        for n in probs])


def quantile_values(df: DataFrame, value: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of a whole column as Python numbers, for use as literals."""
    row = exact_quantiles(df, value, {f"q{i}": p for i, p in enumerate(probs)}).first()
    return [row[f"q{i}"] for i in range(len(probs))] if row else [None] * len(probs)


def rows_at(df: DataFrame, cols: list[str], places: list[int]) -> list[tuple[Any, ...]]:
    """What the rows at ``places`` (from 0) hold when ordered by ``cols`` (numbers), NULL first.

    A tuple ends early where all rows that begin with it are the same or on one side of the place. No row
    is shuffled but those of the cells that hold a place; one tuple per place reaches the driver.
    """
    if not places:
        return []
    col, empty = cols[0], df.filter(F.col(cols[0]).isNull()).count()
    held = df.filter(F.col(col).isNotNull())
    later = sorted({p - empty for p in places if p >= empty})
    values = {}
    if later:
        near = _narrowed(held.select(col), col, [lambda n, p=p: F.lit(p) for p in later], []).groupBy("_pre", col).agg(F.count(F.lit(1)).alias("_c"))
        o = ordered(near, col, keys=["_pre"], running={"_cum": "_c"})
        last = F.col("_pre") + F.col("_cum") - 1
        hit = F.lit(False)
        for p in later:
            hit = hit | F.lit(p).between(last - F.col("_c") + 1, last)
        got = o.filter(hit).select(col, "_c", last.alias("_last")).collect()
        for p in later:
            r = next(r for r in got if r["_last"] - r["_c"] < p <= r["_last"])
            values[p + empty] = r[0], r["_last"] + empty - r["_c"] + 1, r["_c"]
    values |= {p: (None, 0, empty) for p in places if p < empty}
    out: dict[int, tuple[Any, ...]] = {}
    for same in {(v, first, n) for v, first, n in values.values()}:
        v, first, n = same
        here = [p for p in places if values[p] == same]
        # the last of equal rows ends them all
        split = [p for p in here if p != first + n - 1] if len(cols) > 1 else []
        deeper = rows_at(df.filter(F.col(col).eqNullSafe(F.lit(v))), cols[1:], [p - first for p in split])
        out |= {p: (v,) for p in here} | {p: (v, *d) for p, d in zip(split, deeper)}
    return [out[p] for p in places]


def is_after(cols: list[str], row: tuple[Any, ...]) -> Column:
    """Whether a row comes after what ``rows_at`` gave, in its order."""
    after = F.lit(False)
    for c, v in reversed(list(zip(cols, row))):
        more = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        after = more | (F.col(c).eqNullSafe(F.lit(v)) & after)
    return after
