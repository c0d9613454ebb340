"""Ranks and running totals over a whole table without a one-task window.

``OVER (ORDER BY x)`` sends every row to a single task, and ``OVER (PARTITION BY k ORDER
BY x)`` does so for a hot key. Here the order is cut into value buckets first: a bounded
list of split points (approximate quantiles) is read by the driver, the way a range
partitioner does. Rows, or sums, are counted per bucket, the short list of bucket totals
is accumulated, and the window only runs inside one bucket. A value equal to a split
point gets a bucket of its own, which is cut further along the tie-break column, so a
value shared by a third of the rows is spread as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.skew import join_per_key
from souklens.functions.storage import materialise

SMALL = 1_000_000        # up to this many rows one window task is cheaper than the extra passes
BUCKET_ROWS = 2_000_000  # wanted rows per bucket
MIN_BUCKETS = 16
# running sums of doubles are added as decimals, which gives the same bits in any order of rows
EXACT = "decimal(38,9)"


def bucket_count(rows: int) -> int:
    """Buckets grow with the data, so that each keeps its size."""
    return max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))


def split_points(df: DataFrame, cols: list[str], buckets: int) -> list[list[float]]:
    """At most ``buckets - 1`` sorted split points per column, in one pass."""
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(*[F.percentile_approx(F.col(c), probs, 20 * buckets).alias(f"s{i}")
                   for i, c in enumerate(cols)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(cols))]


def bucket_of(value: Column, splits: list) -> Column:
    """Odd numbers: equal to split point; even numbers: between two; -1: NULL.

    A short list becomes a search tree of comparisons. A long one would make code too large
    to be compiled; it is searched in two steps, the chunk first and then inside the chunk.
    """
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return (F.when(value == F.lit(splits[mid]), F.lit(2 * mid + 1))
                .when(value < F.lit(splits[mid]), tree(lo, mid))
                .otherwise(tree(mid + 1, hi)))

    if len(splits) < 32:
        return F.when(value.isNull(), F.lit(-1)).otherwise(tree(0, len(splits)))
    size = math.ceil(math.sqrt(len(splits)))
    chunks = [splits[i:i + size] for i in range(0, len(splits), size)]
    below = lambda arr: F.size(F.filter(arr, lambda x: x < value))
    chunk = below(F.lit([c[-1] for c in chunks[:-1]]))       # chunks that end below the value
    inside = F.element_at(F.lit(chunks), chunk + 1)
    place = below(inside)
    return (F.when(value.isNull(), F.lit(-1))
            .otherwise(2 * (chunk * size + place) + F.array_contains(inside, value).cast("int")))


def ordered(df: DataFrame, value: str, tie: str | None = None, keys: list[str] | None = None,
            descending: bool = False, running: dict[str, str] | None = None,
            buckets: int | None = None, prepared: bool = False, small: int | None = None) -> DataFrame:
    """Adds ``pos`` (1-based place by value, then tie), ``n_rows`` and, for every ``name ->
    column`` in ``running``, the running sum (NULL adds nothing) and ``<name>_total``. NULL values come first
    in ascending and last in descending order.

    Without a tie-break column the values must be unique within ``keys``.
    """
    keys, running = list(keys or []), dict(running or {})
    src = df if prepared else materialise(df)
    inexact = {n: src.schema[c].dataType.typeName() in ("double", "float") for n, c in running.items()}
    if any(inexact.values()):
        names = {n: f"_r_{n}" if inexact[n] else c for n, c in running.items()}
        exact = src.withColumns({names[n]: F.col(c).cast(EXACT) for n, c in running.items() if inexact[n]})
        done = ordered(exact, value, tie, keys, descending, names, buckets, True, small)
        both = lambda n: [F.col(x).cast("double").alias(x) if inexact[n] else F.col(x) for x in (n, f"{n}_total")]
        return done.select(*src.columns, "pos", "n_rows", *[both(n)[0] for n in running], *[both(n)[1] for n in running])
    v = F.col(value).desc() if descending else F.col(value).asc()
    rows = src.count()       # read from the file footers
    if rows <= (SMALL if small is None else small):
        return _one_window(src, v, value, tie, keys, running)
    buckets = buckets or bucket_count(rows)
    cols = [value] + ([tie] if tie else [])
    sp = split_points(src, cols, buckets)
    b = bucket_of(F.col(value), sp[0])
    src = src.withColumn("_b", -b if descending else b)
    single = (F.col("_b") % 2) != 0
    sub = F.when(single, bucket_of(F.col(tie), sp[1])).otherwise(F.lit(0)) if tie else F.lit(0)
    src = src.withColumn("_s", sub)

    totals = src.groupBy(*keys, "_b", "_s").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_m_{n}") for n, c in running.items()])
    before = Window.partitionBy(*keys).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    offs = totals.select(
        *keys, "_b", "_s",
        F.coalesce(F.sum("_n").over(before), zero).alias("_off"),
        F.sum("_n").over(whole).alias("n_rows"),
        *[F.coalesce(F.sum(f"_m_{n}").over(before), zero).alias(f"_o_{n}") for n in running],
        *[F.sum(f"_m_{n}").over(whole).alias(f"{n}_total") for n in running])
    # the renamed keys allow a null-safe equality, so rows with a NULL key keep their place
    offs = offs.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                       F.col("_b").alias("_kb"), F.col("_s").alias("_ks"),
                       *[c for c in offs.columns if c not in keys + ["_b", "_s"]])
    cond = (F.col("_b") == F.col("_kb")) & (F.col("_s") == F.col("_ks"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = src.join(offs, cond)

    part = Window.partitionBy(*keys, "_b", "_s")
    by_row = part.orderBy(*([v, F.col(tie).asc()] if tie else [v])).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *df.columns,
        (F.col("_off") + F.row_number().over(by_row)).cast("long").alias("pos"),
        F.col("n_rows"),
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(by_row), zero)).alias(n) for n, c in running.items()],
        *[F.col(f"{n}_total") for n in running])


def _one_window(src: DataFrame, v: Column, value: str, tie: str | None, keys: list[str],
                running: dict[str, str]) -> DataFrame:
    """Same output for an input whose size was checked to be small."""
    whole = Window.partitionBy(*keys)
    by_row = whole.orderBy(*([v, F.col(tie).asc()] if tie else [v])).rowsBetween(Window.unboundedPreceding, 0)
    return src.select(
        *src.columns, F.row_number().over(by_row).cast("long").alias("pos"),
        F.count(F.lit(1)).over(whole).alias("n_rows"),
        *[F.coalesce(F.sum(c).over(by_row), F.lit(0)).alias(n) for n, c in running.items()],
        *[F.sum(c).over(whole).alias(f"{n}_total") for n, c in running.items()])


def ntile_col(tiles: int) -> Column:
    """From ``ordered`` output: tile sizes differ by one at most, larger tiles first."""
    n, pos = F.col("n_rows"), F.col("pos")
    base, rem = F.floor(n / tiles), n % tiles
    head = rem * (base + 1)
    return F.when(pos <= head, F.ceil(pos / (base + 1))).otherwise(
        rem + F.ceil((pos - head) / F.nullif(base, F.lit(0)))).cast("int")


def ranked(df: DataFrame, values: dict[str, str], tie: list[str], tiles: dict[str, int] | None = None,
           small: int = 100_000, buckets: int | None = None) -> DataFrame:
    """Percent ranks of several columns (``values`` maps column to output name) and n-tiles of the
    first one (``tiles`` maps output name to number of tiles), over the whole table in one order.

    Rows are stored once with a number of their own and stacked, one per column; every column is cut
    into buckets by its split points, a window runs inside a bucket and starts at the number of rows
    before it, and the results meet their row by its number. All rows of a bucket that holds one
    value have the same rank, so it is cut further along the first column of ``tie`` like any other.
    NULL ranks lowest. Tiles are reproducible if ``tie`` is unique. Up to ``small`` rows nothing is cut.
    """
    cols, tiles = list(values), dict(tiles or {})
    src = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = src.count()       # read from the file footers
    cut_by = [*cols, tie[0]]
    points = [[]] * len(cut_by) if rows <= small else split_points(src, cut_by, buckets or bucket_count(rows))
    types = {src.schema[c].dataType.simpleString() for c in cols}
    kind = types.pop() if len(types) == 1 else "double"

    def entry(i: int, c: str) -> Column:
        s = F.when(F.col(f"_b{i}") % 2 != 0, F.col("_tb")).otherwise(0)
        # only tiles need the tie-break
        ties = [(F.col(t) if i == 0 else F.lit(None).cast(src.schema[t].dataType)).alias(f"_t{j}") for j, t in enumerate(tie)]
        return F.struct(F.lit(i).alias("_m"), F.col(c).cast(kind).alias("_v"), F.col(f"_b{i}").alias("_b"), s.alias("_s"), *ties)

    places = {f"_b{i}": bucket_of(F.col(c), points[i]) for i, c in enumerate(cols)}
    stacked = src.withColumns({**places, "_tb": bucket_of(F.col(tie[0]), points[-1])}).select(
        "_row", F.explode(F.array(*[entry(i, c) for i, c in enumerate(cols)])).alias("_x")).select("_row", "_x.*")
    place = Window.partitionBy("_m").orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offs = stacked.groupBy("_m", "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    offs = offs.withColumn("_off", F.coalesce(F.sum("_n").over(place), F.lit(0)))
    offs = offs.select("_m", "_b", "_s", "_off", F.min("_off").over(Window.partitionBy("_m", "_b")).alias("_first"))
    inside = Window.partitionBy("_m", "_b", "_s")
    one = F.col("_b") % 2 != 0
    placed = stacked.join(offs, ["_m", "_b", "_s"]).select(
        "_row", "_m", (F.col("_off") + F.row_number().over(inside.orderBy("_v", *[f"_t{j}" for j in range(len(tie))]))).alias("_pos"),
        F.when(one, F.col("_first")).otherwise(F.col("_off") + F.rank().over(inside.orderBy("_v")) - 1).alias("_before"))
    share = F.col("_before") / F.lit(rows - 1) if rows > 1 else F.lit(0.0)
    got = placed.groupBy("_row").agg(
        F.max(F.when(F.col("_m") == 0, F.col("_pos"))).alias("pos"),
        *[F.max(F.when(F.col("_m") == i, share)).alias(values[c]) for i, c in enumerate(cols)])
    tiled = [ntile_col(n).alias(name) for name, n in tiles.items()]
    got = got.withColumn("n_rows", F.lit(rows).cast("long")).select("_row", *values.values(), *tiled)
    return src.join(got, "_row").drop("_row")


def percent_rank_of(df: DataFrame, value: str, keys: list[str] | None, out: str,
                    prepared: bool = False, small: int | None = None) -> DataFrame:
    """Percent rank of every row within ``keys``; see ``percent_ranks_of``."""
    return percent_ranks_of(df, {value: out}, keys, prepared, small)


def percent_ranks_of(df: DataFrame, values: dict[str, str], keys: list[str] | None = None,
                     prepared: bool = False, small: int | None = None) -> DataFrame:
    """Percent ranks of several columns (``values`` maps column to output name).

    Ranks need no tie-break: equal values are counted first, only distinct values are
    ordered, all columns in one pass, and the ranks are joined back by value.
    """
    keys = list(keys or [])
    src = df if prepared else materialise(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in values]))
    counts = (src.select(*keys, pairs.alias("_x")).groupBy(*keys, F.col("_x.col").alias("_col"), F.col("_x.v").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    o = ordered(counts, "_v", keys=[*keys, "_col"], running={"_cum": "_c"}, small=small)
    pr = F.when(F.col("_cum_total") > 1, (F.col("_cum") - F.col("_c")) / (F.col("_cum_total") - 1)).otherwise(0.0)
    ranks = o.select(*keys, "_col", "_v", "_c", pr.alias("_pr"))
    if len(values) > 1:
        ranks = materialise(ranks)
    out = src
    for c, name in values.items():
        one = ranks.filter(F.col("_col") == c).select(*keys, "_v", "_c", F.col("_pr").alias(name))
        spread = [x for x in df.columns if x not in keys + [c]] or [c]
        out = join_per_key(out.withColumn("_v", F.col(c).cast("double")), one, [*keys, "_v"], "_c", spread, "left").drop("_v")
    return out
