"""Joining per-key results back to facts with hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM_ROWS = 1_000_000   # largest dimension that is broadcast, about 50 MB of narrow rows
HOT = 5_000_000   # rows of one key from which on the key is spread


def broadcast_if_small(dim: DataFrame, rows: int | None = None, limit: int = DIM_ROWS) -> DataFrame:
    """Broadcast hint for a dimension whose row count was checked; larger ones are left to a
    shuffle join with adaptive skew splitting.

    ``rows`` is an upper bound that is already known; without it at most ``limit + 1`` rows
    are counted.
    """
    n = dim.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(dim) if n <= limit else dim


def join_per_key(facts: DataFrame, per_key: DataFrame, keys: list[str], rows: str, spread_by: list[str],
                 how: str = "inner", hot: int = HOT) -> DataFrame:
    """Join a table with one row per key to the facts; NULL keys match.

    ``rows`` is a column of ``per_key`` with the number of facts of the key (dropped from
    the result). Keys with more than ``hot`` facts are spread by a hash of ``spread_by``
    over as many parts as keep each under ``hot``; only their rows are repeated. The list of hot keys holds at
    most (number of facts / ``hot``) rows, so it can be broadcast.
    """
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}{k}")) for k in keys]
    both = lambda conds: conds[0] if len(conds) == 1 else conds[0] & both(conds[1:])
    hot_keys = per_key.filter(F.col(rows) > hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col(rows) / hot).alias("_hot"))
    f = facts.join(F.broadcast(hot_keys), both(same("_h_")), "left")
    f = f.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("_hot"))).otherwise(F.lit(0)))
    rest = [c for c in per_key.columns if c not in keys and c != rows]
    spread = F.explode(F.when(F.col(rows) > hot, F.sequence(F.lit(0).cast("long"), F.ceil(F.col(rows) / hot) - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    d = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *rest, spread.alias("_ksalt"))
    j = f.join(d, both(same("_k_")) & (F.col("_salt") == F.col("_ksalt")), how)
    return j.select(*facts.columns, *rest)


def placed_beside(facts: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """A left join of a table that holds a key once at most; NULL keys match nothing.

    Written as a union with a window by key: tables that were dealt out by a few of the keys are not shuffled again, and the
    result is still dealt out that way. A join would deal both out by all keys.
    """
    rest, whole = [c for c in per_key.columns if c not in keys], Window.partitionBy(*keys)
    there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    u = facts.withColumn("_fact", F.lit(True)).unionByName(per_key.withColumn("_fact", F.lit(False)), allowMissingColumns=True)
    u = u.withColumns({c: F.when(there, F.max(c).over(whole)) for c in rest})
    return u.filter("_fact").select(*facts.columns, *rest)
