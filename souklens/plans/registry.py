"""Registry of runnable queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str
    doubles: dict[str, int] = field(default_factory=dict)


QUERIES: dict[str, Query] = {}


def parse_doubles(spec: str) -> dict[str, int]:
    """``"a b:2"`` gives six digits for a and two for b."""
    out = {}
    for item in spec.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits or 6)
    return out


# Engines add doubles in different orders and break decimal ties differently. A value is rounded to three
# more digits first, which takes the noise away; a fifth of the last of these lifts exact ties and nothing else.
EXTRA = 3


def nudge(digits: int) -> float:
    return 0.2 * 10.0 ** -(digits + EXTRA)


def rounded(df: DataFrame, doubles: dict[str, int]) -> DataFrame:
    """Half-up rounding to fixed digits, and no negative zero, so that results compare across engines."""
    def one(c, d):
        r = F.round(F.round(F.col(c).cast("double"), d + EXTRA) + F.lit(nudge(d)), d)
        return F.when(r == 0, F.lit(0.0)).otherwise(r)

    return df.withColumns({c: one(c, d) for c, d in doubles.items()}) if doubles else df


def rounded_sql(sql: str, doubles: dict[str, int]) -> str:
    if not doubles:
        return sql
    def one(c, d):
        r = f"round(round(CAST({c} AS DOUBLE), {d + EXTRA}) + {nudge(d)!r}::DOUBLE, {d})"
        return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {c}"

    reps = ", ".join(one(c, d) for c, d in doubles.items())
    return f"SELECT * REPLACE ({reps}) FROM (\n{sql.strip()}\n) AS q"


def query(name: str, covers: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``covers`` names the inventory rows it demonstrates."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        d = parse_doubles(doubles)

        def run(spark: SparkSession, root: str) -> DataFrame:
            return rounded(fn(spark, root), d)

        QUERIES[name] = Query(name, run, rounded_sql(sql, d) if sql else None, covers, d)
        return fn

    return wrap
