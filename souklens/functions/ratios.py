"""Ratio columns. A zero or missing denominator gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def share_pct(num: Column, den: Column) -> Column:
    return F.lit(100.0) * num / F.nullif(den, F.lit(0))


def capped_ratio(num: Column, den: Column) -> Column:
    """``min(num, den) / den`` with missing sums read as zero."""
    n, d = F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(0))
    return F.least(n, d) / F.nullif(d, F.lit(0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of ``value`` weighted by ``weight``; rows without a value carry no weight."""
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def pct_change(after: Column, before: Column) -> Column:
    return (after - before) / F.nullif(before, F.lit(0))


def flag(cond: Column) -> Column:
    """Condition as 1/0; an unknown condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def count_if(cond: Column) -> Column:
    return F.sum(flag(cond))


def distinct_if(cond: Column, value: Column) -> Column:
    return F.countDistinct(F.when(cond, value))
