"""Text labels and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of_or_other(col: Column, allowed: list[str], other: str = "Other") -> Column:
    """Case-insensitive match; unknown and missing text becomes ``other``."""
    return F.when(F.lower(F.coalesce(col, F.lit(""))).isin([a.lower() for a in allowed]), col).otherwise(F.lit(other))


def edge_bucket(col: Column, edges: list[float], labels: list[str], zero: str | None = None,
                upper_inclusive: bool = False) -> Column:
    """Label by ascending edges; ``zero`` takes missing and zero values."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    out = None
    if zero is not None:
        out = F.when(col.isNull() | (col == 0), F.lit(zero))
    for e, lab in zip(edges, labels):
        cond = col <= F.lit(e) if upper_inclusive else col < F.lit(e)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return F.lit(labels[0]) if out is None else out.otherwise(F.lit(labels[-1]))


def category_order(col: Column, order: list[str]) -> Column:
    """Sort key for a fixed category order; unknown categories last."""
    out = None
    for i, v in enumerate(order, 1):
        out = F.when(col == v, F.lit(i)) if out is None else out.when(col == v, F.lit(i))
    return out.otherwise(F.lit(len(order) + 1))


def yes_no(col: Column) -> Column:
    # fixed values: accepted spellings
    s = F.lower(F.trim(col.cast("string")))
    return (F.when(col.isNull() | s.isin("no", "n", "false", "0", "none", "nan"), "No")
            .when(s.isin("yes", "y", "true", "1"), "Yes").otherwise("Unknown"))


def not_in_or_null(col: Column, excluded: list[str]) -> Column:
    """``NOT IN`` that keeps missing values."""
    return col.isNull() | ~col.isin(excluded)


def maturity_band(days: Column) -> Column:
    # fixed values: edges and labels
    return (F.when(days <= 180, "New (0-6 months)").when(days <= 540, "Developing (6-18 months)")
            .otherwise("Mature (18+ months)"))


def adoption_level(n: Column) -> Column:
    # fixed values: edges and labels
    return (F.when(n == 0, "Non-adopters").when(n <= 2, "Low (1-2)").when(n <= 5, "Medium (3-5)")
            .when(n <= 7, "High (6-7)").otherwise("Power (8+)"))


def size_band(n: Column) -> Column:
    # fixed values: edges and labels
    return (F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").otherwise("16+"))


def engagement_tier(n: Column) -> Column:
    # fixed values: edges and labels
    return (F.when(n == 1, "Single-Use").when(n == 2, "Occasional").when(n <= 9, "Regular").otherwise("Power User"))


def two_flag_segment(a: Column, b: Column, a_name: str, b_name: str) -> Column:
    left = F.when(a, a_name).otherwise(f"Non-{a_name}")
    right = F.when(b, b_name).otherwise(f"Non-{b_name}")
    return F.concat(left, F.lit(" + "), right)


def depth_level(mean: Column) -> Column:
    # fixed values: edges and labels
    return F.when(mean < 2, "SHALLOW").when(mean < 4, "MODERATE").otherwise("DEEP")
