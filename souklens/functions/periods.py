"""Calendar labels around one or two event dates.

All dates are Python literals, so the filters built here reach the scan. Three ways of
finding the comparable date one year back exist side by side (explicit dates, minus 364
days, minus twelve months then the Monday of that week); the caller picks one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monday(d: date) -> date:
    return d - timedelta(days=d.weekday())


def shift_months(d: date, months: int) -> date:
    """Same rule as ``add_months``: the day is clipped to the target month's last day."""
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    first_next = date(y + (m + 1) // 12, (m + 1) % 12 + 1, 1)
    last = (first_next - timedelta(days=1)).day
    return date(y, m + 1, min(d.day, last))


def year_back(d: date, rule: str) -> date:
    if rule == "364d":
        return d - timedelta(days=364)
    if rule == "12m_week":
        return monday(shift_months(d, -12))
    raise ValueError(f"unknown year shift {rule!r}")


@dataclass(frozen=True)
class EventWindows:
    """Pre and post windows of the event year (CY) and the year before (LY), inclusive."""

    ly_pre_start: date
    ly_pre_end: date
    ly_event: date
    ly_post_end: date
    cy_pre_start: date
    cy_pre_end: date
    cy_event: date
    cy_post_end: date

    @classmethod
    def around(cls, event: date, weeks_before: int, weeks_after: int, rule: str = "364d") -> "EventWindows":
        def side(e):
            return (e - timedelta(weeks=weeks_before), e - timedelta(days=1), e,
                    e + timedelta(days=7 * weeks_after - 1))

        return cls(*side(year_back(event, rule)), *side(event))

    def span(self, d: Column) -> Column:
        return d.between(F.lit(self.ly_pre_start), F.lit(self.ly_post_end)) | d.between(
            F.lit(self.cy_pre_start), F.lit(self.cy_post_end))

    def period(self, d: Column) -> Column:
        return F.when(d.between(F.lit(self.ly_pre_start), F.lit(self.ly_post_end)), "LY").when(
            d.between(F.lit(self.cy_pre_start), F.lit(self.cy_post_end)), "CY")

    def phase(self, d: Column) -> Column:
        pre = d.between(F.lit(self.ly_pre_start), F.lit(self.ly_pre_end)) | d.between(
            F.lit(self.cy_pre_start), F.lit(self.cy_pre_end))
        post = d.between(F.lit(self.ly_event), F.lit(self.ly_post_end)) | d.between(
            F.lit(self.cy_event), F.lit(self.cy_post_end))
        return F.when(pre, "Pre").when(post, "Post")

    def event_start(self, d: Column) -> Column:
        return F.when(d <= F.lit(self.ly_post_end), F.lit(self.ly_event)).otherwise(F.lit(self.cy_event))


def label_periods(df: DataFrame, day: str, w: EventWindows) -> DataFrame:
    """Adds ``period`` (CY/LY), ``phase`` (Pre/Post), ``event_start``; other days are dropped."""
    d = F.col(day)
    return (df.filter(w.span(d))
            .withColumns({"period": w.period(d), "phase": w.phase(d), "event_start": w.event_start(d)})
            .filter(F.col("period").isNotNull() & F.col("phase").isNotNull()))


def label_period_window(df: DataFrame, day: str, w: EventWindows) -> DataFrame:
    """Adds the combined label ``period_window``, e.g. ``PRE_LY``."""
    return label_periods(df, day, w).withColumn(
        "period_window", F.concat_ws("_", F.upper("phase"), "period")).drop("period", "phase")


def with_week_index(df: DataFrame, day: str) -> DataFrame:
    """Adds ``week_start`` and whole weeks from the event's week; needs ``event_start``."""
    week = F.to_date(F.date_trunc("week", F.col(day)))
    anchor = F.to_date(F.date_trunc("week", F.col("event_start")))
    return df.withColumns({"week_start": week, "week_index": (F.datediff(week, anchor) / 7).cast("int")})


@dataclass(frozen=True)
class Window2:
    """A named window with the date the travel horizon is counted from."""

    period: str
    window: str
    start: date
    end: date
    anchor: date


def three_phase_windows(announce: date, rollout: date, weeks: int, rule: str = "12m_week") -> list[Window2]:
    """PRE before the announcement week, COMM until rollout, POST from rollout on.

    Rollout's window is closed one week later than the pre window is long.
    """
    out = []
    for period, a, r in (("CY", monday(announce), monday(rollout)),
                         ("LY", year_back(announce, rule), year_back(rollout, rule))):
        out += [Window2(period, "PRE", a - timedelta(weeks=weeks), a - timedelta(days=1), a),
                Window2(period, "COMM", a, r - timedelta(days=1), a),
                Window2(period, "POST", r, r + timedelta(days=7 * weeks + 6), r)]
    return out


def two_event_windows(announce: date, rollout: date, before: int, after: int,
                      rule: str = "12m_week") -> list[Window2]:
    """Pre and post windows around both events; neighbouring windows may overlap."""
    out = []
    for period, a, r in (("CY", monday(announce), monday(rollout)),
                         ("LY", year_back(announce, rule), year_back(rollout, rule))):
        for name, e in (("COMM", a), ("ROLLOUT", r)):
            out += [Window2(period, f"PRE_{name}", e - timedelta(weeks=before), e - timedelta(days=1), e),
                    Window2(period, f"POST_{name}", e, e + timedelta(days=7 * after - 1), e)]
    return out


def _hit(day: Column, w: Window2) -> Column:
    return day.between(F.lit(w.start), F.lit(w.end))


def label_first_window(df: DataFrame, day: str, windows: list[Window2]) -> DataFrame:
    """Exclusive labels: a day goes to the first window of the list that holds it."""
    d = F.col(day)

    def pick(attr):
        col = None
        for w in windows:
            v = F.lit(getattr(w, attr))
            col = F.when(_hit(d, w), v) if col is None else col.when(_hit(d, w), v)
        return col

    return (df.filter(reduce(lambda a, b: a | b, (_hit(d, w) for w in windows)))
            .withColumns({"period": pick("period"), "window": pick("window"), "anchor": pick("anchor")}))


def explode_windows(df: DataFrame, day: str, windows: list[Window2]) -> DataFrame:
    """Overlapping labels: one output row per window that holds the day.

    The handful of window literals is matched inside the row, so no range join is needed.
    """
    d = F.col(day)
    hits = F.array_compact(F.array(*[
        F.when(_hit(d, w), F.struct(F.lit(w.period).alias("period"), F.lit(w.window).alias("window"),
                                    F.lit(w.anchor).alias("anchor"))) for w in windows]))
    return (df.filter(reduce(lambda a, b: a | b, (_hit(d, w) for w in windows)))
            .withColumn("_w", F.explode(hits)).select(*df.columns, "_w.period", "_w.window", "_w.anchor"))


def within_months(day: Column, anchor: Column, months: int) -> Column:
    """Nested travel horizon: ``anchor <= day <= anchor + months``, both ends inclusive."""
    return day.between(anchor, F.add_months(anchor, months))


def horizon_bucket(day: Column, anchor: Column) -> Column:
    """Disjoint travel horizon 3M / 6M / 12M; only the last end is inclusive."""
    m3, m6, m12 = (F.add_months(anchor, m) for m in (3, 6, 12))
    return (F.when((day >= anchor) & (day < m3), "3M").when((day >= m3) & (day < m6), "6M")
            .when((day >= m6) & (day <= m12), "12M"))


@dataclass(frozen=True)
class YearToDate:
    """Half-open current-year-to-last-full-month range and the same range a year before."""

    cy_start: date
    cy_end: date
    py_start: date
    py_end: date

    @classmethod
    def at(cls, as_of: date) -> "YearToDate":
        s, e = date(as_of.year, 1, 1), as_of.replace(day=1)
        return cls(s, e, shift_months(s, -12), shift_months(e, -12))

    def period(self, d: Column) -> Column:
        return (F.when((d >= F.lit(self.cy_start)) & (d < F.lit(self.cy_end)), "CY")
                .when((d >= F.lit(self.py_start)) & (d < F.lit(self.py_end)), "PY"))


def week_list(start: date, weeks: int, as_of: date) -> list[date]:
    """Mondays from ``start``; weeks that have not begun by ``as_of`` are left out."""
    return [w for w in (start + timedelta(weeks=i) for i in range(weeks)) if w <= as_of]


def spread_over_weeks(df: DataFrame, weeks: list[date]) -> DataFrame:
    """Entity × week spine built inside the row from the week literals."""
    return df.withColumn("week_start", F.explode(F.array(*[F.lit(w) for w in weeks])))


def week_spine(df_one_row: DataFrame, start: Column, end: Column, as_of: date) -> DataFrame:
    """Week spine from ``sequence``; future weeks are cut at ``as_of``."""
    return (df_one_row.select(F.explode(F.sequence(start, end, F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
            .filter(F.col("week_start") <= F.lit(as_of)))
