"""Joining days with a table of overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of a cell. A window of n days lies in at most n / CELL_DAYS + 2 cells.
CELL_DAYS = 14


def interval_join(facts: DataFrame, windows: DataFrame, keys: list[str], day: str, start: str, end: str, cell_days: int = CELL_DAYS) -> DataFrame:
    """Each fact with every window of its keys that its day lies in, ``start`` and ``end`` included.

    Time is cut into cells. A window is repeated for the cells that it touches, a fact lies in one, so both meet by an
    equi join on keys and cell, and the bounds are tested on what meets: no nested loop and no range join, however many
    windows there are, and a key with very many facts is spread over its cells. ``keys`` may be empty. A fact and a window
    meet once. Windows with a null bound, or that end before they start, and facts without a day meet nothing; keys
    compare as in any join. Columns other than the keys must differ between both.
    """
    cell = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / cell_days).cast("int")
    good = windows.filter(F.col(start) <= F.col(end))
    placed = good.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return (facts.filter(F.col(day).isNotNull()).withColumn("_cell", cell(F.col(day))).join(placed, [*keys, "_cell"])
            .filter(F.col(day).between(F.col(start), F.col(end))).drop("_cell"))
