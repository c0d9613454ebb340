"""Embedding columns: which vectors take part, and their numbers as matrices inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> tuple[DataFrame, int]:
    """``id, v`` of the rows that take part, ``v`` as array<double>, and the length of their vectors.

    Vectors that are null, empty or hold a null or non-finite entry take no part, nor do vectors of
    zeros unless ``zero``. Vectors of several lengths can't be compared: those of the most frequent
    length take part (of equally frequent ones the longest); the length is 0 if there is none.
    """
    v = rows[vector_col].cast("array<double>")
    picked = rows.select(rows[id_col].alias("id"), v.alias("v")).filter(F.size("v") > 0)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = picked.filter(sound if zero else sound & F.exists("v", lambda x: x != 0))
    top = picked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return picked, 0
    return picked.filter(F.size("v") == top["d"]), top["d"]


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """The equally long lists of an Arrow array as rows of doubles."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), d)


def list_array(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(values).reshape(-1)))
