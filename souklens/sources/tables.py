"""Reading, parameterising and storing tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A catalog table, or ``<root>/<name>.parquet``; file footers are inspected once per path."""
    if root is None:
        return spark.table(name)
    path = f"{root}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_ROWS: dict[str, int] = {}


def forget_tables() -> None:
    """Schemas and row counts are read anew from then on."""
    _SCHEMAS.clear()
    _ROWS.clear()


def manifest(spark: SparkSession, root: str) -> str:
    """What the tables under ``root`` consist of now: per table its time of change, files and bytes.

    A few calls per table, however many files it has; a new, removed or replaced file changes it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in store.listStatus(path):
        size = store.getContentSummary(table.getPath())
        found.append((table.getPath().getName(), table.getModificationTime(), size.getFileCount(), size.getLength()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def row_count(spark: SparkSession, name: str, root: str) -> int:
    """Rows of a parquet table, read from the file footers once per path."""
    path = f"{root}/{name}.parquet"
    if path not in _ROWS:
        _ROWS[path] = read_table(spark, name, root).count()
    return _ROWS[path]


def run_sql(spark: SparkSession, text: str, params: dict[str, Any] | None = None,
            **frames: DataFrame) -> DataFrame:
    """SQL with named parameters (``:name``) and ``{frame}`` inputs; values are never pasted into text."""
    return spark.sql(text, args=params or {}, **frames)


def id_frame(spark: SparkSession, ids: Iterable[int], name: str) -> DataFrame | None:
    """List of ids as a one-column frame; an empty list means "no filter"."""
    rows = [(int(i),) for i in ids]
    return spark.createDataFrame(rows, f"{name} bigint") if rows else None


def keep_ids(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(name).distinct(), name, "left_semi")


def keep_listed(df: DataFrame, col: str, values: list | None, ignore_case: bool = False) -> DataFrame:
    """Filter by a literal list; an empty list keeps everything."""
    if not values:
        return df
    if ignore_case:
        return df.filter(F.lower(F.col(col)).isin([v.lower() for v in values]))
    return df.filter(F.col(col).isin(values))


def flag_filter(df: DataFrame, enabled: Column, listed: Column) -> DataFrame:
    """Row-level form of the optional filter: off, or the id is listed."""
    return df.filter(~enabled | listed)


def csv_rows(df: DataFrame, text: str, out: str, dtype: str = "bigint") -> DataFrame:
    """Comma-separated text to rows: trimmed, blanks dropped, cast without raising."""
    parts = df.withColumn("_p", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), ",")))
    item = F.trim("_p")
    return parts.filter(item != "").withColumn(out, item.try_cast(dtype)).drop("_p")


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the table at ``path`` and return a reader on it."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_scenario(df: DataFrame, path: str, column: str = "scenario") -> None:
    """Replace only the partitions present in ``df``; other scenarios stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose later files may have added columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append_evolving(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create the table if absent, else append; new columns are allowed, changed types are not."""
    spark = df.sparkSession
    try:
        old = dict(read_evolved(spark, path).dtypes)
    except AnalysisException:
        old = {}
    clash = [c for c, t in df.dtypes if c in old and old[c] != t]
    if clash:
        raise ValueError(f"columns changed their type: {clash}")
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def freeze_cohort(df: DataFrame, path: str) -> DataFrame:
    """Write a population once; a second call with the same path fails."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
