"""Writing an intermediate result once to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[str, str]] = []   # (application, path) of what this process has stored


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="souklens-")
    return _LOCAL[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet and read it back.

    Used where a result is scanned several times and every scan must see the same bits
    (bucket bounds are taken from it): a lost executor re-reads files and recomputes nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/souklens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new path in shared storage for files of another format; ``drop_stored`` deletes it too."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes what this process has stored for the application; results that still read it are lost.

    Call it when a job's results are written. Returns the number of tables deleted.
    """
    app = spark.sparkContext.applicationId
    own = [p for a, p in _WRITTEN if a == app]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in own:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _WRITTEN[:] = [(a, p) for a, p in _WRITTEN if a != app]
    return len(own)
