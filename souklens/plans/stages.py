"""Stage tables shared by several queries of one application.

A stage is computed by Spark from the given tables the first time a query needs it,
written to shared storage, and read by the queries after it, the way a chain of
persisted tables works. It belongs to the files that the tables had then: once a table
has others, the next query computes the stage anew. ``clear`` forgets all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from souklens.functions.storage import drop_stored, materialise
from souklens.sources.tables import forget_tables, manifest

#: By application, root and name: the manifest of the inputs, and the stored stage.
_STAGES: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}
_MANIFESTS: dict[tuple[str, str], str] = {}


def stage(name: str):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def get(spark: SparkSession, root: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            now, key = manifest(spark, root), (app, root, name)
            if _MANIFESTS.get((app, root), now) != now:
                forget_tables()   # row counts decide on broadcasts
            _MANIFESTS[app, root] = now
            if key not in _STAGES or _STAGES[key][0] != now:
                _STAGES[key] = now, materialise(build(spark, root))
            return _STAGES[key][1]

        get.__name__, get.__doc__ = build.__name__, build.__doc__
        return get

    return wrap


def clear(spark: SparkSession | None = None) -> None:
    """Forgets all stages and what is known of the tables.

    With a session, the stored tables of its application are deleted too.
    """
    _STAGES.clear()
    _MANIFESTS.clear()
    forget_tables()
    if spark is not None:
        drop_stored(spark)
