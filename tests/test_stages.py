"""Stage tables follow new input, and their files go when they are cleared."""

import os

from souklens.functions import storage
from souklens.plans import stages


def test_clear(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/t.parquet")

    @stages.stage("counted")
    def counted(spark, root):
        return spark.read.parquet(f"{root}/t.parquet")

    assert counted(spark, root).count() == 3
    kept = [p for _, p in storage._WRITTEN]
    assert counted(spark, root).count() == 3 and [p for _, p in storage._WRITTEN] == kept   # built once
    spark.range(2).write.mode("append").parquet(f"{root}/t.parquet")
    assert counted(spark, root).count() == 5   # other files, another stage
    spark.range(4).write.mode("overwrite").parquet(f"{root}/t.parquet")
    assert counted(spark, root).count() == 4
    spark.range(5).write.mode("overwrite").parquet(f"{root}/t.parquet")
    stages.clear()
    assert counted(spark, root).count() == 5 and all(os.path.isdir(p) for p in kept)
    stages.clear(spark)
    assert storage._WRITTEN == [] and not any(os.path.exists(p) for p in kept)
