"""Tables that outlive their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the folder of spark.checkpoint.dir, which every executor can read.

    Only a session on one machine that names no folder (as in tests) gets a folder of its
    own; on a cluster that is an error. All paths of an application lie in one folder,
    which can be removed when it has ended.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a table written below the folder of spark.checkpoint.dir.

    The rows outlive a lost executor, and the table tells the optimizer its real size.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
