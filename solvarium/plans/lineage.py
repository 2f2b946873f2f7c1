"""Cutting lineage in fixpoint loops: written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in a single process without the setting, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="solvarium-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, of: str) -> str:
    """A path in the shared folder that clear() deletes."""
    path = f"{shared_root(spark)}/solvarium/{of}-{uuid.uuid4().hex}"
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written once and read back, so that a loop's plan stays small and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, "loop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what cut() and new_path() have left in this application, once no DataFrame that reads it is needed any more; how many."""
    paths = _LEFT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
