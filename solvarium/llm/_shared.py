"""What the operators of this package share: table access, scratch tables, and scans over arrays."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it.

    Where the setting is unset (tests in one process), a folder of this machine is taken and set; a session on a
    cluster without the setting is an error, since a machine's own folder is invisible to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="solvarium-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_uri(spark: SparkSession) -> str:
    """shared_dir() as a URI that file systems outside Spark know; Hadoop also writes `file:/folder`."""
    root = shared_dir(spark)
    if "://" in root:
        return root
    return "file://" + root.removeprefix("file:")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and survive the loss of any executor.

    Files written once are read by every later stage, so work upstream (Python above all) runs once. drop() deletes
    tables that no returned DataFrame reads any more.
    """

    def __init__(self, spark: SparkSession, of: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/solvarium/{of}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def running(values: str, how: str = "sum") -> str:
    """SQL: for each place of an array<int>, the sum (or the maximum, 0 at least) of what stands before it.

    Appending to an array copies it, so the scan goes by chunks of 256: the totals of the chunks first, then each chunk
    from its own start. That keeps the work in proportion to the array's length.
    """
    step = {"sum": "s.at + {x}", "max": "greatest(s.at, {x})"}[how]
    total = {"sum": "aggregate(y, 0, (a, b) -> a + b)", "max": "coalesce(array_max(y), 0)"}[how]
    empty = "CAST(array() AS array<int>)"
    return f"""
    transform(array({values}), v -> transform(
      array(transform(sequence(0, CAST(greatest(0, (size(v) - 1) div 256) AS INT)), k -> slice(v, 256 * k + 1, 256))), c ->
      flatten(zip_with(c,
        aggregate(c, named_struct('at', 0, 'out', {empty}),
          (s, y) -> named_struct('at', {step.format(x=total)}, 'out', concat(s.out, array(s.at))), s -> s.out),
        (y, first) -> aggregate(y, named_struct('at', first, 'out', {empty}),
          (s, x) -> named_struct('at', {step.format(x="x")}, 'out', concat(s.out, array(s.at))), s -> s.out))))[0])[0]"""
