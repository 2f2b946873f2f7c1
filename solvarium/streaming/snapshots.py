"""Repository snapshots as a stream: files of package rows arrive, and each snapshot's check is kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """A stream over parquet files as they appear under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def counts(stream: DataFrame, time_col: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, status, n) of status rows by event time; rows later than `late` are left out, and state is dropped then."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "status").agg(F.count("*").alias("n"))


def check_each(stream: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch check on every micro-batch and writes its rows under the batch's id; a repeated batch overwrites
    its own rows only."""

    def run(batch: DataFrame, batch_id: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
