"""Entities that arrive as files: counted per window as they come, or run through a batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """A stream of the parquet files that are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def counted(stream: DataFrame, time: str = "loaded_at", late: str = "30 days", every: str = "1 day") -> DataFrame:
    """Rows per project and window; rows later than `late` behind the newest are left out."""
    at = F.col(time).cast("timestamp")
    return stream.withColumn(time, at).withWatermark(time, late).groupBy(F.window(time, every), "project_id").agg(F.count(F.lit(1)).alias("n"))


def once_each(stream: DataFrame, key: str, time: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """Rows of a key that comes again within the watermark pass once."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan over each drop and writes its result under the batch's number, so
    that a batch that is run again replaces its own output."""
    def run(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
