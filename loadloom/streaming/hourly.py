"""Hourly totals of a stream of readings, with late data up to a set delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, folder: str, schema: str, files_each: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream, so many for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def hourly_totals(stream: DataFrame, key: str, ts: str, value: str, delay: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Sum and count by key and window; a window is final once the watermark has passed it.

    Works on a static table too, where the watermark has no effect.
    """
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    got = timed.groupBy(F.window("__ts", width), F.col(key)).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "total", "n")


def run_once(totals: DataFrame, out: str, checkpoint: str):
    """Append final windows to a Parquet folder until what is there now has been read; each batch is written once."""
    return totals.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
