"""Fold tables that arrive as files: uncertainty of each row as it comes, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedge.operators.uncertainty import uncertainty_metrics


def fold_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Parquet files of a folder, as they come; at most `files` in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def uncertainty_stream(stream: DataFrame, tools: list[str]) -> DataFrame:
    """A projection without state. Percentile groups need all rows, and so a table of what has been written."""
    return uncertainty_metrics(stream, tools)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time; rows later than `late` are left out, which bounds the state."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything that is there now, exactly once, as Parquet."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
