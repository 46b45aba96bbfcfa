"""Event-time windows over streams of points: an extension, as maps themselves are not streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def tile_windows(events: DataFrame, time: str, x: str, y: str, zoom: int, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per tile and time window; rows later than the watermark are left out and finished windows leave the state."""
    tx, ty = projection.tile_of(F.col(x), F.col(y), zoom)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("window"), tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))
