"""A fitted model over a stream of points: rows stand alone, so there is no state, watermark or shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.estimator import UmapModel


def transform_stream(model: UmapModel, points: DataFrame) -> DataFrame:
    """(id, y) of a streaming ``points(id, features)``; append mode."""
    if not points.isStreaming:
        raise ValueError("points must be a streaming DataFrame")
    return model.transform(points)


def drain(embedding: DataFrame, folder: str) -> DataFrame:
    """Writes all that a streaming ``embedding`` has now as Parquet under ``folder``, and reads it back."""
    run = embedding.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return embedding.sparkSession.read.schema(embedding.schema).parquet(f"{folder}/out")


def windowed_ranges(embedding: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Range and number of the first two coordinates by time window, for drift watching; late rows up to ``late`` count."""
    window = F.window(time, width)
    return embedding.withWatermark(time, late).groupBy(window).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("y")[0]).alias("y1_min"), F.max(F.col("y")[0]).alias("y1_max"), F.min(F.col("y")[1]).alias("y2_min"), F.max(F.col("y")[1]).alias("y2_max"))
