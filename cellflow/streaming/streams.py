"""Windows over event time on a stream or a batch, and an incremental file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(df: DataFrame, t: str, keys: list[str], size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, sum and mean of value in event-time windows; rows later than `late` behind the newest are dropped from a stream."""
    rows = df.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, t: str, key: str, gap: str) -> DataFrame:
    """Runs of a key's events that are less than a gap apart."""
    rows = df.withColumn("_t", F.col(t).cast("timestamp"))
    return rows.groupBy(F.session_window("_t", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def available_now(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> None:
    """Read files that came since the last call, once each, and append them to a table."""
    q = spark.readStream.schema(schema).parquet(path).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
