"""Roll-up of old readings into five-minute buckets, safe against late readings, and the stitched history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.schemas import BUCKET_SEC

BUCKET = ["vehicle_id", "signal", "bucket_ts"]
ROLL_UP = [*BUCKET, "readings", "min_value", "max_value", "avg_value", "last_value", "last_ts"]


def bucket_ts() -> Column:
    return F.window("event_ts", f"{BUCKET_SEC} seconds")["start"].cast("timestamp_ntz")


def roll_up(log: DataFrame, horizon: Column) -> DataFrame:
    """Buckets of at least two readings older than the horizon."""
    old = log.filter(F.col("event_ts") < horizon).withColumn("bucket_ts", bucket_ts())
    rows = old.groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("readings"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.max_by("value", "event_ts").alias("last_value"), F.max("event_ts").alias("last_ts")
    )
    return rows.filter("readings > 1")


def merge_roll_ups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets met twice are one: counts add, averages are weighted, the later last value stays."""
    both = old.unionByName(new)
    return both.groupBy(*BUCKET).agg(
        F.sum("readings").alias("readings"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        (F.sum(F.col("avg_value") * F.col("readings")) / F.sum("readings")).alias("avg_value"),
        F.max_by("last_value", "last_ts").alias("last_value"),
        F.max("last_ts").alias("last_ts"),
    )


def surviving(log: DataFrame, buckets: DataFrame, horizon: Column) -> DataFrame:
    """Readings that are newer than the horizon or in no written bucket."""
    rows = log.withColumn("bucket_ts", bucket_ts())
    gone = buckets.select(*BUCKET, F.lit(True).alias("gone_"))
    rows = rows.join(gone, BUCKET, "left").filter((F.col("event_ts") >= horizon) | F.col("gone_").isNull())
    return rows.select(*log.columns)


def stitched(log: DataFrame, buckets: DataFrame) -> DataFrame:
    """Roll-ups and what is left of the log as one history of buckets."""
    hot = log.withColumn("bucket_ts", bucket_ts()).groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("readings"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.max_by("value", "event_ts").alias("last_value"), F.max("event_ts").alias("last_ts")
    )
    return merge_roll_ups(buckets.select(*hot.columns), hot)


def percentiles(samples: DataFrame, column: str) -> DataFrame:
    """Nearest-rank percentiles."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return samples.agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.min(column).alias("low"), F.max(column).alias("high"))
