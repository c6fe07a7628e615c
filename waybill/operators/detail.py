"""Vehicle detail, worked out for the whole fleet at once: register of verdicts, history, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.columns import plus_seconds, seconds_between
from waybill.schemas import REGISTER_ORDER


def register(roster: DataFrame, spec: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """Every configured signal of every vehicle with its verdict; staleness goes before thresholds."""
    rows = roster.select("vehicle_id").crossJoin(F.broadcast(spec)).join(latest, ["vehicle_id", "signal"], "left")  # six rows of configuration
    v = F.col("value")
    breach = (v < F.col("warn_lo")) | (v < F.col("crit_lo")) | (v > F.col("warn_hi")) | (v > F.col("crit_hi"))
    verdict = F.when(v.isNull(), "NULL").when(F.col("event_ts") < plus_seconds(now, -F.col("max_age_sec")), "STALE").when(F.coalesce(breach, F.lit(False)), "ALERT").otherwise("NORMAL")
    place = F.array_position(F.array(*map(F.lit, REGISTER_ORDER)), F.col("signal"))
    return rows.select("vehicle_id", "signal", "label", "unit", "value", "event_ts", verdict.alias("verdict"), F.when(place > 0, place).alias("display_order"))


def spans(log: DataFrame, signal: str, since: Column) -> DataFrame:
    some = log.filter((F.col("signal") == signal) & (F.col("event_ts") >= since))
    return some.groupBy("vehicle_id").agg(F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


def widths(span: DataFrame, points: int = 180) -> DataFrame:
    """Bucket width in seconds: the span over points - 1, within 1 second and 1 day."""
    whole = F.floor(seconds_between(F.col("first_ts"), F.col("last_ts")))
    return span.withColumn("width_s", F.least(F.greatest(F.ceil(whole / (points - 1)), F.lit(1)), F.lit(86400)).cast("long"))


def history(log: DataFrame, signal: str, since: Column, points: int = 180) -> DataFrame:
    """Buckets aligned to each vehicle's first reading."""
    some = log.filter((F.col("signal") == signal) & (F.col("event_ts") >= since))
    rows = some.join(widths(spans(log, signal, since), points), "vehicle_id")
    bucket = F.floor(seconds_between(F.col("first_ts"), F.col("event_ts")) / F.col("width_s"))
    out = rows.groupBy("vehicle_id", bucket.alias("bucket")).agg(F.min("event_ts").alias("bucket_ts"), F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("readings"))
    return out.select("vehicle_id", "bucket", "bucket_ts", F.round("mean_value", 6).alias("mean_value"), "readings")


def history_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("vehicle_id").agg(
        F.sum("readings").alias("readings"), F.min("bucket_ts").alias("from_ts"), F.max("bucket_ts").alias("to_ts"), F.min("mean_value").alias("low"), F.max("mean_value").alias("high")
    )
