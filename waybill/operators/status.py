"""Fleet status: pivoted latest values, last ping, badge, status ladder, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.columns import plus_seconds
from waybill.schemas import OFFLINE_SEC, STATUSES


def pivot_latest(latest: DataFrame) -> DataFrame:
    of = lambda signal, c: F.max(F.when(F.col("signal") == signal, F.col(c)))
    return latest.groupBy("vehicle_id").agg(
        of("soc", "value").alias("soc"),
        of("range_km", "value").alias("range_km"),
        of("speed", "value").alias("speed"),
        of("speed", "event_ts").alias("speed_ts"),
        of("ignition", "value").alias("ignition"),
        of("ignition", "event_ts").alias("ignition_ts"),
        F.max("event_ts").alias("last_signal_ts"),
    )


def last_ping(latest: DataFrame, fixes: DataFrame) -> DataFrame:
    both = latest.select("vehicle_id", "event_ts").unionByName(fixes.select("vehicle_id", "event_ts"))
    return both.groupBy("vehicle_id").agg(F.max("event_ts").alias("last_ping"))


def badges(alerts: DataFrame) -> DataFrame:
    live = alerts.filter("resolved_at IS NULL AND dismissed_at IS NULL").groupBy("vehicle_id")
    return live.agg(F.when(F.bool_or(F.col("severity") == "critical"), "critical").otherwise("warning").alias("alert_severity"))


def ladder(now: Column) -> Column:
    since = plus_seconds(now, F.lit(-OFFLINE_SEC))
    fresh_speed = F.col("speed_ts") >= since
    return (
        F.when(F.col("last_ping").isNull() | (F.col("last_ping") < since), "OFFLINE")
        .when(fresh_speed & (F.col("speed") > 0), "MOVING")
        .when(fresh_speed & (F.col("speed") == 0) & (F.col("ignition_ts") >= since) & (F.col("ignition") == 1), "IDLE")
        .otherwise("STOPPED")
    )


def scored(roster: DataFrame, latest: DataFrame, fixes: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    rows = roster.join(pivot_latest(latest), "vehicle_id", "left").join(last_ping(latest, fixes), "vehicle_id", "left").join(badges(alerts), "vehicle_id", "left")
    return rows.withColumn("status", ladder(now)).select("vehicle_id", "reg_no", "model", "soc", "range_km", "speed", "last_ping", "status", "alert_severity")


def status_counts(fleet: DataFrame) -> DataFrame:
    """A row a status, zero where empty, and ALL: one aggregate, one row."""
    parts = [F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("n")) for s in STATUSES]
    return fleet.agg(F.array(*parts, F.struct(F.lit("ALL").alias("status"), F.count(F.lit(1)).alias("n"))).alias("c")).select(F.explode("c").alias("c")).select("c.*")
