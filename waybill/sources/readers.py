"""Readers: packets (JSON files or a stream of them), their explosion into logs, and a telemetry view of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.columns import plus_seconds
from waybill.schemas import PACKET


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET).json(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", files_per_trigger).json(path)


def packet_signals(packets: DataFrame) -> DataFrame:
    """One row a signal of each packet."""
    return packets.select("vehicle_id", F.explode("signals").alias("signal", "value"), "event_ts").select("vehicle_id", "signal", "event_ts", "value")


def packet_fixes(packets: DataFrame) -> DataFrame:
    """A position row for each packet that has one."""
    return packets.filter("location IS NOT NULL").select("vehicle_id", "event_ts", "location.*")


#: The telemetry clock runs one second an event, and stands still for longer than a crossing's gap limit after so many.
BLOCK_EVENTS, BLOCK_GAP_SEC = 5_000, 2_200


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a vehicle's report; the vehicle is the user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.col("event_id") + BLOCK_GAP_SEC * F.floor(F.col("event_id") / BLOCK_EVENTS)
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    return rows.withColumn("vehicle_id", F.concat(F.lit("v"), F.col("user_id"))).withColumn("event_ts", plus_seconds(start, second))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a signal log: event_id, vehicle_id, signal, event_ts, value."""
    kind, value = F.col("event_type"), F.col("value")
    signal = F.when(kind == "view", "soc").when(kind == "purchase", "battery_temp").when(kind == "click", "speed").when(kind == "error", "ignition").otherwise("odometer")
    reading = (
        F.when(kind == "view", F.least(value, F.lit(100.0)))
        .when(kind == "purchase", value)
        .when(kind == "click", F.when(value < 20, 0.0).otherwise(value))
        .when(kind == "error", F.when(value > 25, 1.0).otherwise(0.0))
        .otherwise(F.col("event_id").cast("double") / 10.0)
    )
    return _events(spark, sf_dir).select("event_id", "vehicle_id", signal.alias("signal"), "event_ts", reading.alias("value"))


def event_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a position log: event_id, vehicle_id, event_ts, lat, lon, accuracy_m."""
    i, tick, e = F.col("user_id"), F.col("event_id").cast("double") / 10.0, F.col("event_id")
    lat, lon = F.round(12.96 + 0.055 * F.sin((i * 11 + tick) / 41.0), 6), F.round(77.60 + 0.055 * F.cos((i * 13 + tick) / 37.0), 6)
    accuracy = F.when(e % 10 == 3, None).when(e % 10 == 7, 150.0).otherwise(5.0 + e % 40).cast("double")
    return _events(spark, sf_dir).select("event_id", "vehicle_id", "event_ts", lat.alias("lat"), lon.alias("lon"), accuracy.alias("accuracy_m"))


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets in their JSON form, one line a report: a subset of the signals (a charge comes with its range), and a position."""
    fixes = event_fixes(spark, sf_dir).select("event_id", F.struct("lat", "lon", "accuracy_m").alias("location"))
    rows = event_signals(spark, sf_dir).join(fixes, "event_id")
    also = F.when(F.col("signal") == "soc", F.map_from_arrays(F.array(F.lit("range_km")), F.array(F.col("value") * 4))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    signals = F.map_concat(F.map_from_arrays(F.array("signal"), F.array("value")), also)
    place = F.when(F.col("event_id") % 4 != 1, F.col("location"))
    return rows.select(F.to_json(F.struct("vehicle_id", "event_ts", signals.alias("signals"), place.alias("location"))).alias("line"))


def parse_packets(lines: DataFrame) -> DataFrame:
    """Packets from lines of JSON, as read_packets() gives them from files."""
    return lines.select(F.from_json("line", PACKET).alias("p")).select("p.*")
