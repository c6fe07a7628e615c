"""Fixed values of the fleet model: table schemas, signal configuration, fences, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKET = "vehicle_id string, event_ts timestamp_ntz, signals map<string,double>, location struct<lat:double,lon:double,accuracy_m:double>"
SPEC = "signal string, label string, unit string, max_age_sec int, warn_lo double, warn_hi double, crit_lo double, crit_hi double"
FENCE = "geofence_id string, name string, lat double, lon double, radius_m double, active_from timestamp_ntz, active_to timestamp_ntz, updated_at timestamp_ntz"
CONTAINMENT = "vehicle_id string, geofence_id string, zone string, pending_zone string, pending_ts timestamp_ntz"

# Configuration of signals, seed fences, alert types, statuses, display order.
SIGNAL_SPEC = [
    ("soc", "State of charge", "%", 300, 20.0, None, 10.0, None),
    ("range_km", "Range", "km", 300, None, None, None, None),
    ("speed", "Speed", "km/h", 300, None, None, None, None),
    ("battery_temp", "Battery temperature", "C", 300, None, None, None, 45.0),
    ("odometer", "Odometer", "km", 3600, None, None, None, None),
    ("ignition", "Ignition", "", 300, None, None, None, None),
]
SEED_FENCES = [
    ("gf-depot", "Whitefield Depot", 12.97, 77.60, 2500.0),
    ("gf-bay3", "Depot Bay 3", 12.971, 77.6015, 350.0),
    ("gf-ecity", "Electronic City Hub", 12.925, 77.56, 1800.0),
    ("gf-hebbal", "Hebbal Yard", 13.02, 77.65, 1500.0),
]
ALERT_SIGNALS = [("battery_low", "soc"), ("battery_overheat", "battery_temp")]
STATUSES = ["MOVING", "IDLE", "STOPPED", "OFFLINE"]
REGISTER_ORDER = ["soc", "range_km", "speed", "battery_temp", "odometer", "ignition"]

OFFLINE_SEC = 600
CLEAR_BAND = 2.0
ACCURACY_GATE_M = 100.0
MIN_BAND_M = 25.0
GAP_SEC = 1800
EARTH_M = 6_371_000.0
BUCKET_SEC = 300
RETENTION_DAYS = 7


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    return f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table, whose size the planner knows, so that it decides itself whether to broadcast it."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    columns = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(fields))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({', '.join(f'c{i}' for i in range(len(fields)))})")


def signal_spec(spark: SparkSession) -> DataFrame:
    return _values(spark, SIGNAL_SPEC, SPEC)


def seed_fences(spark: SparkSession) -> DataFrame:
    rows = _values(spark, SEED_FENCES, "geofence_id string, name string, lat double, lon double, radius_m double")
    return rows.selectExpr("*", "TIMESTAMP_NTZ'2000-01-01 00:00:00' AS active_from", "CAST(NULL AS TIMESTAMP_NTZ) AS active_to", "TIMESTAMP_NTZ'2000-01-01 00:00:00' AS updated_at")


def alert_signals(spark: SparkSession) -> DataFrame:
    return _values(spark, ALERT_SIGNALS, "alert_type string, signal string")
