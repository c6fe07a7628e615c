"""Headline queries, timed: one JSON line.  BENCH_SF_DIR: folder of tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waybill.functions.columns import plus_seconds
from waybill.operators import alerts, geofence, ingest, retention, status, trips
from waybill.plans.fleet import QUERIES, Fleet
from waybill import schemas

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["f6_status_counts", "f7_moving_rows", "v6_history", "a8_episodes", "g11_transitions", "t8_trips", "r1_roll_up", "i3_append_absent"]


def timed(make) -> float:
    """Seconds to build and run ``make()``: some queries write shared tables while they are built."""
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def fleet_rows(spark: SparkSession, name: str, now, vehicles: int = 500, ticks: int = 700, step: int = 10):
    """(signals, fixes) of a fleet that drives in circles: vehicles x 6 signals x ticks, and a fix a tick."""
    grid = spark.range(vehicles * ticks).select((F.col("id") % vehicles).alias("v"), F.floor(F.col("id") / vehicles).alias("t"))
    grid = grid.select(F.concat(F.lit(name), "v").alias("vehicle_id"), plus_seconds(now, -(F.col("t") * step)).alias("event_ts"), "v", "t")
    turn = (F.col("v") * 29 + F.col("t")) / 60.0
    level = lambda low, high: F.round(low + (high - low) * (1 + F.cos(turn)) / 2, 1)
    values = {"soc": level(5, 95), "range_km": level(20, 400), "speed": level(0, 80), "battery_temp": level(20, 50), "odometer": 1e5 - F.col("t"), "ignition": (F.col("t") % 12 > 0).cast("double")}
    signals = grid.select("vehicle_id", F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))).alias("signal", "value"), "event_ts")
    fixes = grid.select("vehicle_id", "event_ts", (12.97 + 0.06 * F.sin(turn)).alias("lat"), (77.6 + 0.06 * F.cos(turn)).alias("lon"), F.lit(8.0).alias("accuracy_m"))
    return signals.select("vehicle_id", "signal", "event_ts", "value"), fixes


def main() -> None:
    cpus, scratch = os.environ.get("BENCH_CPUS", "8"), tempfile.mkdtemp(prefix="waybill-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    timed(lambda: QUERIES["f6_status_counts"](Fleet(spark, SF_DIR)))  # warm-up
    for name in HEADLINE:
        took[name] = timed(lambda name=name: QUERIES[name](Fleet(spark, SF_DIR)))

    # the list of the published figures reads kept state, not the log: latest values, last fixes and alerts, written beforehand
    fleet = Fleet(spark, SF_DIR)
    for name, df in (("latest", fleet.latest), ("last_fix", fleet.fix.groupBy("vehicle_id").agg(F.max("event_ts").alias("event_ts"))), ("alert", fleet.alerts), ("roster", fleet.roster)):
        df.write.parquet(f"{scratch}/{name}")
    kept = {name: spark.read.parquet(f"{scratch}/{name}") for name in ("roster", "latest", "last_fix", "alert")}
    at = F.lit(str(kept["latest"].agg(F.max("event_ts")).first()[0])).cast("timestamp_ntz")
    scored = lambda: status.scored(kept["roster"], kept["latest"], kept["last_fix"], kept["alert"], at)
    timed(lambda: status.status_counts(scored()))
    start = time.perf_counter()
    once = scored().persist()  # a row a vehicle; both statements read it
    timed(lambda: status.status_counts(once))
    timed(lambda: once.filter("status = 'MOVING'").orderBy("reg_no"))
    took["list_refresh"] = round(time.perf_counter() - start, 3)
    once.unpersist()

    # as much as the published load: 500 vehicles x 6 signals x 700 ticks = 2.1 M readings
    def written(df, name: str) -> float:
        start = time.perf_counter()
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return round(time.perf_counter() - start, 3)

    now = F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00'")
    signals, fixes = fleet_rows(spark, "a", now)
    took["load_2m"] = round(written(signals, "signal") + written(fixes, "fix"), 3)
    written(fleet_rows(spark, "b", now)[0], "other")
    log, fix = spark.read.parquet(f"{scratch}/signal"), spark.read.parquet(f"{scratch}/fix")
    took["insert_absent_2m"] = written(ingest.append_absent(spark.read.parquet(f"{scratch}/other"), log, ingest.KEY), "appended")
    scope, fences, spec = geofence.full_scope(log.select("vehicle_id").distinct()), schemas.seed_fences(spark), schemas.signal_spec(spark)
    took["derive_alerts_2m"] = written(alerts.episodes(log, spec, schemas.alert_signals(spark)), "episodes")
    start = time.perf_counter()
    votes = geofence.derive(fix, fences, scope)
    found = trips.derive(geofence.transitions(votes), geofence.containment(votes), fences, log, scope)
    took["derive_trips_2m"] = round(time.perf_counter() - start + written(found, "trips"), 3)
    horizon = F.expr("TIMESTAMP_NTZ'2024-05-31 23:00:00'")
    took["compact_2m"] = round(written(retention.roll_up(log, horizon), "rolled") + written(retention.surviving(log, spark.read.parquet(f"{scratch}/rolled"), horizon), "survived"), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
