"""Exactly-once ingest by natural key, as functions from frames to frames.

Keys are vehicle-first, so every join and window of one batch shares a partitioning; dimensions are
small by nature (roster, configuration) and left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["vehicle_id", "signal", "event_ts"]


def new_roster_rows(offered: DataFrame, roster: DataFrame) -> DataFrame:
    first = Window.partitionBy("vehicle_id").orderBy("reg_no", "model")
    one = offered.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")
    return one.join(roster, "vehicle_id", "left_anti")


def drop_orphans(batch: DataFrame, roster: DataFrame, spec: DataFrame) -> DataFrame:
    """Rows of known vehicles and signals."""
    return batch.join(roster.select("vehicle_id"), "vehicle_id", "left_semi").join(spec.select("signal"), "signal", "left_semi").select(*batch.columns)


def dedupe(batch: DataFrame) -> DataFrame:
    """One row a natural key: the smallest value, with the number of distinct values it met."""
    return batch.groupBy(*KEY).agg(F.min("value").alias("value"), (F.count_distinct("value") - 1).alias("conflicts"))


def append_absent(batch: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the log lacks; the log is read only for the batch's own span of time.

    A log partitioned by event_date is pruned to the batch's dates.  Both ends come from one pass.
    """
    span = batch.agg(F.struct(F.min("event_ts").alias("low"), F.max("event_ts").alias("high"))).scalar()
    near = log.filter((F.col("event_ts") >= span["low"]) & (F.col("event_ts") <= span["high"]))
    if "event_date" in log.columns:
        near = near.filter((F.col("event_date") >= span["low"].cast("date")) & (F.col("event_date") <= span["high"].cast("date")))
    return batch.join(near.select(*key), key, "left_anti").select(*batch.columns)


def split_too_late(rows: DataFrame, cut_off: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to apply, rows older than the cut-off): the latter cannot be replayed and are rejected; a row without a time is never too late."""
    old = F.coalesce(F.col("event_ts") < cut_off, F.lit(False))
    return rows.filter(~old), rows.filter(old)


def newest(log: DataFrame) -> DataFrame:
    """Latest value a vehicle and signal."""
    return log.groupBy("vehicle_id", "signal").agg(F.max("event_ts").alias("event_ts"), F.max_by("value", "event_ts").alias("value"))


def advance_latest(latest: DataFrame, batch: DataFrame) -> DataFrame:
    """Old and new latest values; a batch row wins only when strictly newer."""
    both = latest.withColumn("age_", F.lit(1)).unionByName(newest(batch).withColumn("age_", F.lit(0)))
    order = F.struct("event_ts", "age_")
    return both.groupBy("vehicle_id", "signal").agg(F.max("event_ts").alias("event_ts"), F.max_by("value", order).alias("value"))


def late_vehicles(signals: DataFrame, fixes: DataFrame, watermark: DataFrame) -> DataFrame:
    seen = signals.select("vehicle_id", "event_ts").unionByName(fixes.select("vehicle_id", "event_ts"))
    first = seen.groupBy("vehicle_id").agg(F.min("event_ts").alias("first_ts"))
    return first.join(watermark, "vehicle_id").filter("first_ts < processed_through").select("vehicle_id")


def advance_watermark(watermark: DataFrame, signals: DataFrame, fixes: DataFrame) -> DataFrame:
    seen = [f.select("vehicle_id", F.col("event_ts").alias("processed_through")) for f in (signals, fixes)]
    every = watermark.unionByName(seen[0]).unionByName(seen[1])
    return every.groupBy("vehicle_id").agg(F.max("processed_through").alias("processed_through"))


POSITION = ["vehicle_id", "event_ts"]


def receipts(batches: DataFrame, log: DataFrame, roster: DataFrame, spec: DataFrame, fixes: DataFrame, fix_log: DataFrame, watermark: DataFrame) -> DataFrame:
    """One row a batch (batch_id): packets, orphans, offered, applied, late, duplicates.

    ``batches`` are signal rows, with batch_id and the packet_id of the packet that each came in, and
    ``fixes`` position rows with batch_id.  Offered and applied
    count keys of both; a key counts as applied in its first batch.  Late counts vehicles whose first
    report in the batch is older than their watermark.
    """
    known = batches.join(roster.select("vehicle_id", F.lit(1).alias("v_")), "vehicle_id", "left").join(spec.select("signal", F.lit(1).alias("s_")), "signal", "left")
    known = known.withColumn("kept_", F.col("v_").isNotNull() & F.col("s_").isNotNull())
    counts = known.groupBy("batch_id").agg(F.count_distinct("packet_id").alias("packets"), F.count_if(~F.col("kept_")).alias("orphans"))
    clean, placed = known.filter("kept_"), fixes.join(roster.select("vehicle_id"), "vehicle_id", "left_semi")
    offers = [(clean.groupBy("batch_id", *KEY), log, KEY), (placed.groupBy("batch_id", *POSITION), fix_log, POSITION)]
    tallies = []
    for rows, kept, key in offers:
        keys = rows.agg(F.count(F.lit(1)).alias("copies"))
        fresh = append_absent(keys.groupBy(*key).agg(F.min("batch_id").alias("batch_id")), kept, key)
        tallies += [keys.select("batch_id", F.lit(1).alias("o"), F.lit(0).alias("a")), fresh.select("batch_id", F.lit(0).alias("o"), F.lit(1).alias("a"))]
    both = tallies[0].unionByName(tallies[1]).unionByName(tallies[2]).unionByName(tallies[3]).groupBy("batch_id").agg(F.sum("o").alias("offered"), F.sum("a").alias("applied"))
    seen = clean.select("batch_id", "vehicle_id", "event_ts").unionByName(placed.select("batch_id", "vehicle_id", "event_ts"))
    late = seen.groupBy("batch_id", "vehicle_id").agg(F.min("event_ts").alias("first_ts")).join(watermark, "vehicle_id").filter("first_ts < processed_through").groupBy("batch_id").agg(F.count(F.lit(1)).alias("late"))
    out = counts.join(both, "batch_id", "left").join(late, "batch_id", "left").fillna(0, ["offered", "applied", "late"])
    return out.select("batch_id", "packets", "orphans", "offered", "applied", "late", (F.col("offered") - F.col("applied")).alias("duplicates"))
