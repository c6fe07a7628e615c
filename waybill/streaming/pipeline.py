"""Structured Streaming over packets: exactly-once log, and everything derived from it, batch by batch.

A batch runs in a fixed order: stage, reject what is too old, log and latest values, lateness, alerts,
fences, trips, and the watermark last.  Every table is read as it was before the batch and written as the
batch's own version, so a batch that runs again, after a failure at any point, gives the same tables.
Only the buckets of vehicles that a batch touches are read and written; the log is read for the dates
that a batch needs, the odometer's past from the readings that are kept of it.  Counts of a receipt are observed on the rows as they are written.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waybill import schemas
from waybill.functions.columns import plus_seconds
from waybill.functions.lineage import cut
from waybill.operators import alerts, geofence, ingest, retention, status, trips
from waybill.sources.readers import packet_fixes, packet_signals
from waybill.streaming.store import STEP, KeyedStore

LOGS = {
    "signal_reading": "vehicle_id string, signal string, event_ts timestamp_ntz, value double",
    "location_fix": "vehicle_id string, event_ts timestamp_ntz, lat double, lon double, accuracy_m double",
    "receipt": "vehicle_id string, packets bigint, rejected bigint, orphans bigint, offered bigint, applied bigint, late bigint, duplicates bigint",
    "rejected": "vehicle_id string, event_ts timestamp_ntz, packet string",
    "signal_rollup": "vehicle_id string, signal string, bucket_ts timestamp_ntz, readings bigint, min_value double, max_value double, avg_value double, last_value double, last_ts timestamp_ntz",
}
DATED = {"signal_reading": "event_ts", "location_fix": "event_ts", "rejected": "event_ts", "signal_rollup": "bucket_ts"}
STATES = {
    "latest": LOGS["signal_reading"],
    "last_fix": "vehicle_id string, event_ts timestamp_ntz",
    "watermark": "vehicle_id string, processed_through timestamp_ntz",
    "transition": "vehicle_id string, geofence_id string, event_ts timestamp_ntz, kind string, confidence string",
    "containment": schemas.CONTAINMENT,
    "alert": "alert_id string, vehicle_id string, alert_type string, severity string, raised_at timestamp_ntz, escalated_at timestamp_ntz, resolved_at timestamp_ntz, dismissed_at timestamp_ntz, dismiss_reason string",
    "trip": "trip_id string, vehicle_id string, origin_geofence_id string, start_ts timestamp_ntz, dest_geofence_id string, end_ts timestamp_ntz, status string, distance_km double, confidence string",
    "odometer": "vehicle_id string, event_ts timestamp_ntz, value double",
}
#: Receipts belong to a batch and to no vehicle.
NOBODY = "-"


def open_store(spark: SparkSession, root: str, buckets: int = 16) -> KeyedStore:
    return KeyedStore(spark, root, LOGS, STATES, DATED, buckets)


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _told(observation: Observation) -> dict:
    """What was observed.  Rows that Spark finds to be none before it runs them are not observed: there are none."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}


class FleetStream:
    """The state of one stream; ``apply`` is the function for foreachBatch.

    ``keep_sec``: packets older than this, against the newest event time seen, are rejected and counted.
    """

    def __init__(self, store: KeyedStore, roster: DataFrame, fences: DataFrame, now: str | None = None, keep_sec: int | None = None) -> None:
        self.store, self.roster, self.fences, self.fixed_now, self.keep_sec = store, roster, fences, now, keep_sec
        self.spec = schemas.signal_spec(store.spark)

    def apply(self, packets: DataFrame, batch_id: int) -> None:
        s, v = self.store, batch_id
        s.vacuum(v)
        seen = {name: Observation(f"{name}-{v}") for name in ("packets", "rejected", "offered", "placed", "late", "signals", "fixes")}

        # observed where they are written, at the top of a plan: what stands below an empty join may never run
        packets = s.stage("packets", packets.observe(seen["packets"], _count("n"), F.max("event_ts").alias("newest")))
        fresh, old = self._split(packets, v)
        s.append("rejected", old.select("vehicle_id", "event_ts", F.to_json(F.struct(*packets.columns)).alias("packet")).observe(seen["rejected"], _count("n")), v)
        rows = packet_signals(fresh)
        told = rows.join(self.roster.select("vehicle_id", F.lit(1).alias("v_")), "vehicle_id", "left").join(F.broadcast(self.spec.select("signal", F.lit(1).alias("s_"))), "signal", "left")  # six signals
        known = F.col("v_").isNotNull() & F.col("s_").isNotNull()
        keys = told.groupBy(*ingest.KEY, known.alias("known_")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("copies_"))
        counts = (F.count_if("known_").alias("n"), F.coalesce(F.sum(F.when(~F.col("known_"), F.col("copies_"))), F.lit(0)).alias("orphans"))
        offered = s.stage("signals", keys.observe(seen["offered"], *counts)).filter("known_").select(*rows.columns)
        one = packet_fixes(fresh).join(self.roster.select("vehicle_id"), "vehicle_id", "left_semi").groupBy("vehicle_id", "event_ts").agg(F.min(F.struct("lat", "lon", "accuracy_m")).alias("p"))
        fixes = s.stage("fixes", one.select("vehicle_id", "event_ts", "p.*").observe(seen["placed"], _count("n")))

        span = offered.select("vehicle_id", "event_ts").unionByName(fixes.select("vehicle_id", "event_ts")).groupBy("vehicle_id").agg(F.min("event_ts").alias("first_ts"))
        watermark = s.read("watermark", before=v)
        late = F.coalesce(F.col("first_ts") < F.col("processed_through"), F.lit(False))
        t = s.touched(s.stage("touched", span.join(watermark, "vehicle_id", "left").observe(seen["late"], F.count_if(late).alias("n"))))
        newest = _told(seen["packets"]).get("newest")
        now = F.lit(self.fixed_now or (str(newest) if newest else None)).cast("timestamp_ntz")
        watermark = s.read("watermark", t, v)

        s.append("signal_reading", ingest.append_absent(offered, s.log("signal_reading", v, t, parts=True), ingest.KEY).observe(seen["signals"], _count("n")), v)
        s.append("location_fix", ingest.append_absent(fixes, s.log("location_fix", v, t, parts=True), ingest.POSITION).observe(seen["fixes"], _count("n")), v)
        latest = ingest.advance_latest(s.read("latest", t, v), offered)
        s.replace("latest", latest, t, v)
        s.replace("last_fix", status.last_ping(s.read("last_fix", t, v), fixes).withColumnRenamed("last_ping", "event_ts"), t, v)
        s.replace("alert", alerts.evaluate(s.read("alert", t, v), alerts.conditions(s.read("latest", t), self.spec, now), now), t, v)

        state, scope = s.read("containment", t, v), geofence.batch_scope(fixes, watermark)
        votes = geofence.derive(self._needed(scope, v, t), self.fences, scope, state)
        s.replace("transition", geofence.replace_transitions(s.read("transition", t, v), geofence.transitions(votes), scope), t, v)
        s.replace("containment", geofence.replace_containment(state, geofence.containment(votes), scope), t, v)
        moved = fixes.select("vehicle_id").unionByName(offered.filter("signal = 'odometer'").select("vehicle_id")).distinct()
        outing, old_trips = trips.derived_outings(s.read("transition", t), s.read("containment", t), self.fences, moved), s.read("trip", t, v)
        readings = self._readings(trips.new_instants(outing, old_trips), v, t).join(moved, "vehicle_id", "left_semi")
        self._measure(outing, readings, old_trips, s.read("odometer", t, v), moved, t, v)

        n = {name: _told(o).get("n") or 0 for name, o in seen.items()}
        n_offered, applied = n["offered"] + n["placed"], n["signals"] + n["fixes"]
        receipt = [(NOBODY, n["packets"], n["rejected"], _told(seen["offered"]).get("orphans") or 0, n_offered, applied, n["late"], n_offered - applied)]
        s.append("receipt", s.spark.createDataFrame(receipt, LOGS["receipt"]), v)
        s.replace("watermark", ingest.advance_watermark(watermark, offered, fixes), t, v)

    def _split(self, packets: DataFrame, v: int) -> tuple[DataFrame, DataFrame]:
        """(packets to apply, packets too old)."""
        if self.keep_sec is None:
            return packets, packets.filter("false")
        last = F.greatest(packets.agg(F.max("event_ts")).scalar(), self.store.read("watermark", before=v).agg(F.max("processed_through")).scalar())
        return ingest.split_too_late(packets, plus_seconds(last, F.lit(-self.keep_sec)))

    def _needed(self, scope: DataFrame, v: int, t: list[int]) -> DataFrame:
        """Fixes that a scope reads: from its first day on, and earlier days for the buckets of vehicles that are replayed whole."""
        s = self.store
        log = s.log("location_fix", v + 1, t, parts=True)
        day = scope.filter("NOT full_replay").agg(F.coalesce(F.min("from_ts").cast("date"), F.expr("DATE'9999-12-31'"))).scalar()
        recent = log.filter(F.col("event_date") >= day)
        whole = s.touched(scope.filter("full_replay"))
        older = log.filter((F.col("event_date") < day) & F.col("bucket").isin(whole)) if whole else log.filter("false")
        return recent.unionByName(older).drop("version", "event_date", "bucket")

    def _readings(self, instants: DataFrame, v: int, t: list[int]) -> DataFrame:
        """Odometer readings that answer for old instants and ``instants``: those kept, the batch's own, and the log of the new instants' days."""
        s = self.store
        log = s.log("signal_reading", v + 1, t, parts=True).filter("signal = 'odometer'")
        if s.versions("odometer", v * STEP) or not s.versions("trip", v * STEP):
            log = log.filter((F.col("version") == v * STEP) | F.col("event_date").isin(s.days(instants, "at")))
        # trips of a store from before readings were kept: the whole log, once
        return log.select("vehicle_id", "event_ts", "value").unionByName(s.read("odometer", t, v)).distinct()

    def _measure(self, outing: DataFrame, readings: DataFrame, old_trips: DataFrame, old_readings: DataFrame, scope: DataFrame, t: list[int], v: int | None = None) -> None:
        """Trips and kept readings of the scope's vehicles anew."""
        measured = cut(trips.distances(outing, readings))
        self.store.replace("trip", trips.replace_trips(old_trips, trips.trips(measured), scope), t, v)
        self.store.replace("odometer", trips.replace_trips(old_readings, trips.kept_readings(measured, readings), scope), t, v)

    def rebuild(self) -> None:
        """All state tables of all buckets from the log alone, as versions after the newest."""
        s, every = self.store, list(range(self.store.buckets))
        signals, fixes = s.log("signal_reading"), s.log("location_fix")
        scope = geofence.full_scope(fixes.select("vehicle_id").distinct())
        none = {table: s.spark.createDataFrame([], schema) for table, schema in STATES.items()}
        newest = ingest.newest(signals)
        now = F.lit(self.fixed_now).cast("timestamp_ntz") if self.fixed_now else newest.agg(F.max("event_ts")).scalar()
        s.replace("latest", newest, every)
        s.replace("last_fix", fixes.groupBy("vehicle_id").agg(F.max("event_ts").alias("event_ts")), every)
        s.replace("alert", alerts.dismissed_as(alerts.evaluate(none["alert"], alerts.conditions(newest, self.spec, now), now), s.read("alert")), every)
        votes = geofence.derive(fixes, self.fences, scope)
        crossings, inside = geofence.transitions(votes), geofence.containment(votes)
        s.replace("transition", crossings, every)
        s.replace("containment", inside, every)
        vehicles = geofence.full_scope(signals.select("vehicle_id").unionByName(fixes.select("vehicle_id")).distinct())
        self._measure(trips.derived_outings(crossings, inside, self.fences, vehicles), trips.odometer(signals), none["trip"], none["odometer"], vehicles, every)
        s.replace("watermark", ingest.advance_watermark(none["watermark"], signals, fixes), every)

    def edit_fences(self, fences: DataFrame) -> None:
        """Go on with other fences: what follows from fences is derived anew from the whole log."""
        self.fences = fences
        s, every = self.store, list(range(self.store.buckets))
        signals, fixes = s.log("signal_reading"), s.log("location_fix")
        votes = geofence.derive(fixes, fences, geofence.full_scope(fixes.select("vehicle_id").distinct()))
        crossings, inside = geofence.transitions(votes), geofence.containment(votes)
        s.replace("transition", crossings, every)
        s.replace("containment", inside, every)
        vehicles = geofence.full_scope(signals.select("vehicle_id").unionByName(fixes.select("vehicle_id")).distinct())
        readings = trips.odometer(signals).unionByName(s.read("odometer")).distinct()  # the kept ones may be older than the log
        self._measure(trips.derived_outings(crossings, inside, fences, vehicles), readings, s.read("trip").limit(0), s.read("odometer"), vehicles, every)

    def dismiss(self, actions: DataFrame) -> None:
        """Dismissals and their undoing, on the stored alerts."""
        s = self.store
        hit = s.read("alert").join(actions.select("alert_id"), "alert_id", "left_semi")
        t = s.touched(hit)
        s.replace("alert", alerts.dismiss(s.read("alert", t), actions), t)

    def fleet_list(self, now: Column) -> DataFrame:
        """The status list from kept state alone: no log is read."""
        s = self.store
        return status.scored(self.roster, s.read("latest"), s.read("last_fix"), s.read("alert"), now)

    def compact(self, horizon: Column, run: int) -> None:
        """Roll readings older than the horizon up and drop what the buckets hold, and old positions.

        The buckets of a run are written once, before the log; a run that fails after that is done again
        under its own number, before any further batch, and then only drops what its buckets hold.
        """
        s = self.store
        log = s.log("signal_reading")
        mine = lambda: s.log("signal_rollup", parts=True).filter(F.col("version") == run * (1 << 20)).select(*retention.ROLL_UP)
        if run * (1 << 20) not in s.versions("signal_rollup"):
            s.append("signal_rollup", retention.roll_up(log, horizon), run)
        s.compact("signal_reading", retention.surviving(log, mine(), horizon))
        s.compact("location_fix", s.log("location_fix").filter(F.col("event_ts") >= horizon))

    def history(self) -> DataFrame:
        """Roll-ups of all runs and what is left of the log, as one history of buckets."""
        return retention.stitched(self.store.log("signal_reading"), self.store.log("signal_rollup"))

    def start(self, packets: DataFrame, checkpoint: str, first_filter: str | None = None, **trigger):
        """Run the stream.  ``first_filter``: for so long after its arrival a packet's exact repeats are dropped before any batch; later ones are no-ops by their keys."""
        if first_filter:
            packets = drop_repeats(packets, first_filter)
        return packets.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_repeats(packets: DataFrame, window: str) -> DataFrame:
    """A stream without exact repeats of packets that arrived within ``window``.  Time is that of arrival, so late packets go through."""
    digest = F.sha2(F.encode(F.to_json(F.struct(*packets.columns)), "UTF-8"), 256)
    named = packets.withColumn("digest_", digest).withColumn("arrived_", F.current_timestamp()).withWatermark("arrived_", window)
    return named.dropDuplicatesWithinWatermark(["digest_"]).select(*packets.columns)
