"""The registered fleet queries: each operator over the telemetry view of the whole ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waybill import schemas
from waybill.functions.columns import epoch_ms, plus_seconds, seconds_between
from waybill.functions.lineage import cut, shared_folder
from waybill.operators import alerts as A
from waybill.operators import detail as V
from waybill.operators import geofence as G
from waybill.operators import ingest as I
from waybill.operators import retention as R
from waybill.operators import status as S
from waybill.operators import trips as T
from waybill.operators.retention import percentiles
from waybill.streaming import detector as D
from waybill.streaming.pipeline import FleetStream, open_store
from waybill.sources.readers import event_fixes, event_packets, event_signals, packet_fixes, packet_signals, parse_packets


class Fleet:
    """Frames over one folder of tables, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sig(self) -> DataFrame:
        return event_signals(self.spark, self.sf_dir)

    @cached_property
    def fix(self) -> DataFrame:
        return event_fixes(self.spark, self.sf_dir)

    @cached_property
    def spec(self) -> DataFrame:
        return schemas.signal_spec(self.spark)

    @cached_property
    def kinds(self) -> DataFrame:
        return schemas.alert_signals(self.spark)

    @cached_property
    def fences(self) -> DataFrame:
        return schemas.seed_fences(self.spark)

    def at(self, second: Column | int) -> Column:
        return plus_seconds(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), second if isinstance(second, Column) else F.lit(second))

    @property
    def now(self) -> Column:
        """The newest report's time, as a subquery of one value that runs with the query."""
        return self.sig.agg(F.max("event_ts")).scalar()

    @property
    def mid(self) -> Column:
        """The middle of the telemetry's time."""
        newest = self.sig.agg(F.max("event_ts").alias("t"))
        return newest.select(self.at(F.floor(seconds_between(self.at(0), F.col("t")) / 2))).scalar()

    @cached_property
    def roster(self) -> DataFrame:
        ids = self.sig.select("vehicle_id").distinct().unionByName(self.spark.createDataFrame([("v-silent",)], "vehicle_id string"))
        return ids.select("vehicle_id", F.concat(F.lit("KA01EV"), F.lpad(F.substring("vehicle_id", 2, 99), 9, "0")).alias("reg_no"), F.lit("eT 1000").alias("model"))

    @cached_property
    def latest(self) -> DataFrame:
        return I.newest(self.sig)

    # the older half of the log, and a delivery of everything: repeats, conflicting values, unknown vehicles and signals
    @cached_property
    def log(self) -> DataFrame:
        return self.sig.filter(F.col("event_ts") <= self.mid)

    @cached_property
    def fix_log(self) -> DataFrame:
        return self.fix.filter(F.col("event_ts") <= self.mid)

    @cached_property
    def batch(self) -> DataFrame:
        e = F.col("event_id")
        again = F.explode(F.when(e % 15 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0)))).alias("more")
        both = self.sig.select("*", again).withColumn("value", F.col("value") + F.col("more"))
        return both.select(F.when(e % 50 == 0, "ghost").otherwise(F.col("vehicle_id")).alias("vehicle_id"), F.when(e % 35 == 5, "bogus").otherwise(F.col("signal")).alias("signal"), "event_ts", "value", (e % 3).alias("batch_id"), F.concat_ws("/", e, F.col("more").cast("int")).alias("packet_id"))

    @cached_property
    def clean(self) -> DataFrame:
        return I.drop_orphans(self.batch, self.roster, self.spec)

    @cached_property
    def fix_batch(self) -> DataFrame:
        return self.fix.withColumn("batch_id", F.col("event_id") % 3)

    @cached_property
    def watermark(self) -> DataFrame:
        none = self.spark.createDataFrame([], "vehicle_id string, processed_through timestamp_ntz")
        return I.advance_watermark(none, self.log, self.fix_log)

    @cached_property
    def old_alerts(self) -> DataFrame:
        return A.as_alerts(A.episodes(self.sig.filter(F.col("event_ts") <= self.mid), self.spec, self.kinds))

    @cached_property
    def alerts(self) -> DataFrame:
        return A.evaluate(self.old_alerts, A.conditions(self.latest, self.spec, self.now), self.now)

    @cached_property
    def actions(self) -> DataFrame:
        n = F.try_to_number(F.substring("vehicle_id", 2, 9), F.lit("999999999")).cast("int")
        rows = self.old_alerts.withColumn("n", n)
        return rows.select("alert_id", self.now.alias("at"), F.lit("known").alias("code"), F.when(F.col("n") % 2 == 1, "checked").otherwise("").alias("note"), (F.col("n") % 5 == 0).alias("undo"))

    @cached_property
    def scored(self) -> DataFrame:
        return S.scored(self.roster, self.latest, self.fix, self.alerts, self.now)

    @cached_property
    def history(self) -> DataFrame:
        return V.history(self.sig, "soc", self.at(0))

    @cached_property
    def scope(self) -> DataFrame:
        return G.full_scope(self.roster)

    @cached_property
    def votes(self) -> DataFrame:
        return G.derive(self.fix, self.fences, self.scope)

    @cached_property
    def ballots(self) -> DataFrame:
        return G.each_vote(self.fix, self.fences, self.scope)

    @cached_property
    def crossings(self) -> DataFrame:
        return G.transitions(self.votes)

    @cached_property
    def inside(self) -> DataFrame:
        return G.containment(self.votes)

    @cached_property
    def resumed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Crossings, containment and trips after two passes: the first half of the fixes, then the rest on its state."""
        first, rest = self.fix.filter(F.col("event_ts") <= self.mid), self.fix.filter(F.col("event_ts") > self.mid)
        before = G.derive(first, self.fences, self.scope)
        none = self.spark.createDataFrame([], "vehicle_id string, processed_through timestamp_ntz")
        scope = G.batch_scope(rest, I.advance_watermark(none, first, first))
        after = G.derive(self.fix, self.fences, scope, G.containment(before))
        crossings = G.replace_transitions(G.transitions(before), G.transitions(after), scope)
        inside = G.replace_containment(G.containment(before), G.containment(after), scope)
        old = T.derive(G.transitions(before), G.containment(before), self.fences, self.sig.filter(F.col("event_ts") <= self.mid), self.scope)
        # an odometer row alone moves an open trip's distance, so its vehicle is in the scope too
        moved = scope.select("vehicle_id").unionByName(self.sig.filter((F.col("event_ts") > self.mid) & (F.col("signal") == "odometer")).select("vehicle_id")).distinct()
        return crossings, inside, T.replace_trips(old, T.derive(crossings, inside, self.fences, self.sig, moved), moved)

    @cached_property
    def own_fences(self) -> DataFrame:
        """A fence around each vehicle's mean position; every fourth has no name."""
        mean = self.fix.groupBy("vehicle_id").agg(F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"), F.count(F.lit(1)).alias("n"))
        name = F.when(F.col("n") % 4 == 0, " ").otherwise(F.col("vehicle_id"))
        none, start = F.lit(None).cast("timestamp_ntz"), self.at(0)
        return mean.select(F.concat(F.lit("gf-"), "vehicle_id").alias("geofence_id"), name.alias("name"), "lat", "lon", (F.col("n") * 10.0).alias("radius_m"), start.alias("active_from"), none.alias("active_to"), start.alias("updated_at"))

    @cached_property
    def edits(self) -> DataFrame:
        some = self.own_fences.filter("pmod(CAST(radius_m AS INT), 3) = 0")
        return some.withColumn("radius_m", F.col("radius_m") * 2).withColumn("updated_at", self.mid)

    @cached_property
    def switches(self) -> DataFrame:
        rows = self.own_fences.select("geofence_id", self.mid.alias("at"), (F.col("radius_m") % 20 == 0).alias("active"))
        return rows.unionByName(rows.limit(1).select(F.lit("gf-nowhere").alias("geofence_id"), "at", "active"))

    @cached_property
    def steps(self) -> DataFrame:
        return T.steps(T.crossings(self.crossings, self.fences, self.scope))

    @cached_property
    def edges(self) -> DataFrame:
        return T.edges(T.occupancy(self.steps, self.inside))

    @cached_property
    def trips(self) -> DataFrame:
        return T.derive(self.crossings, self.inside, self.fences, self.sig, self.scope)

    @cached_property
    def resumed_distances(self) -> DataFrame:
        """Trips measured from the kept readings of the older half, the newer half, and the log of the new instants' days."""
        outing, log = T.derived_outings(self.crossings, self.inside, self.fences, self.scope), T.odometer(self.sig)
        older = cut(T.distances(T.derived_outings(*self.older, self.fences, self.scope), log.filter(F.col("event_ts") <= self.mid)))
        kept = T.kept_readings(older, log.filter(F.col("event_ts") <= self.mid))
        day = F.col("event_ts").cast("date")
        days = T.new_instants(outing, older).select(F.col("at").cast("date").alias("day")).distinct()
        near = log.join(days, day == F.col("day"), "left_semi")
        readings = kept.unionByName(log.filter(F.col("event_ts") > self.mid)).unionByName(near).distinct()
        return T.trips(T.distances(outing, readings))

    @cached_property
    def buckets(self) -> DataFrame:
        return R.roll_up(self.sig.drop("event_id"), self.mid)

    @cached_property
    def packets(self) -> DataFrame:
        return parse_packets(event_packets(self.spark, self.sf_dir))

    @cached_property
    def rejects(self) -> DataFrame:
        """Packets that are older than half of the telemetry's time."""
        return I.split_too_late(self.packets, self.mid)[1]

    @cached_property
    def receipts(self) -> DataFrame:
        return I.receipts(self.batch, self.log, self.roster, self.spec, self.fix_batch, self.fix_log, self.watermark)

    @cached_property
    def bundle(self) -> DataFrame:
        """All that a detail page shows, of every vehicle: one row a fact, named by its part and numbered in it."""
        text, number = (lambda c: F.col(c).cast("string")), (lambda c: F.col(c).cast("double"))
        none = {"at": F.lit(None).cast("timestamp_ntz"), "name": F.lit(None).cast("string"), "detail": F.lit(None).cast("string"), "amount": F.lit(None).cast("double")}

        def part(rows: DataFrame, label: str, order: list, **columns: Column) -> DataFrame:
            n = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(*order)) if order else F.lit(1)
            return rows.select("vehicle_id", F.lit(label).alias("part"), n.cast("long").alias("n"), *(c.alias(k) for k, c in (none | columns).items()))

        parts = [
            part(self.scored, "header", [], at=F.col("last_ping"), name=F.col("status"), detail=F.col("alert_severity"), amount=number("soc")),
            part(V.register(self.roster, self.spec, self.latest, self.now), "register", [F.asc_nulls_last("display_order"), "signal"], at=F.col("event_ts"), name=F.col("signal"), detail=F.col("verdict"), amount=number("value")),
            part(self.history, "history", ["bucket"], at=F.col("bucket_ts"), detail=text("readings"), amount=number("mean_value")),
            part(G.current_fence(self.fences, self.inside), "fence", [], name=F.col("geofence_id"), detail=F.col("name"), amount=number("radius_m")),
            part(G.recent(self.crossings, 8, "vehicle_id", "event_ts", "geofence_id"), "crossing", [F.desc("event_ts"), "geofence_id"], at=F.col("event_ts"), name=F.col("geofence_id"), detail=F.col("kind")),
            part(G.recent(self.trips, 6, "vehicle_id", "start_ts"), "trip", [F.desc("start_ts")], at=F.col("start_ts"), name=F.col("origin_geofence_id"), detail=F.col("dest_geofence_id"), amount=number("distance_km")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def seeds(self) -> DataFrame:
        """The votes that a pass over the newer half takes from the state of the older half."""
        first, rest = self.fix.filter(F.col("event_ts") <= self.mid), self.fix.filter(F.col("event_ts") > self.mid)
        none = self.spark.createDataFrame([], "vehicle_id string, processed_through timestamp_ntz")
        return G.seeds(G.containment(G.derive(first, self.fences, self.scope)), G.batch_scope(rest, I.advance_watermark(none, first, first)))

    @cached_property
    def appended(self) -> DataFrame:
        """The log after two appends: the older half to nothing, then a delivery of everything."""
        return self.log.select("vehicle_id", "signal", "event_ts", "value").unionByName(I.append_absent(I.dedupe(self.clean).drop("conflicts"), self.log, I.KEY))

    @cached_property
    def replaced(self) -> DataFrame:
        """Keyed tables after a replace of the vehicles that report in the newer half, by table: rows kept and rows new."""
        moved = self.sig.filter(F.col("event_ts") > self.mid).select("vehicle_id").distinct()
        tables = {"latest": (I.newest(self.log), self.latest), "trip": (T.derive(*self.older, self.fences, self.log, self.scope), self.trips)}
        rows = [T.replace_trips(old.select("vehicle_id", "key"), new.select("vehicle_id", "key").join(moved, "vehicle_id", "left_semi"), moved).select(F.lit(name).alias("kept_table"), "vehicle_id", "key") for name, (old, new) in ((n, (_keyed(a, n), _keyed(b, n))) for n, (a, b) in tables.items())]
        return rows[0].unionByName(rows[1])

    @cached_property
    def stored(self) -> DataFrame:
        """All tables of the stream's store after two batches, the older half of the telemetry and the newer: kept_table, vehicle_id, key, amount."""
        places = self.fix.select("event_id", F.struct("lat", "lon", "accuracy_m").alias("location"))
        packets = self.sig.join(places, "event_id").select("vehicle_id", "event_ts", F.create_map("signal", "value").alias("signals"), "location")
        stream = FleetStream(open_store(self.spark, f"{shared_folder(self.spark)}/store-{uuid.uuid4().hex}", 4), self.roster, self.fences)
        for i, half in enumerate((F.col("event_ts") <= self.mid, F.col("event_ts") > self.mid)):
            stream.apply(packets.filter(half), i)
        at, none, s = (lambda c: epoch_ms(F.col(c)).cast("string")), F.lit(None).cast("double"), stream.store
        tables = {
            "signal_reading": (s.log("signal_reading"), ["signal", at("event_ts")], F.col("value")),
            "location_fix": (s.log("location_fix"), [at("event_ts")], F.col("lat")),
            "latest": (s.read("latest"), ["signal", at("event_ts")], F.col("value")),
            "last_fix": (s.read("last_fix"), [at("event_ts")], none),
            "watermark": (s.read("watermark"), [at("processed_through")], none),
            "transition": (s.read("transition"), ["geofence_id", "kind", "confidence", at("event_ts")], none),
            "containment": (s.read("containment"), ["geofence_id", "zone", "pending_zone", at("pending_ts")], none),
            "odometer": (s.read("odometer"), [at("event_ts")], F.col("value")),
            "trip": (s.read("trip"), ["trip_id", "origin_geofence_id", "dest_geofence_id", "status", "confidence"], F.col("distance_km")),
        }
        parts = [rows.select(F.lit(name).alias("kept_table"), "vehicle_id", F.concat_ws("|", *key).alias("key"), amount.alias("amount")) for name, (rows, key, amount) in tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def keyed(self) -> DataFrame:
        """What the keyed detector tells of the fixes as a stream of files."""
        folder = f"{shared_folder(self.spark)}/keyed-{uuid.uuid4().hex}"
        source, key = self.fix.drop("event_id"), "spark.sql.streaming.stateStore.providerClass"
        source.write.parquet(f"{folder}/in")
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, D.PROVIDER)
        try:
            stream = self.spark.readStream.schema(source.schema).parquet(f"{folder}/in")
            told = D.detect(stream, self.fences, self.roster)
            write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
            told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(D.OUT).parquet(f"{folder}/out").drop("batch")

    @cached_property
    def older(self) -> tuple[DataFrame, DataFrame]:
        votes = G.derive(self.fix_log, self.fences, self.scope)
        return G.transitions(votes), G.containment(votes)


def _keyed(rows: DataFrame, table: str) -> DataFrame:
    """The key of a table's rows as one text."""
    key = F.col("trip_id") if table == "trip" else F.concat_ws("|", "vehicle_id", "signal", epoch_ms(F.col("event_ts")).cast("string"))
    return rows.select("vehicle_id", key.alias("key"))


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)  # one row each
    return out


def _rolled(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_value", F.round("avg_value", 6))


def _tables(f: Fleet) -> DataFrame:
    """What a batch leaves behind, by table: rows, and a sum over their keys' times; the watermark comes last."""
    at = lambda df, name, ts: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(epoch_ms(F.col(ts)) / 1000)).alias("seconds")).select(F.lit(name).alias("kept_table"), "n", "seconds")
    crossings, inside, trips = f.resumed
    latest = I.advance_latest(I.newest(f.log), I.dedupe(f.clean))
    parts = [at(f.appended, "signal_reading", "event_ts"), at(latest, "latest", "event_ts"), at(crossings, "transition", "event_ts"), at(inside, "containment", "pending_ts"), at(trips, "trip", "start_ts"), at(f.alerts, "alert", "raised_at"), at(I.advance_watermark(f.watermark, f.clean, f.fix_batch), "watermark", "processed_through")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ONE = "vehicle_id = 'v7'"

QUERIES: dict[str, Callable[[Fleet], DataFrame]] = {
    "s1_packets": lambda f: f.packets.select("vehicle_id", "event_ts", F.size("signals").alias("signals"), F.col("location").isNotNull().alias("placed")),
    "s2_packet_signals": lambda f: packet_signals(f.packets),
    "s3_packet_fixes": lambda f: packet_fixes(f.packets),
    "s4_new_roster_rows": lambda f: I.new_roster_rows(f.roster.unionByName(f.roster.withColumn("model", F.lit("eT 2000"))), f.roster.filter("length(vehicle_id) = 2")),
    "s5_config_in_use": lambda f: f.spec.join(f.sig.groupBy("signal").agg(F.count(F.lit(1)).alias("readings")), "signal", "left").select("signal", "label", "unit", "max_age_sec", F.coalesce("readings", F.lit(0)).alias("readings")),
    "s6_seed_fences": lambda f: G.probes(f.fix, f.fences, f.scope).groupBy("geofence_id").agg(F.count_if(F.col("distance_m") <= F.col("radius_m")).alias("fixes_inside")).join(f.fences, "geofence_id", "right").select("geofence_id", "name", "lat", "lon", "radius_m", "fixes_inside"),
    "s7_readings_by_alert_type": lambda f: f.sig.join(F.broadcast(f.kinds), "signal").groupBy("alert_type").agg(F.count(F.lit(1)).alias("readings")),
    "s8_one_signal_scan": lambda f: f.sig.filter(ONE).filter((F.col("signal") == "soc") & (F.col("event_ts") >= f.mid)).select("event_ts", "value"),
    "s9_log_append": lambda f: f.appended,
    "s10_keyed_replace": lambda f: f.replaced,
    "s10_stored_tables": lambda f: f.stored,
    "s11_totals": lambda f: _all(_n(f.roster, "vehicles"), _n(f.sig, "signal_rows"), _n(f.fix, "fix_rows"), f.sig.agg(F.max("event_ts").alias("newest_ts"))),
    "i1_orphans": lambda f: _all(_n(f.batch, "total"), _n(f.clean, "kept")).withColumn("orphans", F.col("total") - F.col("kept")),
    "i2_dedupe": lambda f: I.dedupe(f.clean),
    "i3_append_absent": lambda f: I.append_absent(I.dedupe(f.clean).drop("conflicts"), f.log, I.KEY),
    "i4_advance_latest": lambda f: I.advance_latest(I.newest(f.log), I.dedupe(f.clean)),
    "i5_late_vehicles": lambda f: _n(I.late_vehicles(f.clean, f.fix_batch, f.watermark), "late"),
    "i6_advance_watermark": lambda f: I.advance_watermark(f.watermark, f.clean, f.fix_batch),
    "i7_offered": lambda f: _all(_n(f.clean.select(*I.KEY).distinct(), "signals"), _n(f.fix_batch.select("vehicle_id", "event_ts").distinct(), "fixes")),
    "i8_receipts": lambda f: f.receipts,
    "i12_rejected": lambda f: f.rejects.select("vehicle_id", "event_ts", F.size("signals").alias("signals")),
    "i9_session_totals": lambda f: f.receipts.agg(*(F.sum(c).alias(c) for c in ("packets", "orphans", "offered", "applied", "late", "duplicates"))),
    "i10_batch_state": lambda f: _tables(f),
    "i11_rebuild": lambda f: _all(_n(f.latest, "latest"), _n(f.crossings, "transitions"), _n(f.inside, "containment"), _n(f.trips, "trips"), _n(f.alerts, "alerts")),
    "f1_pivot_latest": lambda f: S.pivot_latest(f.latest),
    "f2_last_ping": lambda f: S.last_ping(f.latest, f.fix),
    "f3_badges": lambda f: S.badges(f.alerts),
    "f4_status": lambda f: f.scored.select("vehicle_id", "status"),
    "f5_scored_fleet": lambda f: f.scored,
    "f6_status_counts": lambda f: S.status_counts(f.scored),
    "f7_moving_rows": lambda f: f.scored.filter("status = 'MOVING'").orderBy("reg_no"),
    "v1_header": lambda f: f.scored.filter(ONE),
    "v2_register": lambda f: V.register(f.roster, f.spec, f.latest, f.now),
    "v3_register_order": lambda f: V.register(f.roster, f.spec, f.latest, f.now).filter(ONE).orderBy(F.asc_nulls_last("display_order")).select("display_order", "signal", "verdict"),
    "v4_soc_spans": lambda f: V.spans(f.sig, "soc", f.at(0)),
    "v5_bucket_widths": lambda f: V.widths(V.spans(f.sig, "soc", f.at(0))).select("vehicle_id", "width_s"),
    "v6_history": lambda f: f.history,
    "v7_history_summary": lambda f: V.history_summary(f.history),
    "v8_ages": lambda f: f.latest.select("vehicle_id", "signal", F.floor(seconds_between(F.col("event_ts"), f.now)).cast("long").alias("age_s")),
    "v9_detail_bundle": lambda f: f.bundle,
    "a1_thresholds_met": lambda f: _all(A.thresholds(f.spec), f.sig.filter("signal = 'soc'").agg(F.count_if(F.col("value") < 20).alias("soc_below"))),
    "a2_fresh_battery": lambda f: A.fresh_battery(f.latest, f.spec, f.now),
    "a3_conditions": lambda f: A.conditions(f.latest, f.spec, f.now),
    "a4_resolved": lambda f: f.alerts.filter(F.col("resolved_at") == f.now).select("alert_id", "severity"),
    "a5_escalated": lambda f: f.alerts.filter(F.col("escalated_at") == f.now).select("alert_id", "severity", "raised_at"),
    "a6_raised": lambda f: f.alerts.filter(F.col("raised_at") == f.now).select("alert_id", "vehicle_id", "alert_type", "severity"),
    "a7_evaluate": lambda f: f.alerts,
    "a8_episodes": lambda f: A.episodes(f.sig, f.spec, f.kinds),
    "a9_dismissals": lambda f: A.dismiss(f.old_alerts, f.actions),
    "a10_open_list": lambda f: A.open_list(f.alerts, f.roster, f.kinds, f.spec, f.latest, f.now).drop("is_stale", "eased_off", "age_s").orderBy(F.col("severity") != "critical", F.desc("raised_at"), "alert_id"),
    "a11_card_facts": lambda f: A.open_list(f.alerts, f.roster, f.kinds, f.spec, f.latest, f.now).select("alert_id", "is_stale", "eased_off", "age_s"),
    "a12_badge_totals": lambda f: f.alerts.filter("resolved_at IS NULL AND dismissed_at IS NULL").agg(F.count(F.lit(1)).alias("open_alerts"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("any_critical")),
    "g1_distances": lambda f: G.probes(f.fix, f.fences, f.scope).groupBy("geofence_id").agg(F.round(F.min("distance_m"), 3).alias("nearest_m"), F.round(F.max("distance_m"), 3).alias("farthest_m")),
    "g2_batch_scope": lambda f: G.batch_scope(f.fix_batch, f.watermark),
    "g3_full_scope": lambda f: f.scope.select("vehicle_id", "full_replay"),
    "g4_probes": lambda f: G.probes(f.fix, f.fences, f.scope).groupBy("vehicle_id", "geofence_id").agg(F.count(F.lit(1)).alias("probes"), F.sum("band_m").alias("band_m")),
    "g5_opinions": lambda f: G.opinions(G.probes(f.fix, f.fences, f.scope)),
    "g6_seed_votes": lambda f: f.seeds.select("vehicle_id", "geofence_id", "event_ts", "zone", "seed_zone"),
    "g7_votes": lambda f: G.ballots(G.opinions(G.probes(f.fix, f.fences, f.scope))).groupBy("geofence_id", "zone").agg(F.count(F.lit(1)).alias("votes")),
    "g8_previous": lambda f: f.ballots.select("vehicle_id", "geofence_id", "event_ts", F.col("last_vote.zone").alias("last_zone"), F.col("last_vote.event_ts").alias("last_ts")),
    "g9_confirmed": lambda f: f.ballots.select("vehicle_id", "geofence_id", "event_ts", "settles", F.when(F.col("last_vote.zone") == F.col("zone"), F.col("last_vote.event_ts")).otherwise(F.col("event_ts")).alias("since_ts")),
    "g10_settled": lambda f: f.ballots.select("vehicle_id", "geofence_id", "event_ts", "stood"),
    "g11_transitions": lambda f: f.crossings,
    "g12_containment": lambda f: f.inside,
    "g13_incremental_crossings": lambda f: f.resumed[0],
    "g12_incremental_containment": lambda f: f.resumed[1],
    "g11_keyed_crossings": lambda f: D.crossings(f.keyed),
    "g14_recompute": lambda f: f.crossings.groupBy("geofence_id", "kind", "confidence").agg(F.count(F.lit(1)).alias("n")),
    "g15_occupancy": lambda f: G.occupancy(f.fences, f.inside).orderBy(F.desc("active"), "name"),
    "g16_current_fence": lambda f: G.current_fence(f.fences, f.inside),
    "g17_recent_crossings": lambda f: G.recent(f.crossings, 8, "vehicle_id", "event_ts", "geofence_id"),
    "g18_upsert_fences": lambda f: G.upsert_fences(f.own_fences, f.edits),
    "g19_switch_fences": lambda f: G.switch_fences(f.own_fences, f.switches)[0].select("geofence_id", "active_from", "active_to"),
    "g19_rejected": lambda f: G.switch_fences(f.own_fences, f.switches)[1].select("geofence_id"),
    "g20_fence_problems": lambda f: f.own_fences.select("geofence_id", G.fence_problem().alias("problem")),
    "g21_active_fences": lambda f: _n(G.switch_fences(f.own_fences, f.switches)[0].filter("active_to IS NULL"), "active"),
    "g21_fence_by_id": lambda f: f.own_fences.filter("geofence_id = 'gf-v7'"),
    "t1_crossings": lambda f: T.crossings(f.crossings, f.fences, f.scope).select("vehicle_id", "event_ts", "kind", "geofence_id", "radius_m"),
    "t2_baselines": lambda f: T.baselines(f.crossings, f.inside, f.scope),
    "t3_steps": lambda f: f.steps,
    "t4_occupancy": lambda f: T.occupancy(f.steps, f.inside).select("vehicle_id", "event_ts", "before", "after"),
    "t5_edges": lambda f: f.edges,
    "t6_outings": lambda f: T.outings(f.edges),
    "t7_distances": lambda f: f.trips.select("trip_id", "distance_km"),
    "t7_kept_readings": lambda f: T.kept_readings(T.distances(T.derived_outings(f.crossings, f.inside, f.fences, f.scope), T.odometer(f.sig)), T.odometer(f.sig)),
    "t7_resumed_distances": lambda f: f.resumed_distances.select("trip_id", "distance_km"),
    "t8_trips": lambda f: f.trips,
    "t9_incremental_trips": lambda f: f.resumed[2],
    "t10_fleet_trips": lambda f: T.fleet_list(f.trips, f.fences, 50),
    "t11_vehicle_trips": lambda f: G.recent(f.trips, 6, "vehicle_id", "start_ts"),
    "t12_elapsed": lambda f: T.elapsed(f.trips, f.now),
    "r1_roll_up": lambda f: _rolled(f.buckets),
    "r2_surviving": lambda f: R.surviving(f.sig.drop("event_id"), f.buckets, f.mid),
    "r3_fixes_kept": lambda f: _n(f.fix.filter(F.col("event_ts") >= f.mid), "fixes"),
    "r4_compaction_report": lambda f: _all(_n(f.sig, "before"), _n(R.surviving(f.sig.drop("event_id"), f.buckets, f.mid), "after"), _n(f.buckets, "buckets"), _n(f.fix.filter(F.col("event_ts") < f.mid), "fixes_dropped")),
    "r5_stitched": lambda f: _rolled(R.stitched(R.surviving(f.sig.drop("event_id"), f.buckets, f.mid), f.buckets)),
    "m1_percentiles": lambda f: percentiles(f.spark.read.parquet(f"{f.sf_dir}/events.parquet"), "value"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q(Fleet(spark, sf_dir))) for name, q in QUERIES.items()}
