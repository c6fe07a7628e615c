"""The stream against the batch functions: any order, repeats, late fixes, a batch that runs twice, and retention."""

import datetime as dt
import json
import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from waybill import schemas
from waybill.operators import geofence as G
from waybill.operators import ingest as I
from waybill.operators import retention as R
from waybill.operators import trips as T
from waybill.sources.readers import packet_fixes, packet_signals, read_packets, stream_packets
from waybill.streaming.pipeline import FleetStream, open_store

# Distances in metres of a track, one a minute, and the crossings expected of it.
TRACK = [2000, 2000, 1400, 960, 900, 1010, 990, 1005, 300, 250, 1400, 2200, 2600]
EXPECTED = ["ENTRY", "EXIT"]
LATE_AT, LATE_M, EXPECTED_LATE = 6.5, 1400, ["ENTRY", "EXIT", "ENTRY", "EXIT"]
START = dt.datetime(2024, 1, 1)
ROSTER = "vehicle_id string, reg_no string, model string"


def packet(vehicle, minute, d, i):
    ts = (START + dt.timedelta(minutes=minute)).isoformat()
    return {"vehicle_id": vehicle, "event_ts": ts, "signals": {"soc": 30.0 - 2 * i, "odometer": 100.0 + i}, "location": {"lat": 12.97 + d / 111320, "lon": 77.6, "accuracy_m": 5.0}}


def packets(*vehicles):
    return [packet(v, i, d, i) for i, d in enumerate(TRACK) for v in vehicles]


def parsed(spark, sent):
    return spark.read.schema(schemas.PACKET).json(spark.sparkContext.parallelize(list(map(json.dumps, sent))))


@pytest.fixture
def world(spark, tmp_path):
    roster = spark.createDataFrame([("v1", "R1", "x"), ("v2", "R2", "x")], ROSTER)
    fences = spark.createDataFrame([("f0", "F0", 12.97, 77.6, 1000.0, dt.datetime(2000, 1, 1), None, dt.datetime(2000, 1, 1))], schemas.FENCE)
    (tmp_path / "in").mkdir()

    def feed(stream, parts, done=0):
        for i, part in enumerate(parts, done):
            (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
            stream.start(stream_packets(spark, str(tmp_path / "in"), 1), str(tmp_path / "check")).awaitTermination()

    new = lambda name="state": FleetStream(open_store(spark, str(tmp_path / name), buckets=4), roster, fences, "2024-01-01 00:12:00")
    return new, feed, roster, fences, str(tmp_path / "in")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def state_of(stream):
    s = stream.store
    return {t: rows(s.log(t)) for t in ("signal_reading", "location_fix")} | {t: rows(s.read(t)) for t in ("latest", "last_fix", "watermark", "transition", "containment", "alert", "trip", "odometer")}


def test_any_order_gives_the_batch_state(spark, world):
    """Log, fixes, latest, watermark, crossings, containment and trips equal the batch functions' for shuffled, repeated packets."""
    new, feed, roster, fences, folder = world
    sent = packets("v1", "v2")
    rng = random.Random(4)
    mixed = sent[::-1] + sent[::3]
    rng.shuffle(mixed)
    stream = new()
    feed(stream, [mixed[i : i + 18] for i in range(0, len(mixed), 18)])
    read = read_packets(spark, folder)
    signals, fixes = packet_signals(read).distinct(), packet_fixes(read).distinct()
    votes = G.derive(fixes, fences, G.full_scope(roster))
    crossings, inside = G.transitions(votes), G.containment(votes)
    none = spark.createDataFrame([], "vehicle_id string, processed_through timestamp_ntz")
    got = state_of(stream)
    assert got["signal_reading"] == rows(signals) and got["location_fix"] == rows(fixes)
    assert got["latest"] == rows(I.newest(signals)) and got["watermark"] == rows(I.advance_watermark(none, signals, fixes))
    assert got["transition"] == rows(crossings) and got["containment"] == rows(inside)
    assert got["trip"] == rows(T.derive(crossings, inside, fences, signals, G.full_scope(roster)))
    alerts = {(r.vehicle_id, r.alert_type, r.severity, r.raised_at, r.resolved_at) for r in stream.store.read("alert").collect()}
    assert alerts == {(v, "battery_low", "critical", START + dt.timedelta(minutes=12), None) for v in ("v1", "v2")}
    stream.rebuild()
    again = state_of(stream)
    assert {t: again[t] for t in again if t != "alert"} == {t: got[t] for t in got if t != "alert"}
    assert {(r.vehicle_id, r.alert_type, r.severity, r.resolved_at) for r in stream.store.read("alert").collect()} == {(v, k, s, x) for v, k, s, _, x in alerts}
    receipt = stream.store.log("receipt").agg(*(F.sum(c).alias(c) for c in ("packets", "offered", "applied", "duplicates", "late"))).first()
    assert (receipt.packets, receipt.applied) == (len(mixed), 3 * len(sent)) and receipt.offered - receipt.applied == receipt.duplicates > 0 and receipt.late > 0


def test_fix_by_fix_and_late_fix(spark, world):
    """Fixes that go on from kept state equal a whole replay; a late fix replays its vehicle."""
    new, feed, roster, fences, folder = world
    stream = new()
    sent = packets("v1")
    parts = [sent[:9], sent[9:10], sent[10:]]
    feed(stream, parts)
    kinds = lambda: [r.kind for r in stream.store.read("transition").orderBy("event_ts").collect()]
    assert kinds() == EXPECTED
    votes = G.derive(stream.store.log("location_fix"), fences, G.full_scope(roster))
    assert rows(stream.store.read("containment")) == rows(G.containment(votes)) and rows(stream.store.read("transition")) == rows(G.transitions(votes))
    feed(stream, [[packet("v1", LATE_AT, LATE_M, 6)]], len(parts))
    assert kinds() == EXPECTED_LATE


def test_a_batch_that_fails_is_made_good(spark, world, monkeypatch):
    """A batch that stops between two tables, and one that stops in a commit (files without the committer's mark, as a lost driver leaves them), loses nothing and is whole when it runs again."""
    new, *_ = world
    whole, broken = new("whole"), new("broken")
    sent = packets("v1", "v2")
    parts = [parsed(spark, sent[:12]), parsed(spark, sent[12:])]
    whole.apply(parts[0], 0)
    before = state_of(whole)
    shutil.copytree(whole.store.root, broken.store.root)
    whole.apply(parts[1], 1)
    after = state_of(whole)
    replace = broken.store.replace

    def failing(table, df, touched, batch):
        replace(table, df, touched, batch)
        if table == "containment":
            raise RuntimeError("lost")

    monkeypatch.setattr(broken.store, "replace", failing)
    with pytest.raises(RuntimeError):
        broken.apply(parts[1], 1)
    monkeypatch.undo()
    folder = pathlib.Path(broken.store.root) / "containment" / f"version={1 << 20}"
    (folder / "_SUCCESS").unlink()
    next(folder.rglob("part-*")).unlink()
    now = state_of(broken)
    assert now["containment"] == before["containment"] and now["trip"] == before["trip"] and now["watermark"] == before["watermark"]
    broken.apply(parts[1], 1)
    assert state_of(broken) == after


def test_retention_in_the_stream(spark, world):
    """Roll-ups and what is left tell the same history as the log did; a second run of the same number changes nothing."""
    new, feed, *_ = world
    stream = new()
    feed(stream, [packets("v1", "v2")])
    log = stream.store.log("signal_reading")
    empty = R.roll_up(log, F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"))
    expected = rows(R.stitched(log, empty))
    horizon = F.expr("TIMESTAMP_NTZ'2024-01-01 00:10:00'")
    for _ in range(2):
        stream.compact(horizon, 1)
        assert rows(stream.history()) == expected
        assert stream.store.log("signal_reading").count() < 52 and stream.store.log("location_fix").filter(F.col("event_ts") < horizon).count() == 0
    feed(stream, [[packet("v1", 1.5, 2000, 1), packet("v1", 1.7, 2000, 1)]], 1)
    assert stream.history().agg(F.sum("readings")).first()[0] == 52 + 4
    stream.compact(horizon, 2)
    assert stream.history().agg(F.sum("readings")).first()[0] == 52 + 4


def test_log_is_pruned_by_date_and_compacted(spark, world):
    stream = world[0]()
    s = stream.store
    for i in range(4):
        s.append("signal_reading", packet_signals(parsed(spark, [packet(v, 1440 * (i % 2) + i, 2000, i) for v in ("v1", "v2")])), i)
        s.append("location_fix", packet_fixes(parsed(spark, [packet("v1", 1440 * (i % 2) + i, 2000, i)])), i)
    one_day = s.log("signal_reading", parts=True).filter("event_date = DATE'2024-01-02' and signal = 'soc'")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan(one_day) and one_day.count() == 4
    batch = spark.createDataFrame([("v1", "soc", START + dt.timedelta(days=1), 1.0)], "vehicle_id string, signal string, event_ts timestamp_ntz, value double")
    dynamic = I.append_absent(batch, s.log("signal_reading", parts=True), I.KEY)
    assert "event_date" in plan(dynamic).split("PartitionFilters: [")[1].split("DataFilters")[0] and dynamic.count() == 1
    before = rows(s.log("signal_reading"))
    files = lambda: s.log("signal_reading", parts=True).select("event_date", "bucket", F.input_file_name().alias("f")).distinct().groupBy("event_date", "bucket").count().agg(F.max("count")).first()[0]
    assert files() == 2
    horizon = F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'")
    stream.compact(horizon, 1)
    assert files() == 1 and rows(s.log("signal_reading")) == before and len(s.versions("signal_reading")) == 1
    stream.compact(horizon, 2)
    s.append("signal_reading", packet_signals(parsed(spark, [packet("v1", 7, 2000, 1)])), 4)
    assert len(rows(s.log("signal_reading"))) == len(before) + 2 and rows(s.log("signal_reading", before=4)) == before
    for i in range(5):
        s.replace("latest", s.log("signal_reading"), [0, 1], i)
    s.replace("latest", s.log("signal_reading"), [0], 5)
    s.vacuum(6)
    assert s.versions("latest") == [5 << 20, 4 << 20] and s.versions("latest", 5 << 20) == [4 << 20]


def test_too_old_packets_are_rejected_and_counted(spark, world):
    _, _, roster, fences, _ = world
    store = open_store(spark, str(world[4]) + "-reject", buckets=4)
    stream = FleetStream(store, roster, fences, keep_sec=3600)
    stream.apply(parsed(spark, [packet("v1", 100, 2000, 1), packet("v2", 10, 2000, 1), packet("v2", 40, 2000, 2)]), 0)
    stream.apply(parsed(spark, [packet("v1", 30, 2000, 1), packet("v1", 101, 2000, 1)]), 1)
    got = [(r.packets, r.rejected, r.offered, r.applied, r.late) for r in store.log("receipt", parts=True).orderBy("version").collect()]
    assert got == [(3, 1, 6, 6, 0), (2, 1, 3, 3, 0)]
    assert sorted((r.vehicle_id, json.loads(r.packet)["signals"]["odometer"]) for r in store.log("rejected").collect()) == [("v1", 101.0), ("v2", 101.0)]
    assert store.log("location_fix").count() == 3
    before = state_of(stream)
    stream.apply(parsed(spark, []), 2)  # an empty batch changes nothing
    stream.apply(parsed(spark, [packet("v1", 101, 2000, 1) | {"signals": {}, "location": None}, packet("ghost", 101, 2000, 1) | {"location": None}]), 3)  # no known rows at all
    assert state_of(stream) == before
    got = [(r.packets, r.rejected, r.orphans, r.offered, r.applied, r.late) for r in store.log("receipt", parts=True).orderBy("version").collect()]
    assert got[2:] == [(0, 0, 0, 0, 0, 0), (2, 0, 2, 0, 0, 0)]


def test_first_filter(spark, world, tmp_path, monkeypatch):
    """Repeats within the window never reach a batch; a late packet goes through.  (Repeats that do reach one change nothing: the any-order test.)"""
    stream, reached = world[0](), []
    monkeypatch.setattr(stream, "apply", lambda df, i: reached.append(df.count()))
    (tmp_path / "f").mkdir()
    sent = packets("v1")
    for i, part in enumerate([sent[3:6] + sent[3:5], sent[4:8] + sent[0:1]]):
        (tmp_path / "f" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        stream.start(stream_packets(spark, str(tmp_path / "f"), 1), str(tmp_path / "c"), first_filter="1 hour").awaitTermination()
    assert [n for n in reached if n] == [3, 3]


def test_dismissals_fences_and_the_list_over_the_store(spark, world):
    new, _, roster, fences, _ = world
    stream = new()
    stream.apply(parsed(spark, packets("v1", "v2")), 0)
    (one, *_) = stream.store.read("alert").filter("vehicle_id = 'v1'").collect()
    stream.dismiss(spark.createDataFrame([(one.alert_id, START, "known", "seen", False)], "alert_id string, at timestamp_ntz, code string, note string, undo boolean"))
    assert {r.vehicle_id: r.dismiss_reason for r in stream.store.read("alert").collect()} == {"v1": "known: seen", "v2": None}
    listed = stream.fleet_list(F.lit("2024-01-01 00:12:00").cast("timestamp_ntz"))
    assert {r.vehicle_id: (r.status, r.alert_severity) for r in listed.collect()} == {"v1": ("STOPPED", None), "v2": ("STOPPED", "critical")}
    assert "signal_reading" not in listed._jdf.queryExecution().toString() and "location_fix" not in listed._jdf.queryExecution().toString()
    wide = fences.withColumn("radius_m", F.lit(50_000.0))
    stream.edit_fences(wide)
    votes = G.derive(stream.store.log("location_fix"), wide, G.full_scope(roster))
    assert rows(stream.store.read("transition")) == rows(G.transitions(votes)) == [] and {r.zone for r in stream.store.read("containment").collect()} == {"IN"}
    stream.rebuild()
    assert {r.vehicle_id: r.dismiss_reason for r in stream.store.read("alert").collect()} == {"v1": "known: seen", "v2": None}


def test_distances_from_kept_readings(spark, world, monkeypatch):
    """A batch reads the odometer of its new instants' days alone, and trips keep their distances once old readings are rolled up."""
    new, _, roster, fences, _ = world
    stream, asked = new(), []
    days = stream.store.days
    monkeypatch.setattr(stream.store, "days", lambda rows, at: asked.append(days(rows, at)) or asked[-1])
    far = 3 * 1440
    away = [packet("v1", far + i, d, 50 + i) for i, d in enumerate([300, 250, 1400, 2200, 2600])]
    for i, part in enumerate([packets("v1", "v2"), away[:2], away[2:], [packet("v1", far + 5, 2700, 60)]]):
        stream.apply(parsed(spark, part), i)
    first, later = START.date(), (START + dt.timedelta(days=3)).date()
    assert asked[0] == [first] and first not in asked[1] and asked[2:] == [[later], []]
    reading = stream._readings(spark.createDataFrame([("v1", START + dt.timedelta(days=3))], "vehicle_id string, at timestamp_ntz"), 4, [0, 1, 2, 3])
    assert "event_date" in reading._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("DataFilters")[0]
    signals, fixes = stream.store.log("signal_reading"), stream.store.log("location_fix")
    votes = G.derive(fixes, fences, G.full_scope(roster))
    expected = rows(T.derive(G.transitions(votes), G.containment(votes), fences, signals, G.full_scope(roster)))
    before = state_of(stream)
    assert before["trip"] == expected and sum(r.distance_km is not None for r in stream.store.read("trip").collect()) >= 3
    stream.rebuild()
    assert state_of(stream)["odometer"] == before["odometer"]
    # a reading that arrives late lies between an instant and what was known of it
    stream.apply(parsed(spark, [packet("v1", 9.5, 250, 9) | {"signals": {"odometer": 109.25}, "location": None}]), 4)
    log = stream.store.log("signal_reading")
    assert rows(stream.store.read("trip")) == rows(T.derive(G.transitions(votes), G.containment(votes), fences, log, G.full_scope(roster)))
    told = {r.trip_id: (r.start_ts, r.distance_km) for r in stream.store.read("trip").collect()}
    stream.compact(F.expr("TIMESTAMP_NTZ'2024-01-03 00:00:00'"), 4)
    stream.apply(parsed(spark, [packet("v1", far + 6, 2700, 70)]), 5)
    after = {r.trip_id: (r.start_ts, r.distance_km) for r in stream.store.read("trip").collect()}
    ended = {k: x for k, x in told.items() if x[0] < START + dt.timedelta(days=2)}
    assert ended and all(after[k] == x for k, x in ended.items())
