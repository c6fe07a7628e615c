"""Hand-written cases of the operators, and the shape of the plans that matter at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waybill import schemas
from waybill.operators import alerts as A
from waybill.operators import geofence as G
from waybill.operators import ingest as I
from waybill.operators import retention as R
from waybill.operators import status as S
from waybill.operators import trips as T

T0 = dt.datetime(2024, 1, 1)
m = lambda minutes: T0 + dt.timedelta(minutes=minutes)
SIG = "vehicle_id string, signal string, event_ts timestamp_ntz, value double"
FIX = "vehicle_id string, event_ts timestamp_ntz, lat double, lon double, accuracy_m double"
NOW = lambda minutes: F.lit(str(m(minutes))).cast("timestamp_ntz")


def fence(spark, radii=(1000.0,)):
    rows = [(f"f{i}", f"F{i}", 12.97, 77.60, r, m(-10000), None, m(-10000)) for i, r in enumerate(radii)]
    return spark.createDataFrame(rows, schemas.FENCE)


def fixes(spark, track):
    """(minute, metres north of the centre[, accuracy])."""
    return spark.createDataFrame([("v1", m(t), 12.97 + d / 111320, 77.60, float(a[0]) if a else None) for t, d, *a in track], FIX)


def cross(spark, track, radii=(1000.0,)):
    f = fixes(spark, track)
    votes = G.derive(f, fence(spark, radii), G.full_scope(f.select("vehicle_id").distinct()))
    out = [(r.kind, int((r.event_ts - T0).total_seconds() // 60), r.confidence) for r in G.transitions(votes).orderBy("event_ts", "geofence_id").collect()]
    return out, {r.geofence_id: r for r in G.containment(votes).collect()}


# Tracks of a vehicle near a fence of 1000 m, and the crossings that they must give.
@pytest.mark.parametrize(
    "track, expected",
    [
        ([(0, 2000), (1, 2000)], []),
        ([(0, 2000), (1, 2000), (2, 500), (3, 400)], [("ENTRY", 2, "high")]),
        ([(0, 2000), (1, 2000), (2, 100)], [("ENTRY", 2, "high")]),
        ([(0, 2000), (1, 2000), *((t, 990 if t % 2 else 1010) for t in range(2, 12))], []),
        ([(0, 2000), (1, 2000), (2, 300, 200), (3, 300, 200)], []),
        ([(0, 2000), (1, 2000), (2, 960, 60), (3, 960, 60)], []),
        ([(0, 2000), (1, 2000), (2, 960), (45, 960)], [("ENTRY", 2, "low")]),
    ],
)
def test_crossings(spark, track, expected):
    assert cross(spark, track)[0] == expected


def test_one_near_fix_only_waits(spark):
    state = cross(spark, [(0, 1040)])[1]["f0"]
    assert (state.zone, state.pending_zone) == (None, "OUT")


def test_nested_fences_both_cross(spark):
    assert cross(spark, [(0, 2000), (1, 2000), (2, 50), (3, 50)], (1000.0, 200.0))[0] == [("ENTRY", 2, "high")] * 2


def trip_rows(spark, moves, inside=()):
    fences = schemas.seed_fences(spark)
    trans = spark.createDataFrame([("v1", g, m(t), k, "high") for t, k, g in moves], "vehicle_id string, geofence_id string, event_ts timestamp_ntz, kind string, confidence string")
    cont = spark.createDataFrame([("v1", g, "IN", "IN", m(0)) for g in inside], schemas.CONTAINMENT)
    scope = G.full_scope(spark.createDataFrame([("v1",)], "vehicle_id string"))
    return T.derive(trans, cont, fences, spark.createDataFrame([], SIG), scope).collect()


def test_open_and_closed_trips(spark):
    (one,) = trip_rows(spark, [(10, "EXIT", "gf-depot")])
    assert (one.status, one.origin_geofence_id, one.distance_km) == ("IN_PROGRESS", "gf-depot", None)
    (two,) = trip_rows(spark, [(10, "EXIT", "gf-depot"), (40, "ENTRY", "gf-ecity")], ["gf-ecity"])
    assert (two.status, two.dest_geofence_id) == ("COMPLETED", "gf-ecity")
    assert trip_rows(spark, [(10, "EXIT", "gf-bay3")], ["gf-depot"]) == []
    (both,) = trip_rows(spark, [(10, "EXIT", "gf-bay3"), (10, "EXIT", "gf-depot")])
    assert both.origin_geofence_id == "gf-depot"


def test_status_ladder(spark):
    rows = [("v1", "speed", m(0), 42.0), ("v2", "speed", m(0), 0.0), ("v2", "ignition", m(0), 1.0), ("v3", "speed", m(0), 0.0), ("v3", "ignition", m(0), 0.0), ("v4", "speed", m(-30), 9.0), ("v5", "speed", m(0), 17.0)]
    roster = spark.createDataFrame([(f"v{i}", f"R{i}", "x") for i in range(1, 6)], "vehicle_id string, reg_no string, model string")
    none = spark.createDataFrame([], "vehicle_id string, severity string, resolved_at timestamp_ntz, dismissed_at timestamp_ntz")
    fleet = S.scored(roster, spark.createDataFrame(rows, SIG), spark.createDataFrame([], FIX), none, NOW(1))
    assert {r.status: r.n for r in S.status_counts(fleet).collect()} == {"MOVING": 2, "IDLE": 1, "STOPPED": 1, "OFFLINE": 1, "ALL": 5}


def test_alert_lifecycle(spark):
    spec = schemas.signal_spec(spark)
    alerts = spark.createDataFrame([], "alert_id string, vehicle_id string, alert_type string, severity string, raised_at timestamp_ntz, escalated_at timestamp_ntz, resolved_at timestamp_ntz, dismissed_at timestamp_ntz, dismiss_reason string")

    def step(alerts, minute, soc):
        latest = spark.createDataFrame([("v1", "soc", m(minute), soc)], SIG)
        return spark.createDataFrame(A.evaluate(alerts, A.conditions(latest, spec, NOW(minute)), NOW(minute)).collect(), alerts.schema)

    seen = []
    for minute, soc in ((0, 18.0), (1, 8.0), (2, 21.0), (3, 15.0), (4, 80.0), (5, 9.0)):
        alerts = step(alerts, minute, soc)
        seen.append(sorted((r.severity, r.resolved_at is not None) for r in alerts.collect()))
    assert seen == [[("warning", False)], [("critical", False)], [("critical", False)], [("warning", False)], [("warning", True)], [("critical", False), ("warning", True)]]
    assert step(alerts, 6, 9.0).count() == 2  # again: no change


def test_late_and_repeated_readings(spark):
    old = spark.createDataFrame([("v1", "soc", m(5), 40.0)], SIG)
    assert [r.value for r in I.advance_latest(old, spark.createDataFrame([("v1", "soc", m(1), 99.0), ("v1", "soc", m(5), 7.0)], SIG)).collect()] == [40.0]
    three = spark.createDataFrame([("v1", "soc", m(0), 3.0), ("v1", "soc", m(0), 2.0), ("v1", "soc", m(0), 2.0)], SIG)
    assert [(r.value, r.conflicts) for r in I.dedupe(three).collect()] == [(2.0, 1)]
    assert I.append_absent(three, three, I.KEY).count() == 0


def test_roll_up_merges_late_rows(spark):
    log = spark.createDataFrame([("v1", "soc", m(0), 40.0), ("v1", "soc", m(2), 80.0), ("v1", "soc", m(4), 60.0), ("v2", "soc", m(0), 1.0)], SIG)
    rolled = R.roll_up(log, NOW(60))
    row = rolled.first()
    assert (row.readings, row.min_value, row.max_value, row.avg_value, row.last_value) == (3, 40.0, 80.0, 60.0, 60.0)
    assert R.surviving(log, rolled, NOW(60)).count() == 1
    late = R.roll_up(spark.createDataFrame([("v1", "soc", m(1), 10.0), ("v1", "soc", m(3), 10.0)], SIG), NOW(60))
    both = R.merge_roll_ups(rolled, late).first()
    assert (both.readings, both.avg_value, both.last_value) == (5, 40.0, 60.0)


