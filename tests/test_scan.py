"""Scans by slices, the fence grid and the sparse votes against plain forms; the shape of plans."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from waybill import schemas
from waybill.functions.lineage import cut
from waybill.operators import alerts as A
from waybill.operators import geofence as G
from waybill.operators import grid
from waybill.operators import ingest as I
from waybill.operators.asof import as_of
from waybill.operators.scan import neighbours, running_sum
from waybill.plans import fleet

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
FIX = "vehicle_id string, event_ts timestamp_ntz, lat double, lon double, accuracy_m double"
SIG = "vehicle_id string, signal string, event_ts timestamp_ntz, value double"
rng = random.Random(8)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def world(spark):
    """Two vehicles that wander around twelve fences, some switched on or off half-way, one around all the others."""
    track = []
    for v in ("v1", "v2"):
        x, y = 0.0, 0.0
        for i in range(250):
            x, y = x + rng.gauss(0, 900), y + rng.gauss(0, 900)
            if rng.random() < 0.1:
                x, y = 0.0, 0.0
            track.append((v, at(60 * i + rng.randrange(50)), 12.97 + y / 111_195, 77.60 + x / 108_000, rng.choice([None, 5.0, 40.0, 90.0, 150.0])))
    fences = []
    for i in range(12):
        off, on = (at(9000) if i % 4 == 1 else None), (at(4000) if i % 4 == 2 else at(-10**6))
        fences.append((f"f{i}", f"F{i}", 12.97 + rng.gauss(0, 0.02), 77.60 + rng.gauss(0, 0.02), rng.choice([60.0, 300.0, 1500.0, 4000.0]), on, off, at(0)))
    fences.append(("wide", "W", 12.9, 77.5, 150_000.0, at(-10), None, at(0)))
    fences.append(("polar", "P", 89.5, 10.0, 200_000.0, at(-10), None, at(0)))
    f = cut(spark.createDataFrame(track, FIX))
    return f, cut(spark.createDataFrame(fences, schemas.FENCE)), cut(f.select("vehicle_id").distinct())


@pytest.mark.parametrize("seconds", [300, 10**6])
def test_sparse_votes_give_the_dense_tables(spark, world, seconds):
    """Near fixes and two far votes a gap give the crossings and states of a vote for every fix and fence, over many slices and one, whole and resumed."""
    fixes, fences, roster = world
    scope = G.full_scope(roster)
    dense, sparse = G.each_vote(fixes, fences, scope), G.derive(fixes, fences, scope, seconds=seconds)
    assert rows(G.transitions(sparse)) == rows(G.transitions(dense)) and rows(G.containment(sparse)) == rows(G.containment(dense))
    assert G.transitions(dense).count() > 30
    early = fixes.filter(F.col("event_ts") < F.lit(str(at(6000))).cast("timestamp_ntz"))
    state = cut(G.containment(G.each_vote(early, fences, scope)))
    later = G.batch_scope(fixes.filter(F.col("event_ts") >= F.lit(str(at(6000))).cast("timestamp_ntz")), I.advance_watermark(spark.createDataFrame([], "vehicle_id string, processed_through timestamp_ntz"), early, early))
    shut = fences.withColumn("active_from", F.when(F.col("geofence_id") == "f3", F.lit(str(at(8000))).cast("timestamp_ntz")).otherwise(F.col("active_from")))  # switched on again within the window
    for set_ in (fences, shut):
        dense, sparse = G.each_vote(fixes, set_, later, state), G.derive(fixes, set_, later, state, seconds)
        assert rows(G.transitions(sparse)) == rows(G.transitions(dense)) and rows(G.containment(sparse)) == rows(G.containment(dense))


def test_dense_votes_by_slices(world):
    fixes, fences, roster = world
    scope = G.full_scope(roster)
    assert rows(G.each_vote(fixes, fences, scope, seconds=200)) == rows(G.each_vote(fixes, fences, scope, seconds=10**7))


def test_grid_finds_every_near_fence(spark):
    """Against all pairs, around the date line and the poles as well."""
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(rng.uniform(84, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.uniform(-3, 3), s * rng.uniform(178, 180)) for s in (1, -1) for _ in range(60)]
    fences = spark.createDataFrame([(f"g{i}", lat, lon, rng.choice([1.0, 500.0, 20_000.0, 200_000.0]), at(0), None) for i, (lat, lon) in enumerate(spots)], "geofence_id string, lat double, lon double, radius_m double, active_from timestamp_ntz, active_to timestamp_ntz")
    near_by = [(lat + rng.gauss(0, 0.5), lon + rng.gauss(0, 0.5)) for lat, lon in spots]
    fixes = spark.createDataFrame([(f"v{i}", at(1), max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for i, (lat, lon) in enumerate(near_by)], "vehicle_id string, event_ts timestamp_ntz, lat double, lon double")
    f, p = fences.collect(), fixes.collect()

    def metres(a, b):
        h = math.sin(math.radians(a.lat - b.lat) / 2) ** 2 + math.cos(math.radians(b.lat)) * math.cos(math.radians(a.lat)) * math.sin(math.radians(a.lon - b.lon) / 2) ** 2
        return 2 * schemas.EARTH_M * math.asin(math.sqrt(h))

    expected = {(a.vehicle_id, b.geofence_id) for a in p for b in f if metres(a, b) <= b.radius_m + grid.CLEAR_M}
    found = [tuple(r) for r in grid.near(fixes, fences).select("vehicle_id", "geofence_id").collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 100
    assert grid.filed(fences.filter("abs(lat) < 80")).groupBy("geofence_id").count().agg(F.max("count")).first()[0] <= 9


def test_as_of_over_many_slices(spark):
    readings = [(rng.choice("ab"), at(rng.randrange(10_000)), float(i)) for i in range(300)]
    readings = list({(k, t): (k, t, v) for k, t, v in readings}.values())
    probes = [(rng.choice("abc"), at(rng.randrange(-100, 11_000)), None if rng.random() < 0.1 else at(rng.randrange(11_000))) for _ in range(200)]
    r = spark.createDataFrame(readings, "k string, event_ts timestamp_ntz, value double")
    p = spark.createDataFrame(probes, "k string, x timestamp_ntz, y timestamp_ntz").distinct()
    last = lambda k, t: max(((s, v) for q, s, v in readings if q == k and (t is None or s <= t)), default=None)
    expected = sorted(((k, x, y, last(k, x), last(k, y)) for k, x, y in set(probes)), key=repr)
    for seconds in (60, 3000, 10**8):
        got = as_of(p, r, "k", ["x", "y"], ["rx", "ry"], seconds).collect()
        assert sorted(((g.k, g.x, g.y, g.rx and tuple(g.rx), g.ry and tuple(g.ry)) for g in got), key=repr) == expected


def test_no_window_is_longer_than_a_slice(spark):
    """One vehicle of 20,000 readings in an hour-wise scan: sums and neighbours are those of one pass, and each slice is short."""
    log = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") * 0).alias("k"), (F.expr("TIMESTAMP_NTZ'2024-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 30)).alias("event_ts"), (F.col("id") % 7).alias("x"))
    got = running_sum(log, ["k"], "event_ts", F.col("x"), "s", 3600).orderBy("event_ts").collect()
    total = 0
    for r in got:
        total += r.x
        assert r.s == total
    both = neighbours(log, ["k"], "event_ts", 3600).orderBy("event_ts").collect()
    assert all(b.prev_ts == a.event_ts and a.next_ts == b.event_ts for a, b in zip(both, both[1:], strict=False)) and both[0].prev_ts is None is both[-1].next_ts
    plan = running_sum(log, ["k"], "event_ts", F.col("x"), "s", 3600)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and all("slice_" in line for line in plan.splitlines() if "Window [" in line)


def test_episodes_by_slices(spark):
    log = cut(spark.createDataFrame([(v, "soc", at(97 * i), float(rng.choice([5, 8, 15, 19, 21, 25, 60]))) for v in ("v1", "v2") for i in range(150)], SIG))
    spec, kinds = schemas.signal_spec(spark), schemas.alert_signals(spark)
    whole = rows(A.episodes(log, spec, kinds, 10**8))
    assert rows(A.episodes(log, spec, kinds, 100)) == rows(A.episodes(log, spec, kinds, 2000)) == whole and len(whole) > 20


@pytest.mark.parametrize("name", ["g4_probes", "g5_opinions", "g11_transitions", "t8_trips", "g15_occupancy"])
def test_fences_join_without_a_nested_loop(spark, name, monkeypatch):
    """Plans of all jobs of a query, those that write shared tables included, with 10,000 fences."""
    n = 10_000
    many = spark.range(n).selectExpr("concat('g', id) geofence_id", "concat('G', id) name", "12.9 + id / 1e5 lat", "77.5 + id / 1e5 lon", "100.0D radius_m", "TIMESTAMP_NTZ'2000-01-01' active_from", "CAST(NULL AS TIMESTAMP_NTZ) active_to", "TIMESTAMP_NTZ'2000-01-01' updated_at")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.limit(0)

    for module in ("waybill.operators.geofence.cut", "waybill.operators.trips.cut"):
        monkeypatch.setattr(module, seen)
    monkeypatch.setattr(schemas, "seed_fences", lambda spark: many)
    plans.append(fleet.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert not any(x in p for p in plans for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
