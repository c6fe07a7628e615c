"""The keyed detector against the batch form: any order, repeats, late fixes, restarts from its checkpoint."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill import schemas
from waybill.operators import geofence as G
from waybill.streaming import detector as D

START = dt.datetime(2024, 1, 1)
FIX = "vehicle_id string, event_ts timestamp_ntz, lat double, lon double, accuracy_m double"
# Distances in metres of a track, one a minute.
TRACK = [2000, 2000, 1400, 960, 900, 1010, 990, 1005, 300, 250, 1400, 2200, 2600]
rng = random.Random(6)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_fold_is_the_batch_rule():
    assert D.fold([(0, "OUT", False), (1, "OUT", False), (2, "IN", False), (3, "IN", False)], (None, None, None, 1, 0))[0] == [(2, "ENTRY", "high")]
    assert D.fold([(0, "OUT", True), (9_000_000_000, "IN", True)], (None, None, None, 1, 0))[0] == [(9_000_000_000, "ENTRY", "low")]
    assert D.fold([(0, "IN", False)], (None, None, None, 1, 0)) == ([], ("IN", 0, None, 1, 0))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, D.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def test_stream_equals_batch(rocks, tmp_path):
    """Shuffled fixes of two vehicles in three runs of one checkpoint, with repeats, bad fixes, a long gap and a late fix at the end."""
    spark = rocks
    fences = spark.createDataFrame([(f"f{i}", f"F{i}", 12.97, 77.6, r, dt.datetime(2000, 1, 1), None, dt.datetime(2000, 1, 1)) for i, r in enumerate((1000.0, 200.0))], schemas.FENCE)
    roster = spark.createDataFrame([("v1",), ("v2",)], "vehicle_id string")
    fixes = [(v, START + dt.timedelta(minutes=i + (60 if i > 10 else 0)), 12.97 + d / 111320, 77.6, 150.0 if i == 5 else 5.0) for v in ("v1", "v2") for i, d in enumerate(TRACK)]
    rng.shuffle(fixes)
    late = ("v1", START + dt.timedelta(minutes=6.5), 12.97 + 1400 / 111320, 77.6, 5.0)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, part in enumerate([fixes[:12], fixes[10:], [late, fixes[0]]]):
        spark.createDataFrame(part, FIX).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(source)
        found = D.detect(stream, fences, roster)
        found.writeStream.foreachBatch(lambda df, b, i=i: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        read = spark.read.schema(D.OUT).parquet(out)
        seen = spark.read.schema(FIX).parquet(source).distinct()
        votes = G.derive(seen, fences, G.full_scope(roster))
        assert rows(D.crossings(read)) == rows(G.transitions(votes))
        assert rows(D.containment(read)) == rows(G.containment(votes))
    assert [r.kind for r in D.crossings(read).filter("vehicle_id = 'v1' and geofence_id = 'f0'").orderBy("event_ts").collect()] == ["ENTRY", "EXIT", "ENTRY", "EXIT"]
    assert read.agg(F.max("revision")).first()[0] > 0


def test_packed_rows_hold_every_vote():
    """Interleaved votes of six pairs: each comes back once, in few rows, none of which is long."""
    votes = [(f"v{i % 3}", f"f{i % 2}", START + dt.timedelta(microseconds=7_919_000_001 * i - 10**15), i % 4) for i in range(20_000)]
    columns = [pa.array(c, t) for c, t in zip(zip(*votes, strict=True), (pa.string(), pa.string(), pa.timestamp("us"), pa.int32()), strict=True)]
    table = pa.Table.from_arrays(columns, names=["vehicle_id", "geofence_id", "event_ts", "code"])
    found = pa.Table.from_batches(D.packed(iter(table.to_batches(max_chunksize=700)))).to_pylist()
    back = [(r["vehicle_id"], r["geofence_id"], dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(v) >> 2), int(v) & 3) for r in found for v in np.frombuffer(r["votes"], np.int64)]
    assert sorted(back) == sorted(votes)
    assert len(found) < len(votes) / 500 and max(len(r["votes"]) for r in found) <= 8 * D.A_ROW


def test_turning_votes_are_enough():
    """Folding the first, second and last vote of each stretch gives what folding all gives, from any state."""
    tell = lambda votes: [(v >> 2, "IN" if v & 2 else "OUT", bool(v & 1)) for v in votes.tolist()]
    for _ in range(300):
        zones = [z for z in rng.choices((0, 2), k=12) for _ in range(rng.randint(1, 5))]
        votes = np.array([(i * rng.choice((1, 1_000_000_000)) << 2) + z + (rng.random() < 0.2) for i, z in enumerate(zones)])
        head = rng.choice([(None, None, None, 1, 0), ("IN", -5, "OUT", 1, 0), ("OUT", -5, "OUT", 1, 0)])
        assert D.fold(tell(votes[D.turning(np.zeros(len(votes)), votes)]), head) == D.fold(tell(votes), head)


@pytest.mark.parametrize("part", [D.A_PART, 50])
def test_long_history_is_few_entries(rocks, tmp_path, part):
    """A week of two vehicles, some late by hours, with repeats: the batch form's tables, and a state that has few entries, not one a vote."""
    spark = rocks
    fences = spark.createDataFrame([(f"f{i}", f"F{i}", 12.97, 77.6, r, dt.datetime(2000, 1, 1), None, dt.datetime(2000, 1, 1)) for i, r in enumerate((1000.0, 200.0))], schemas.FENCE)
    roster = spark.createDataFrame([("v1",), ("v2",)], "vehicle_id string")
    fixes = [(v, START + dt.timedelta(seconds=200 * i), 12.97 + rng.uniform(0, 1600) / 111320, 77.6, rng.choice((5.0, 60.0, 150.0))) for v in ("v1", "v2") for i in range(2800)]
    fixes = sorted(fixes, key=lambda x: x[1] + dt.timedelta(hours=rng.choice((0, 0, 0, 5))))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for some in (fixes[:3000], fixes[2900:4500], fixes[4500:]):
        spark.createDataFrame(some, FIX).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FIX).parquet(source)
        D.detect(stream, fences, roster, part).writeStream.foreachBatch(lambda df, b: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(D.OUT).parquet(out)
    votes = G.derive(spark.createDataFrame(fixes, FIX), fences, G.full_scope(roster))
    assert rows(D.crossings(read)) == rows(G.transitions(votes))
    assert rows(D.containment(read)) == rows(G.containment(votes))
    assert read.agg(F.max("revision")).first()[0] > 0
    entries = spark.read.format("statestore").option("stateVarName", "votes").load(check).count()
    assert entries <= 20 if part == D.A_PART else 20 < entries < 400
