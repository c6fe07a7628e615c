"""The fence detector in its keyed form: one state a vehicle, kept by Spark's RocksDB state store.

The state is, for each fence, the last vote and the zone that stands, and the votes so far; once there are
some thousands of these, they are filed by time.
Votes after the last one are folded into the state; one from before it makes the pair's votes be folded
again from the first (a late fix replays its pair), and a repeated one is passed over.  So the tables that
follow equal the batch form's, whatever the order in which fixes arrive (tested), and a stream that is
stopped goes on from its checkpoint.

What a batch costs in the Python workers goes by vehicles, not by votes: tasks pack the votes of a pair into
binary rows before the shuffle, an entry of the state holds thousands of votes and a turn mostly reads and
writes one, of each stretch of equal votes only the first two and the last are folded one by one, and what a
turn tells leaves as binary rows too, from which tasks make rows of OUT.

Each turn of a pair gives its new crossings and one row of its state.  A replay gives all crossings of the
pair under a new ``revision``, which replaces the older ones; ``crossings()`` and ``containment()`` read
the rows that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waybill.operators import geofence
from waybill.schemas import GAP_SEC

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "vehicle_id string, geofence_id string, turn bigint, revision bigint, event_ts timestamp_ntz, kind string, confidence string, zone string, pending_zone string, pending_ts timestamp_ntz"

#: Votes in packed rows: 8 bytes each, microseconds times 4, plus 2 for IN, plus 1 if decisive.
PACKED = "vehicle_id string, geofence_id string, votes binary"
IN, DECISIVE = 2, 1
#: A task packs so many votes at once; a packed row holds so many at most.
AT_ONCE, A_ROW = 1 << 20, 1 << 10
#: Votes are filed when they are more than so many, by spans of 2^38 microseconds (three days) in parts of so many at most; the fence's place in the head stands above a vote's lower bits.
SPAN_BITS, A_PART = 40, 1 << 12
WITHIN = (1 << SPAN_BITS) - 1
#: What a turn tells: fives of numbers (place among ``fences``, turn, revision, microseconds, and these bits), so many a row.
TOLD = "vehicle_id string, fences array<string>, told binary"
CROSSED, ENTERS, SURE, STANDS, STANDS_IN = 1, 2, 4, 8, 16
A_TELL = 1 << 8
_TOLD = Row("vehicle_id", "fences", "told")

#: The state between votes: last vote (zone, microseconds), zone that stands, turns so far, turn of the last replay.
Head = tuple[str | None, int | None, str | None, int, int]
NO_HEAD: Head = (None, None, None, 0, 0)


def fold(votes: list[tuple[int, str, bool]], head: Head) -> tuple[list[tuple[int, str, str]], Head]:
    """(crossings, state) after ``votes`` (microseconds, zone, decisive) in order of time."""
    last, last_at, stands, turn, revision = head
    crossed = []
    for at, zone, decisive in votes:
        second = zone == last
        if second or decisive:
            if stands is not None and stands != zone:
                doubt = last_at is None or at - last_at > GAP_SEC * 1_000_000
                crossed.append((last_at if second else at, "ENTRY" if zone == "IN" else "EXIT", "low" if doubt else "high"))
            stands = zone
        last, last_at = zone, at
    return crossed, (last, last_at, stands, turn, revision)


def turning(pair: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Which of votes in order (by pair, then time) fold() has to see: the first, the second and the last of each stretch of equal zones."""
    first = np.ones(len(votes), dtype=bool)
    first[1:] = (pair[1:] != pair[:-1]) | ((votes[1:] ^ votes[:-1]) & IN != 0)
    kept = first.copy()
    kept[1:] |= first[:-1]
    kept[:-1] |= first[1:]
    kept[-1:] = True
    return kept


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes (vehicle_id, geofence_id, event_ts, code) as rows of PACKED, some AT_ONCE votes at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _pack(pa.Table.from_batches(held))


def _pack(table: pa.Table) -> pa.RecordBatch:
    vehicle, fence = (table.column(c).combine_chunks().dictionary_encode() for c in geofence.PAIR)
    pair = vehicle.indices.to_numpy().astype(np.int64) * len(fence.dictionary) + fence.indices.to_numpy()
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at, code = table.column("event_ts").cast(pa.int64()).to_numpy(), table.column("code").to_numpy()
    votes = (at * 4 + code)[order]
    place = np.arange(len(pair))
    begun = np.maximum.accumulate(np.where(np.r_[True, pair[1:] != pair[:-1]], place, 0))
    starts = np.flatnonzero((place - begun) % A_ROW == 0)
    offsets = (np.r_[starts, len(pair)] * votes.itemsize).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(votes)])
    which, of = np.divmod(pair[starts], len(fence.dictionary))
    return pa.RecordBatch.from_arrays([vehicle.dictionary.take(pa.array(which)), fence.dictionary.take(pa.array(of)), rows], names=[c.split()[0] for c in PACKED.split(", ")])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TOLD as rows of OUT."""
    for batch in batches:
        for start in range(0, batch.num_rows, A_TELL):
            yield _unpack(batch.slice(start, A_TELL))


def _unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
    vehicle, fences, told = batch.columns
    parts = told.to_pylist()
    owner = np.repeat(np.arange(len(parts)), [len(x) // 40 for x in parts])
    place, turn, revision, at, bits = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 5).T
    offsets = fences.offsets.to_numpy()
    has = lambda bit: bits & bit != 0
    either = lambda names, bit, here: pa.array(names).take(pa.array(has(bit).astype(np.int64), mask=~here))
    moment = lambda here: pa.array(at, pa.int64(), mask=~here).cast(pa.timestamp("us"))
    crossed, zones = has(CROSSED), ["OUT", "IN"]
    columns = [vehicle.take(pa.array(owner)), fences.flatten().take(pa.array(offsets[owner] - offsets[0] + place)), pa.array(turn), pa.array(revision), moment(crossed), either(["EXIT", "ENTRY"], ENTERS, crossed), either(["low", "high"], SURE, crossed)]
    columns += [either(zones, STANDS_IN, ~crossed & has(STANDS)), either(zones, ENTERS, ~crossed), moment(~crossed)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])


def _in_order(pair: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((votes, pair))
    return pair[order], votes[order]


def _filed(pair: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return (pair << SPAN_BITS) | (votes & WITHIN)


class Detector(StatefulProcessor):
    """State of one vehicle."""

    def __init__(self, part: int = A_PART) -> None:
        self.most = part

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: fences by place, the newest span and its last part, and the votes that are not filed yet
        self.head = handle.getValueState("head", "pairs array<struct<geofence_id string, last string, last_at bigint, stands string, turn bigint, revision bigint>>, span bigint, part bigint, open_pair binary, open_votes binary")
        self.votes = handle.getMapState("votes", "span bigint, part bigint", "votes binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        pairs, span, part, *kept = self.head.get() or ([], None, -1, b"", b"")
        places, heads = {p[0]: i for i, p in enumerate(pairs)}, [tuple(p[1:]) for p in pairs]
        found = [(places.setdefault(row[1], len(places)), np.frombuffer(row[2], np.int64)) for row in rows]
        heads += [NO_HEAD] * (len(places) - len(heads))
        touched = sorted({i for i, _ in found})
        pair, votes = _in_order(np.repeat([i for i, _ in found], [len(v) for _, v in found]), np.concatenate([v for _, v in found]))
        new = np.ones(len(votes), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (votes[1:] >> 2 != votes[:-1] >> 2)
        late, opened = np.array([], np.int64), (np.frombuffer(kept[0], np.int32).astype(np.int64), np.frombuffer(kept[1], np.int64))
        if pairs:
            last = np.array([np.iinfo(np.int64).min if head[1] is None else head[1] for head in heads])
            behind = votes >> 2 <= last[pair]
            for s in np.unique(votes[behind] >> SPAN_BITS).tolist():
                here = np.flatnonzero(behind & (votes >> SPAN_BITS == s))
                of_span = opened[1] >> SPAN_BITS == s
                seen = [_filed(opened[0][of_span], opened[1][of_span]), *(self._parts(s) if span is not None and s <= span else [])]
                new[here] &= ~np.isin(_filed(pair[here], votes[here]) >> 2, np.concatenate(seen) >> 2)
            late = np.unique(pair[behind & new])

        pair, votes = pair[new], votes[new]
        opened = (np.concatenate([opened[0], pair]), np.concatenate([opened[1], votes]))
        if len(late):
            pair, votes = self._again(late, pair, votes, opened)
        if len(opened[1]) > self.most:
            span, part = self._file(*opened, span, part)
            opened = (opened[0][:0], opened[1][:0])
        replayed, fences, told = set(late.tolist()), list(places), []
        kept = turning(pair, votes)
        pair, votes = pair[kept], votes[kept]
        each = [(v >> 2, "IN" if v & IN else "OUT", v & DECISIVE != 0) for v in votes.tolist()]
        low, high = (np.searchsorted(pair, touched, side).tolist() for side in ("left", "right"))
        for n, (i, a, b) in enumerate(zip(touched, low, high, strict=True)):
            turn = heads[i][3] + 1
            crossed, heads[i] = fold(each[a:b], (None, None, None, turn, turn) if i in replayed else (*heads[i][:3], turn, heads[i][4]))
            zone, at, stands, _, revision = heads[i]
            told += [(n, turn, revision, t, CROSSED | (ENTERS if kind == "ENTRY" else 0) | (SURE if sure == "high" else 0)) for t, kind, sure in crossed]
            told.append((n, turn, revision, at, (ENTERS if zone == "IN" else 0) | (0 if stands is None else STANDS) | (STANDS_IN if stands == "IN" else 0)))
        self.head.update(([(fence, *head) for fence, head in zip(fences, heads, strict=True)], span, part, opened[0].astype(np.int32).tobytes(), opened[1].tobytes()))
        for i in range(0, len(told), A_TELL):
            some = np.array(told[i : i + A_TELL], np.int64)
            first, last = int(some[0, 0]), int(some[-1, 0])
            some[:, 0] -= first
            yield _TOLD(*key, [fences[j] for j in touched[first : last + 1]], some.tobytes())

    def _parts(self, span: int) -> list[np.ndarray]:
        """All that is filed under a span, by part."""
        found: list[np.ndarray] = []
        while (kept := self.votes.getValue((span, len(found)))) is not None:
            found.append(np.frombuffer(kept[0], np.int64))
        return found

    def _file(self, pair: np.ndarray, votes: np.ndarray, span: int | None, part: int) -> tuple[int, int]:
        """Files votes as new parts of their spans; the newest span and its last part."""
        order = np.argsort(votes)
        filed, spans = _filed(pair, votes)[order], votes[order] >> SPAN_BITS
        for some, s in zip(np.split(filed, np.flatnonzero(np.diff(spans)) + 1), np.unique(spans).tolist(), strict=True):
            n = 0 if span is None or s > span else part + 1 if s == span else len(self._parts(s))
            for i in range(0, len(some), self.most):
                self.votes.updateValue((s, n), (some[i : i + self.most].tobytes(),))
                n += 1
            if span is None or s >= span:
                span, part = s, n - 1
        return span, part

    def _again(self, late: np.ndarray, pair: np.ndarray, votes: np.ndarray, opened: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pair, votes) in order, with all votes of the pairs in ``late``."""
        on_time, still_open = ~np.isin(pair, late), np.isin(opened[0], late)
        pairs, parts = [pair[on_time], opened[0][still_open]], [votes[on_time], opened[1][still_open]]
        for (span, _), (kept,) in self.votes.iterator():
            filed = np.frombuffer(kept, np.int64)
            filed = filed[np.isin(filed >> SPAN_BITS, late)]
            pairs.append(filed >> SPAN_BITS)
            parts.append((span << SPAN_BITS) | (filed & WITHIN))
        return _in_order(np.concatenate(pairs), np.concatenate(parts))

    def close(self) -> None:
        pass


def detect(fixes: DataFrame, fences: DataFrame, roster: DataFrame, part: int = A_PART) -> DataFrame:
    """A stream of rows (OUT) from a stream of fixes; the session's state store must be RocksDB (PROVIDER)."""
    # a vehicle's fixes come together first, so that a packed row holds many votes
    votes = geofence.opinions(geofence.probes(fixes.repartition("vehicle_id"), fences, geofence.full_scope(roster)))
    code = F.when(F.col("zone") == "IN", IN).otherwise(0) + F.when(F.col("decisive"), DECISIVE).otherwise(0)
    rows = votes.select(*geofence.PAIR, "event_ts", code.alias("code")).mapInArrow(packed, PACKED)
    told = rows.groupBy("vehicle_id").transformWithState(statefulProcessor=Detector(part), outputStructType=TOLD, outputMode="Update", timeMode="None")
    return told.mapInArrow(unpacked, OUT)


def crossings(rows: DataFrame) -> DataFrame:
    """The crossings that count: those of each pair's last revision."""
    last = rows.groupBy(*geofence.PAIR).agg(F.max("revision").alias("revision"))
    return rows.join(last, [*geofence.PAIR, "revision"], "left_semi").filter("kind is not null").select(*geofence.PAIR, "event_ts", "kind", "confidence")


def containment(rows: DataFrame) -> DataFrame:
    """Each pair's state after its last turn."""
    last = rows.filter("kind is null").groupBy(*geofence.PAIR).agg(F.max_by(F.struct("zone", "pending_zone", "pending_ts"), "turn").alias("s"))
    return last.select(*geofence.PAIR, "s.*")
