"""Removal of long repeated byte strings, found by external induced sorting of suffixes.

Every string of ``length`` bytes holds a content-chosen anchor: the least hash of its ``gram``-byte
strings.  Equal strings have equal anchors wherever they stand, so neighbouring starts with one
anchor form a region, and only regions of one anchor can hold each other's strings.

1. Each text is cut into regions; rows (anchor, digest of the region's bytes, place) are counted.
   An anchor that stands once in the whole table is done with: nothing in its region repeats.
   Of the others, a region stays in the search only if another one shares the bytes for half a
   string before or after the anchor, as two regions with an equal string must.
2. Equal regions fold into one with its count; all of a region met twice is repeated.
3. The distinct regions of the remaining anchors are narrowed: of equal pieces one stays, and of the
   others the starts whose bytes around the anchor another piece holds (see narrowed()).  What stays is
   laid end to end in shards, and the suffixes of a shard are sorted by external induced sorting; a start
   is repeated where its common prefix with a neighbour in suffix order reaches the length.  An anchor with very many distinct regions is
   first dealt into groups that share more bytes around it than the anchor (see deal()); strings of
   different groups differ, so each group has a shard of its own.
4. Repeated starts go back to every place of their region and become byte ranges of the text.

A region never leaves its shard's disk-backed queues, whose memory is bounded, and nothing is
collected to the driver.

Edge cases: null text counts as empty; texts shorter than ``length`` lose nothing; very long texts are
searched whole; repeated rows are separate documents (so each loses what both hold); where an anchor's
hash stands at several places of a string, the leftmost counts; an empty table gives an empty table;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waybill.llm.common import cut, map_batches, share_code
from waybill.llm.induced import repeated_starts
from waybill.llm.words import MIX, mix


@dataclass(frozen=True)
class SuffixParams:
    """``shard``: bytes of regions that are sorted at once; ``shards``: most partitions they are dealt over.
    ``memory``: bytes that a shard's queues hold before they go to disk.  ``crowd``: distinct regions of an
    anchor that stay together; beyond it they are dealt into groups.  ``block``: bytes of regions that are
    narrowed at once; ``cores``: ranges of offsets, each with a core, that the starts are told apart by first."""

    length: int = 400
    gram: int = 24
    shard: int = 1 << 21
    shards: int = 20_000
    memory: int = 1 << 20
    crowd: int = 2_000
    block: int = 1 << 18
    cores: int = 8


class Anchors:
    """For each start of a string of ``length`` bytes, the least hash of its grams and where it stands.

    The grams are cut into blocks as long as a string has grams; a window is the tail of one block
    and the head of the next, so running minima from either side give every window's minimum.
    """

    def __init__(self, hashes: np.ndarray, span: int) -> None:
        n, self.span = len(hashes), span
        padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = hashes
        self.blocks = padded.reshape(-1, span)
        self.head = np.minimum.accumulate(self.blocks, axis=1)
        self.tail = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1]
        starts = n - span + 1
        self.least = np.minimum(self.tail.ravel()[:starts], self.head.ravel()[span - 1 : span - 1 + starts])

    def first_place(self, start: np.ndarray) -> np.ndarray:
        """The leftmost place of each window's minimum."""
        at = np.arange(self.blocks.size).reshape(self.blocks.shape)
        fresh = np.concatenate([np.ones((len(at), 1), bool), self.blocks[:, 1:] < self.head[:, :-1]], axis=1)
        head = np.maximum.accumulate(np.where(fresh, at, -1), axis=1).ravel()
        tail = np.minimum.accumulate(np.where(self.blocks == self.tail, at, at.size)[:, ::-1], axis=1)[:, ::-1].ravel()
        end = start + self.span - 1
        return np.where(self.tail.ravel()[start] <= self.head.ravel()[end], tail[start], head[end])

    def last_place(self, start: np.ndarray) -> np.ndarray:
        """The rightmost place of each window's minimum."""
        at = np.arange(self.blocks.size).reshape(self.blocks.shape)
        head = np.maximum.accumulate(np.where(self.blocks == self.head, at, -1), axis=1).ravel()
        fresh = np.concatenate([self.blocks[:, :-1] < self.tail[:, 1:], np.ones((len(at), 1), bool)], axis=1)
        tail = np.minimum.accumulate(np.where(fresh, at, at.size)[:, ::-1], axis=1)[:, ::-1].ravel()
        end = start + self.span - 1
        return np.where(self.head.ravel()[end] <= self.tail.ravel()[start], head[end], tail[start])


def gram_hashes(data: np.ndarray, p: SuffixParams) -> np.ndarray:
    n = len(data) - p.gram + 1
    h, width = data.astype(np.uint64), 1
    power = np.uint64(0x100000001B3)
    parts, left, at = None, p.gram, 0
    with np.errstate(over="ignore"):
        while left:  # h holds hashes of ``width`` bytes; the gram is put together from powers of two
            if left & 1:
                piece = h[at : at + n]
                parts = piece.copy() if parts is None else mix(parts) * power + piece
                at += width
            left >>= 1
            if left:
                h = mix(h[:-width]) * power + h[width:]
                width *= 2
        return mix(parts * MIX)


#: An odd base of the rolling hash of byte ranges, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges, from one running sum."""
    powers = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data) - 1, base, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers(BASE), dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * powers(INVERSE)[start])


@dataclass
class Regions:
    """Regions of texts laid end to end: text number, anchor, first and last start, whether the anchor stands in the
    region more than once, and hashes of the bytes before and after it (None where the text ends sooner)."""

    joined: bytes
    owner: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    inner: np.ndarray
    before: pa.Array
    after: pa.Array


def cut_regions(texts: list[bytes], p: SuffixParams) -> Regions:
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    at = np.empty(0, np.int64)
    if len(data) >= p.length:
        found = Anchors(gram_hashes(data, p), p.length - p.gram + 1)
        anchor = found.least
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
        at = np.flatnonzero(np.arange(len(anchor)) + p.length <= ends[owner])
    if not len(at):
        none = np.empty(0, np.int64)
        return Regions(joined, none, none, none, none, none.astype(bool), pa.array(none), pa.array(none))
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
    fresh = new[at] | np.r_[True, np.diff(at) != 1]
    first = at[fresh]
    last = np.append(at[np.flatnonzero(fresh)[1:] - 1], at[-1])
    place, owner = found.first_place(first), owner[first]
    # a string reaches half its length before the anchor, or half its length and a gram from it on
    half = (p.length - p.gram) // 2
    left, right = place - half, place + p.length - half
    has_left, has_right = left >= ends[owner] - sizes[owner], right <= ends[owner]
    hashes = lambda a, b, has: pa.array(range_hashes(data.astype(np.uint64), np.where(has, a, 0), np.where(has, b, 0)).view(np.int64), mask=~has)
    before, after = hashes(left, place + p.gram, has_left), hashes(place, right, has_right)
    return Regions(joined, owner, anchor[first].view(np.int64), first, last, place != found.last_place(last), before, after)


def row_key() -> list[Column]:
    """Two columns that name a row of documents by its id and text, whatever is null."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def region_rows(docs: DataFrame, p: SuffixParams) -> DataFrame:
    """(anchor, digest, doc_key, text_key, start, last, inner, before, after) for each region of each row."""

    def make():
        import xxhash

        def work(doc_key, text_key, text):
            raw = [(t or "").encode("utf-8") for t in text]
            r = cut_regions(raw, p)
            base = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)[r.owner]
            view = memoryview(r.joined)
            digest = [xxhash.xxh3_64_intdigest(view[a : b + p.length]) for a, b in zip(r.first.tolist(), r.last.tolist(), strict=True)]
            return {
                "anchor": r.anchor,
                "digest": np.array(digest, np.uint64).view(np.int64),
                "doc_key": np.array(doc_key, np.int64)[r.owner],
                "text_key": np.array(text_key, np.int64)[r.owner],
                "start": (r.first - base).astype(np.int32),
                "last": (r.last - base).astype(np.int32),
                "inner": r.inner,
                "before": r.before,
                "after": r.after,
            }

        return work

    return map_batches(docs.select(*row_key(), "text"), make, "anchor bigint, digest bigint, doc_key bigint, text_key bigint, start int, last int, inner boolean, before bigint, after bigint")


def fetch_regions(wanted: DataFrame, docs: DataFrame, p: SuffixParams) -> DataFrame:
    """(anchor, digest, shift, over, under, bytes) for the wanted regions (anchor, digest, crowded, doc_key, text_key, start, last).

    A region of a crowded anchor comes in pieces of starts whose strings have their anchor at one
    place (one piece, unless the anchor stands in the region several times).  shift: the piece's first
    start; over, under: bytes between the first and the last start and the anchor, null if not crowded.
    """
    by_row = wanted.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("anchor", "digest", "crowded", "start", "last")).alias("regions"))
    texts = docs.select(*row_key(), "text").join(by_row, ["doc_key", "text_key"]).dropDuplicates(["doc_key", "text_key"])
    names = ("anchor", "digest", "shift", "over", "under", "bytes")

    def pieces(raw: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        found = Anchors(gram_hashes(np.frombuffer(raw, np.uint8), p), p.length - p.gram + 1)
        place = found.first_place(np.arange(len(found.least)))
        edges = [*np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist(), len(place)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield a, int(place[a]) - a, int(place[a]) - b + 1, raw[a : b - 1 + p.length]

    def make():
        def work(regions, text):
            out: dict[str, list] = {name: [] for name in names}
            for rows, t in zip(regions, text, strict=True):
                whole = t.encode("utf-8")
                for r in rows:
                    raw = whole[r["start"] : r["last"] + p.length]
                    for piece in pieces(raw) if r["crowded"] else [(0, None, None, raw)]:
                        for name, x in zip(names, (r["anchor"], r["digest"], *piece), strict=True):
                            out[name].append(x)
            return out

        return work

    return map_batches(texts.select("regions", "text"), make, "anchor bigint, digest bigint, shift int, over int, under int, bytes binary")


GROUPED = "group bigint, anchor bigint, digest bigint, shift int, bytes binary"


def deal(pieces: DataFrame, p: SuffixParams) -> tuple[DataFrame, DataFrame]:
    """Deal the pieces of crowded anchors into groups: (GROUPED rows, (anchor, digest, hits) of starts already known to repeat).

    The starts of a piece are told apart by how many bytes lie before the anchor.  For a range of such
    offsets all strings hold the same core: the bytes that reach as far left as the least offset and
    as far right as the greatest allows.  Equal strings have equal offsets and equal cores, so a range
    is halved until a core is met by few pieces; a core met once holds no repeat.  A piece makes two
    rows a round at most, and at the end of the halving a core is the string itself.
    """
    spark, groups, known = pieces.sparkSession, [], []
    kept = ("anchor", "digest", "shift", "over", "under", "bytes")
    rest = pieces.select(*kept, F.lit(0).alias("lo"), F.lit(p.length - p.gram).alias("hi"))
    while not rest.isEmpty():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))).alias("r")
        halved = rest.select(*kept, halves).select(*kept, "r.lo", "r.hi").filter("lo <= hi AND under <= hi AND over >= lo")
        halved = cut(halved.withColumn("core", F.xxhash64(F.substring("bytes", F.col("over") - F.col("lo") + 1, F.col("lo") + p.length - F.col("hi")))))
        key = ["anchor", "lo", "hi", "core"]
        counts = cut(halved.groupBy(*key).agg(F.count(F.lit(1)).alias("met")).filter("met > 1"))
        crowds = F.broadcast(counts.filter(F.col("met") > p.crowd).select(*key))  # one of ``crowd`` rows at most; joined where the rows lie
        many = halved.join(crowds, key, "left_semi")
        met = halved.join(crowds, key, "left_anti").join(counts.filter(F.col("met") <= p.crowd).select(*key), key, "left_semi")
        first = F.col("over") - F.least("over", "hi")  # the first start with an offset in the range
        known.append(met.unionByName(many).filter("lo = hi").select("anchor", "digest", F.array(F.col("shift") + first, F.col("shift") + first + 1).alias("hits")))
        few = met.filter("lo < hi")
        held = F.substring("bytes", first + 1, F.least("over", "hi") - F.greatest("under", "lo") + p.length)
        groups.append(few.select(F.xxhash64(*key).alias("group"), "anchor", "digest", (F.col("shift") + first).alias("shift"), held.alias("bytes")))
        rest = cut(many.filter("lo < hi").select(*kept, "lo", "hi"))
    none = spark.createDataFrame([], GROUPED), spark.createDataFrame([], "anchor bigint, digest bigint, hits array<int>")
    for g, k in zip(groups, known, strict=True):
        none = none[0].unionByName(g), none[1].unionByName(k)
    return none


SORTED = "anchor bigint, digest bigint, hits array<int>"


def _runs(flags: np.ndarray, shift: int) -> list[int]:
    """Starts and ends (exclusive) of the true stretches, flat and moved by ``shift``."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return (np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel() + shift).tolist()


@dataclass
class Pieces:
    """Starts of a row whose strings have their anchor at one place: row, first start, end (exclusive), hash of all their
    bytes; and the pieces' cores: piece, the core's starts (from, to), hash of the core."""

    row: np.ndarray
    first: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    piece: np.ndarray
    core_first: np.ndarray
    core_end: np.ndarray
    core: np.ndarray


def cut_pieces(raws: list[bytes], p: SuffixParams) -> Pieces:
    """The pieces of regions, which have ``length`` bytes at least."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(raws)), sizes - p.length + 1)
    at = np.arange(len(row)) + row * (p.length - 1)
    place = Anchors(gram_hashes(data, p), p.length - p.gram + 1).first_place(at)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    row, place, first, last = row[new], place[new], at[new], at[np.append(new[1:], len(at)) - 1]
    # bytes before the anchor tell a piece's strings apart; those of one range of such offsets hold the same core
    width = -(-(p.length - p.gram + 1) // p.cores)
    lo = np.arange(0, p.length - p.gram + 1, width)
    hi = np.minimum(lo + width - 1, p.length - p.gram)
    piece, k = np.nonzero(((place - last)[:, None] <= hi) & ((place - first)[:, None] >= lo))
    a, b = place[piece] - lo[k], place[piece] - hi[k] + p.length
    hashes = range_hashes(data.astype(np.uint64), np.append(first, a), np.append(last + p.length, b))
    whole, core = hashes[: len(first)], mix(hashes[len(first) :] + k.astype(np.uint64))
    core_first, core_end = np.maximum(first[piece], b - p.length), np.minimum(last[piece], a) + 1
    return Pieces(row, first - base[row], last + 1 - base[row], whole, piece, core_first - base[row[piece]], core_end - base[row[piece]], core)


def joined_stretches(row: np.ndarray, first: np.ndarray, end: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Disjoint stretches (row, first, end) in order, those of a row with up to ``gap`` starts between them as one."""
    if not len(row):
        return []
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] - end[:-1] > gap)])
    return list(zip(row[new].tolist(), first[new].tolist(), end[np.append(new[1:], len(row)) - 1].tolist(), strict=True))


def narrowed(raws: list[bytes], p: SuffixParams) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Stretches of starts (row, first, end) that are known to repeat, and those whose suffixes have to be sorted.

    Equal pieces repeat, and one of them stands for all.  Of the different ones, equal strings have equal
    offsets and so equal cores: starts whose core no other piece holds are done with.
    """
    found, base, pieces = [], 0, 0
    for part in bounded_rows(raws, p.block):
        x = cut_pieces(part, p)
        x.row += base
        x.piece += pieces
        base, pieces = base + len(part), pieces + len(x.row)
        found.append(x)
    x = Pieces(*(np.concatenate([getattr(y, f.name) for y in found]) for f in fields(Pieces)))
    _, leader, of = np.unique(x.whole, return_index=True, return_inverse=True)
    leader = leader[of]
    held = lambda i: raws[x.row[i]][x.first[i] : x.end[i] - 1 + p.length]
    copy = np.zeros(pieces, bool)
    for i in np.flatnonzero(leader != np.arange(pieces)).tolist():
        copy[i] = held(i) == held(leader[i])
    known = copy.copy()
    known[leader[copy]] = True
    open_ = np.flatnonzero(~copy[x.piece])
    _, of, met = np.unique(x.core[open_], return_inverse=True, return_counts=True)
    open_ = open_[met[of] > 1]
    again = joined_stretches(x.row[known], x.first[known], x.end[known], 0)
    return again, joined_stretches(x.row[x.piece[open_]], x.core_first[open_], x.core_end[open_], p.length - 1)


def bounded_rows(raws: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The rows in order, so many at a time that they hold ``size`` bytes, one at least."""
    begin, held = 0, 0
    for i, raw in enumerate(raws):
        held += len(raw)
        if held >= size:
            yield raws[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(raws):
        yield raws[begin:]


def sort_shards(regions: DataFrame, p: SuffixParams) -> DataFrame:
    """Sort regions (group, anchor, digest, shift, bytes) shard by shard; hits: stretches of repeated starts, if there are any.

    A partition's rows come group by group.  Blocks of whole groups are narrowed to the stretches that have
    to be sorted, and a shard is ended at the first block beyond its size, so memory does not grow with the
    partition, only with its largest group.
    """
    share_code(regions.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(SORTED))

    def batches_of(out: list[dict]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[i : i + 256], schema=schema)

    def sort(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        pieces: list[np.ndarray] = []
        for *_, raw in rows:
            pieces += [np.frombuffer(raw, np.uint8).astype(np.uint16) + 2, np.ones(1, np.uint16)]
        text = np.concatenate([*pieces, np.zeros(1, np.uint16)])
        del pieces
        hit = repeated_starts(text, p.length, p.memory)
        at, out = 0, []
        for anchor, digest, shift, raw in rows:
            flags = hit[at : at + len(raw) - p.length + 1]
            if flags.any():
                out.append({"anchor": anchor, "digest": digest, "hits": _runs(flags, shift)})
            at += len(raw) + 1
        yield from batches_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        block: list[tuple[int, int, int, bytes]] = []
        held, size, last = 0, 0, None

        def narrow() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            known, open_ = narrowed([raw for *_, raw in block], p)
            hits: dict[int, list[int]] = {}
            for r, a, b in known:
                hits.setdefault(r, []).extend((block[r][2] + a, block[r][2] + b))
            yield from batches_of([{"anchor": block[r][0], "digest": block[r][1], "hits": h} for r, h in hits.items()])
            for r, a, b in open_:
                anchor, digest, shift, raw = block[r]
                rows.append((anchor, digest, shift + a, raw[a : b - 1 + p.length]))
                held += b - a - 1 + p.length
            block, size = [], 0

        for batch in batches:
            for group, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "anchor", "digest", "shift", "bytes")), strict=True):
                if size >= p.block and group != last:
                    yield from narrow()
                    if held >= p.shard:
                        yield from sort(rows)
                        rows, held = [], 0
                block.append(tuple(row))
                size, last = size + len(row[3]), group
        if block:
            yield from narrow()
        if rows:
            yield from sort(rows)

    return regions.sortWithinPartitions("group").mapInArrow(run, SORTED)


def repeated_spans(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """(doc_key, text_key, spans): covered byte ranges of each row that has any, as flat arrays of start, end."""
    rows = cut(region_rows(docs, p))  # written once, as the texts are dear to scan
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.bool_or("inner").alias("any_inner")).filter("total > 1 or any_inner")
    places = cut(rows.join(anchors.drop("total"), "anchor"))
    place = F.struct("doc_key", "text_key", "start", "last", "before", "after")
    distinct = places.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.bool_or("inner").alias("inner"), F.first("any_inner").alias("any_inner"))
    shared = cut(distinct)
    several = shared.join(shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions")), "anchor").filter("regions > 1 or inner")
    sides = several.filter("not any_inner").select("anchor", "digest", F.explode(F.array("place.before", "place.after")).alias("side")).filter("side is not null")
    met = sides.groupBy("side").agg(F.count(F.lit(1)).alias("met")).filter("met > 1").select("side")
    open_ = sides.join(met, "side", "left_semi").select("anchor", "digest").distinct()
    wanted = several.filter("not any_inner").join(open_, ["anchor", "digest"], "left_semi").unionByName(several.filter("any_inner"))
    place = [F.col(f"place.{c}") for c in ("doc_key", "text_key", "start", "last")]
    wanted = cut(wanted.select("anchor", "digest", *place))
    many = cut(wanted.groupBy("anchor").count().filter(F.col("count") > p.crowd).select("anchor", F.lit(True).alias("crowded")))
    pieces = fetch_regions(wanted.join(many, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), docs, p)
    apart, known = None, None
    if not many.isEmpty():
        pieces = cut(pieces)
        apart, known = deal(pieces.filter("over IS NOT NULL"), p)
    together = pieces.filter("over IS NULL").select(F.col("anchor").alias("group"), "anchor", "digest", "shift", "bytes")
    size = wanted.agg(F.sum(F.col("last").cast("long") - F.col("start") + p.length)).first()[0] or 0
    shards = (together if apart is None else together.unionByName(apart)).repartition(min(p.shards, -(-size // p.shard) or 1), "group")
    own = cut(sort_shards(shards, p))
    twice = shared.filter("n > 1").select("anchor", "digest", F.array(F.lit(0), F.lit((1 << 31) - 1)).alias("hits"))
    repeated = own.unionByName(twice) if known is None else own.unionByName(twice).unionByName(known)
    placed = places.join(repeated, ["anchor", "digest"])
    ends = lambda x, i: F.when(i % 2 == 0, F.col("start") + x).otherwise(F.least(F.col("start").cast("long") + x, F.col("last").cast("long") + 1).cast("int") + (p.length - 1))
    spans = placed.select("doc_key", "text_key", F.transform("hits", ends).alias("s"))
    return spans.groupBy("doc_key", "text_key").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal ranges of flat, unordered (start, end) pairs; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip((spans or [])[::2], (spans or [])[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, p: SuffixParams) -> DataFrame:
    return docs.select("doc_id", *row_key(), "text").join(repeated_spans(docs, p), ["doc_key", "text_key"], "left").select("doc_id", "text", "spans")


def kept_bytes(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in ranges)], [*(s for s, _ in ranges), len(raw)], strict=True))


def remove_repeats(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), removed (array of (start, end) byte ranges)."""

    def make():
        def work(doc_id, text, spans):
            ranges = [merged(s) for s in spans]
            kept = [kept_bytes((t or "").encode("utf-8"), r) for t, r in zip(text, ranges, strict=True)]
            return {"doc_id": doc_id, "kept": kept, "removed": [[{"start": a, "end": b} for a, b in r] for r in ranges]}

        return work

    return map_batches(_with_spans(docs, p), make, "doc_id bigint, kept binary, removed array<struct<start: int, end: int>>")


def repeat_report(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make():
        def work(doc_id, text, spans):
            raw, ranges = [(t or "").encode("utf-8") for t in text], [merged(s) for s in spans]
            return {
                "doc_id": doc_id,
                "n_bytes": [len(r) for r in raw],
                "n_removed": [sum(b - a for a, b in r) for r in ranges],
                "n_spans": [len(r) for r in ranges],
                "kept_sha256": [hashlib.sha256(kept_bytes(x, r)).hexdigest() for x, r in zip(raw, ranges, strict=True)],
            }

        return work

    return map_batches(_with_spans(docs, p), make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
