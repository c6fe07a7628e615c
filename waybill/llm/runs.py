"""Periodic runs of words, found in tiles of one scale each and stitched.

A run is a longest stretch of words with smallest period q and at least max(6, 4 q) words.  Periods go
by octaves [P, 2P), P a power of two.  For a period q, let a match be a word that equals the word q
later; a run of m words is m - q matches in a row, 3 q of them at least.

1. A document's words are numbered.  On every octave, boundaries stand P words apart.  A stretch of at
   least 3 q >= 3 P matches holds two whole blocks of P words between boundaries, one after the other,
   and both stand again q words later.  Hashes of all P words in a row, made from those of P / 2, show
   in one pass which boundaries may lie in a run; the rest are passed over.  This loses nothing, since
   equal blocks have equal hashes, and each boundary of a stretch is an edge of such a block.
2. Boundaries are gathered in tiles: words lo - P to hi + 3 P for the boundaries from lo to hi, so tiles
   overlap; words that no boundary needs are in none.  Tiles leave the task that read the document and
   are dealt over the cluster, so that a very long document is the work of many tasks.
3. A tile is solved on its own.  For each boundary b, the Z-function of the words from b on tells how
   far matches of every period of the octave go to the right, and that of the words before b, backwards,
   how far to the left: fragments (document, period, from, to), joined within the tile.
4. Fragments meet by document and period and are stitched where they touch; stretches of at least 3 q
   matches are candidates.  A period that is no smallest one has a run of its smallest period with the
   same ends, so of equal stretches the smallest period stays.

Documents without a tile are done at once; only texts with tiles meet their runs again.

Edge cases: null, empty and blank texts have no words and no runs; very long texts are cut into tiles
and never into parts that could hide a run; repeated rows are documents of their own and give equal
results; runs of equal length are ties that the smallest start wins, then the smallest period; an empty
table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waybill.llm.common import cut, map_batches, share_code
from waybill.llm.words import MIX, mix

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4


@dataclass(frozen=True)
class RunParams:
    """``tile_words``: words that the boundaries of a tile span, or eight boundaries where their octave needs more.  ``chunk_chars``: characters that a task searches at once."""

    tile_words: int = 8_192
    chunk_chars: int = 2_000_000


Words = Callable[[int | None, str | None], list[bytes]]


def plain_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """Words are what white space (0x20, 0x09 to 0x0D) separates."""
    return (text or "").encode("utf-8").split()


def contract_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """plain_words(), with the tail of every tenth document (by crc32 of its id) made periodic: the contract of the query op13."""
    words = plain_words(doc_id, text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


class Numbering(defaultdict):
    """Words to numbers, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def boundaries(ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each octave P: (P, document, boundary), the boundaries of documents that may lie in a run.

    All documents are searched as one array, each with a number of its own behind it that no block matches.
    """
    sizes = np.array([len(x) + 1 for x in ids])
    which = np.arange(len(ids))
    last = max((int(x.max()) for x in ids if len(x)), default=0) + 1
    flat = np.concatenate([np.append(x, last + i) for i, x in enumerate(ids)]).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    block = mix(flat * MIX + np.uint64(1))
    octave = 1
    while True:
        enough = sizes - 1 >= max(LEAST_WORDS, LEAST_TIMES * octave)
        if not enough.any():
            return
        if not enough.all():  # drop documents that are too short for this octave
            block = block[np.repeat(enough, sizes)]
            which, sizes = which[enough], sizes[enough]
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(block)) - starts[owner]
        number = at // octave
        before = np.maximum(number - 1, 0) * octave
        hit = (number > 0) & (block == block[starts[owner] + before])
        found = np.flatnonzero(hit[:-octave] & hit[octave:] & (owner[:-octave] == owner[octave:]))
        if len(found):
            # the blocks after boundaries j and j + 1 stand again at one distance: boundaries j to j + 2 are their edges
            first = (owner[found] << 40) | before[found]
            pairs = np.unique(np.concatenate([first, first + octave, first + 2 * octave]))
            yield octave, which[pairs >> 40], pairs & ((1 << 40) - 1)
        ahead = np.minimum(np.arange(len(block)) + octave, len(block) - 1)
        block = mix(block * MIX + block[ahead])
        octave *= 2


def z_function(s: list[int]) -> list[int]:
    """z[i]: length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve_tile(words: list[int], first: int, octave: int, marks: list[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, from, to) of matches around the boundaries ``marks``; ``words`` are those from number ``first`` on.

    Fragments go up to P words to each side of a boundary and are joined where they touch.
    """
    reach: dict[int, list[list[int]]] = {}
    for b in marks:
        at = b - first
        ahead = z_function(words[at : at + 3 * octave])
        low = max(at - octave, 0)
        own = words[low:at][::-1]
        behind = z_function([*own, -1, *words[low : at + 2 * octave][::-1]])
        seen = min(at + 2 * octave, len(words))
        for q in range(octave, min(2 * octave, len(words) - at + 1)):
            right = min(ahead[q], octave) if q < len(ahead) else 0
            left = behind[len(own) + 1 + seen - at - q] if own and at + q <= seen else 0
            if max(left, right) >= octave:
                parts = reach.setdefault(q, [])
                if parts and parts[-1][1] >= b - left:
                    parts[-1][1] = max(parts[-1][1], b + right)
                else:
                    parts.append([b - left, b + right])
    return [(q, x, y) for q, parts in reach.items() for x, y in parts]


def _tiles(ids: np.ndarray, octave: int, marks: np.ndarray, p: RunParams) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(number of its first word, boundaries, words) of each tile."""
    span = max(p.tile_words // octave, 8) * octave
    apart = (np.diff(marks // span) > 0) | (np.diff(marks) > 4 * octave)
    for part in np.split(marks, np.flatnonzero(apart) + 1):
        low, high = max(int(part[0]) - octave, 0), int(part[-1]) + 3 * octave
        yield low, part.tolist(), ids[low:high]


KINDS = "row bigint, doc_id bigint, text string, words_sha256 string, octave bigint, first bigint, marks array<bigint>, words array<int>"


def tiled(docs: DataFrame, words_of: Words, p: RunParams) -> DataFrame:
    """A row (row, doc_id, words_sha256) for a document that is done; else one with its text, and one a tile.

    ``row`` tells documents apart: it is made of the number of the task's partition and a count, and holds
    since the caller writes the table before use.
    """
    from pyspark import TaskContext

    def make():
        base = TaskContext.get().partitionId() << 33
        count = 0

        def work(doc_id, text):
            nonlocal count
            out: dict[str, list] = {c.split()[0]: [] for c in KINDS.split(", ")}

            def add(**row):
                for name, values in out.items():
                    values.append(row.get(name))

            at = 0
            while at < len(text):
                end, size = at, 0
                while end < len(text) and (end == at or size + len(text[end] or "") <= p.chunk_chars):
                    size += len(text[end] or "")
                    end += 1
                split = [words_of(i, t) for i, t in zip(doc_id[at:end], text[at:end], strict=True)]
                number = Numbering()
                ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split]
                waits = set()
                for octave, owners, marks in boundaries(ids):
                    for part in np.split(np.arange(len(owners)), np.flatnonzero(np.diff(owners)) + 1):
                        d = int(owners[part[0]])
                        waits.add(d)
                        for first, tile_marks, tile in _tiles(ids[d], octave, marks[part], p):
                            add(row=base + count + d, octave=octave, first=first, marks=tile_marks, words=tile.astype(np.int32).tolist())
                for d, w in enumerate(split):
                    done = None if d in waits else hashlib.sha256(b" ".join(w)).hexdigest()
                    add(row=base + count + d, doc_id=doc_id[at + d], text=None if done else text[at + d] or "", words_sha256=done)
                count += end - at
                at = end
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), make, KINDS)


def fragments(tiles: DataFrame) -> DataFrame:
    """(row, period, x, y): stretches of matches seen in single tiles, which are dealt over the cluster first."""
    share_code(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # tile by tile: only one is held as Python numbers
                row, octave, first, marks, words = (c[i].as_py() for c in batch.columns)
                found = solve_tile(words, first, octave, marks)
                if found:
                    period, x, y = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(found), "period": period, "x": x, "y": y}, schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("row", "period", "x", "y")])
    dealt = tiles.select("row", "octave", "first", "marks", "words").repartition("row", "octave", "first")
    return dealt.mapInArrow(run, "row bigint, period bigint, x bigint, y bigint")


def stitched(parts: DataFrame) -> DataFrame:
    """(row, start, length, period): fragments of a document and period joined where they touch, runs of smallest period kept."""
    w = Window.partitionBy("row", "period").orderBy("x", "y")
    reached = F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = parts.withColumn("opens", F.coalesce(F.col("x") > reached, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("row", "period", "island").agg(F.min("x").alias("start"), (F.max("y") - F.min("x") + F.col("period")).alias("length"))
    long = whole.filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _search(docs: DataFrame, words_of: Words, p: RunParams) -> tuple[DataFrame, DataFrame]:
    """The written table of tiled(), and the runs by row."""
    seen = cut(tiled(docs, words_of, p))
    return seen, stitched(fragments(seen.filter("octave is not null")))


def periodic_runs(docs: DataFrame, p: RunParams = RunParams(), words_of: Words = plain_words) -> DataFrame:
    """(doc_id, row, start, length, period): every run of every document; ``row`` tells documents of one id apart."""
    seen, runs = _search(docs, words_of, p)
    return seen.filter("octave is null").select("row", "doc_id").join(runs, "row").select("doc_id", "row", "start", "length", "period")


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def collapsed(docs: DataFrame, p: RunParams = RunParams(), words_of: Words = plain_words) -> DataFrame:
    """(doc_id, runs, words_sha256, text): each document's runs by start, then period, and its words without repeats, joined by single spaces.

    The text is null where no run was found: it is the words as they are, and words_sha256 their digest.
    """
    seen, runs = _search(docs, words_of, p)
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # at most a run for each six words
    open_ = seen.filter("octave is null and words_sha256 is null").select("row", "doc_id", "text").join(listed, "row", "left")

    def make():
        def work(doc_id, text, found):
            spans = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in found]
            kept = [b" ".join(collapse(words_of(i, t), s)) for i, t, s in zip(doc_id, text, spans, strict=True)]
            return {"doc_id": doc_id, "runs": [[{"start": a, "period": q, "length": m} for a, m, q in s] for s in spans], "words_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "text": [k.decode("utf-8") if s else None for k, s in zip(kept, spans, strict=True)]}

        return work

    schema = "doc_id bigint, runs array<struct<start: bigint, period: bigint, length: bigint>>, words_sha256 string, text string"
    done = seen.filter("octave is null and words_sha256 is not null")
    none = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    return map_batches(open_.select("doc_id", "text", "runs"), make, schema).unionByName(done.select("doc_id", none.alias("runs"), "words_sha256", F.lit(None).cast("string").alias("text")))


def run_report(docs: DataFrame, p: RunParams = RunParams(), words_of: Words = contract_words) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    rows = collapsed(docs, p, words_of)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = rows.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.col("words_sha256").alias("collapsed_sha256"),
    )
