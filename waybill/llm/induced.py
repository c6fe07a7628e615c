"""External induced sorting of suffixes with common-prefix values.

The suffixes of a string are of type S (smaller than the next suffix) or L (larger).  The leftmost
S suffixes of each stretch are sorted first: the substrings between them are named in order by an
external merge sort, and the string of names is sorted recursively, down to a thousand names.  All
other suffixes follow by induction: scanning buckets upwards, each suffix hands its predecessor to the
queue of the predecessor's first symbol, which gives the L suffixes; scanning downwards gives the S
suffixes.  The queues are a bucketed priority queue whose records (position, common prefix with the
record before) lie in memory up to a budget and on disk beyond it; they are read back in chunks, so
memory stays bounded by the budget whatever the shard's size.  The common prefix of two induced
neighbours is one more than the least value between their parents.  A string of names has too many
symbols for a queue each: there the buckets are stretches of one array.  Arrays over the budget (star
positions, names, orders) are mapped files, so what a task holds is the text and some chunks.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from bisect import bisect_right
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np

#: Records that are handled at once.
CHUNK = 1 << 16
#: Sorted runs that are merged at once.
WAYS = 64
#: Rounds of naming by packed symbols; longer substrings are compared one by one.
NAME_ROUNDS = 48


class Scratch:
    """Queues and arrays with a common memory budget; what exceeds it lies in a private folder until close()."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.folder, self.files = memory, 0, None, 0
        self.queues: list[DiskQueue] = []
        self.spills = self.levels = 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-")
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, dtype=np.int64) -> np.ndarray:
        """Zeros, in memory or in a mapped file whose space is free again once the array is gone."""
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        path = self.path()
        mapped = np.memmap(path, dtype=dtype, mode="w+", shape=(n,))
        os.unlink(path)
        return mapped

    def grown(self, size: int) -> None:
        self.held += size
        if self.held > self.memory:
            self.spills += 1
            for q in self.queues:
                q.spill()
            self.queues, self.held = [], 0

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class DiskQueue:
    """First-in, first-out records of (position, common prefix)."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.parts, self.file, self.size, self.last = scratch, [], None, 0, None

    def push(self, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position):
            part = np.stack([position, prefix], axis=1).astype(np.int64)
            if not self.parts:
                self.scratch.queues.append(self)
            self.parts.append(part)
            self.size += len(part)
            self.last = part[-1]
            self.scratch.grown(part.nbytes)

    def spill(self) -> None:
        if self.parts:
            self.file = self.file or self.scratch.path()
            with open(self.file, "ab") as f:
                for part in self.parts:
                    part.tofile(f)
            self.parts = []

    def read(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks in the order of pushing; what is pushed meanwhile is not read."""
        parts, left = self.parts, os.path.getsize(self.file) // 16 if self.file else 0
        if left:  # what spills meanwhile comes after ``left`` records and is among ``parts``
            with open(self.file, "rb") as f:
                while left:
                    part = np.fromfile(f, np.int64, 2 * min(left, CHUNK)).reshape(-1, 2)
                    left -= len(part)
                    yield part[:, 0], part[:, 1]
        held = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        for i in range(0, len(held), CHUNK):
            yield held[i : i + CHUNK, 0], held[i : i + CHUNK, 1]

    def read_back(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks from the last record to the first, each reversed; a value then belongs to a record and the one read before it.

        The value of the first record read is left for the caller to set.
        """
        carried = 0
        blocks: list = [("held", np.concatenate(self.parts))] if self.parts else []
        if self.file:
            n = os.path.getsize(self.file) // 16
            blocks += [("file", (i, min(CHUNK, n - i))) for i in range((n - 1) // CHUNK * CHUNK, -1, -CHUNK)]
        for kind, x in blocks:
            if kind == "file":
                with open(self.file, "rb") as f:
                    f.seek(x[0] * 16)
                    x = np.fromfile(f, np.int64, 2 * x[1]).reshape(-1, 2)
            for end in range(len(x), 0, -CHUNK):
                part = x[max(0, end - CHUNK) : end][::-1]
                yield part[:, 0], np.concatenate([[carried], part[:-1, 1]])
                carried = part[-1, 1]

    def drop(self) -> None:
        self.parts, self.size = [], 0
        if self.file:
            os.unlink(self.file)
            self.file = None


def chunks(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + CHUNK)) for i in range(0, n, CHUNK))


def types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where a suffix is of type S; the last symbol is a unique smallest sentinel.  Worked out in chunks from the end."""
    n = len(text)
    is_s, following = scratch.array(n, bool), True
    is_s[-1] = True
    for end in range(n - 1, 0, -CHUNK):
        a = max(0, end - CHUNK)
        step = np.sign(text[a + 1 : end + 1].astype(np.int64) - text[a:end])
        at = np.where(step != 0, np.arange(end - a), end - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        is_s[a:end] = np.append(step > 0, following)[at]
        following = bool(is_s[a])
    return is_s


def star_positions(is_s: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of type S after one of type L."""
    found = lambda c: np.flatnonzero(is_s[c.start + 1 : c.stop + 1] & ~is_s[c.start : min(c.stop, len(is_s) - 1)]) + c.start + 1
    stars, at = scratch.array(sum(len(found(c)) for c in chunks(len(is_s)))), 0
    for c in chunks(len(is_s)):
        part = found(c)
        stars[at : at + len(part)] = part
        at += len(part)
    return stars


def changes_after(text: np.ndarray, at: np.ndarray, scratch: Scratch) -> np.ndarray:
    """For each of the ascending positions ``at``, the first later one whose symbol differs from its own."""
    out, following, right = scratch.array(len(at)), len(text), len(at)
    for end in range(len(text), 0, -CHUNK):
        a = max(0, end - CHUNK)
        piece = text[a : end + 1]
        change = np.flatnonzero(piece[1:] != piece[:-1]) + a + 1
        left = int(np.searchsorted(at, a))
        out[left:right] = np.append(change, following)[np.searchsorted(change, at[left:right], side="right")]
        right, following = left, int(change[0]) if len(change) else following
    return out


def run_length(text: np.ndarray, i: int) -> int:
    n, j = len(text), i + 1
    while j < n and text[j] == text[i]:
        j += 1
    return j - i


class Range:
    """Least value of a range of an array, for many ranges at once: minima up to and from each place of a block, and of 2^k blocks."""

    BLOCK = 32

    def __init__(self, values: np.ndarray, scratch: Scratch) -> None:
        n, size = len(values), self.BLOCK
        whole = -(-n // size) * size
        self.values, self.up, self.down = values, scratch.array(whole), scratch.array(whole)
        lows = np.empty(whole // size, np.int64)
        step = max(size, CHUNK // size * size)
        for i in range(0, whole, step):
            part = np.zeros(min(step, whole - i), np.int64)
            part[: n - i] = values[i : i + step]
            part[max(n - i, 0) :] = np.iinfo(np.int64).max
            grid = part.reshape(-1, size)
            self.down[i : i + len(part)] = np.minimum.accumulate(grid, axis=1).ravel()
            self.up[i : i + len(part)] = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            lows[i // size : (i + len(part)) // size] = grid.min(axis=1)
        self.levels = [lows]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            v, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-w], v[w:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum over a..b, both included, a <= b."""
        first, last = a // self.BLOCK, b // self.BLOCK
        out = np.minimum(self.up[a], self.down[b])
        near = np.flatnonzero(first == last)
        low = np.array(self.values[a[near]])
        for k in range(1, self.BLOCK):
            low = np.minimum(low, self.values[np.minimum(a[near] + k, b[near])])
        out[near] = low
        far = np.flatnonzero(last - first > 1)
        level = np.frexp((last[far] - first[far] - 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at, v = far[level == k], self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(v[first[at] + 1], v[last[at] - (1 << int(k))]))
        return out


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a small string of names and common prefixes of neighbours, both exact up to ``depth`` names."""
    m = len(names)
    ranks, width = [np.unique(names, return_inverse=True)[1].astype(np.int32)], 1
    while width < depth and ranks[-1].max() < m - 1:
        rank = ranks[-1].astype(np.int64)
        key = rank * (m + 1)
        key[:-width or m] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(m, np.int32)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks.append(new)
        width *= 2
        if width >= m:
            break
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(m, np.int64)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common[1:], b + common[1:]
        inside = (x < m) & (y < m)
        same = inside & (ranks[k][np.minimum(x, m - 1)] == ranks[k][np.minimum(y, m - 1)])
        common[1:] += same.astype(np.int64) << k
    return order, common


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of (key, value) as one, block by block."""
    at = [0] * len(runs)
    while runs:
        heads = [key[i : i + block] for (key, _), i in zip(runs, at, strict=True)]
        limit = min(h[-1] for h in heads)
        taken = [int(np.searchsorted(h, limit, side="right")) for h in heads]
        key = np.concatenate([h[:k] for h, k in zip(heads, taken, strict=True)])
        value = np.concatenate([v[i : i + k] for (_, v), i, k in zip(runs, at, taken, strict=True)])
        order = np.argsort(key, kind="stable")
        yield key[order], value[order]
        left = [j for j, (key, _) in enumerate(runs) if at[j] + taken[j] < len(key)]
        at = [at[j] + taken[j] for j in left]
        runs = [runs[j] for j in left]


def sorted_records(parts: Iterator[tuple[np.ndarray, np.ndarray]], n: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """External merge sort of ``n`` records (key, value): sorted runs within the budget, merged WAYS at a time."""
    room, keys, values, done = max(scratch.memory // 32, 1024), scratch.array(n, np.uint64), scratch.array(n), 0
    for key, value in parts:
        keys[done : done + len(key)], values[done : done + len(key)] = key, value
        done += len(key)
    runs = []
    for i in range(0, n, room):
        key, value = keys[i : i + room], values[i : i + room]
        order = np.argsort(key, kind="stable")
        key[:], value[:] = key[order], value[order]
        runs.append((key, value))
    block = max(room // WAYS, 256)
    while len(runs) > WAYS:
        fewer = []
        for i in range(0, len(runs), WAYS):
            size, done = sum(len(key) for key, _ in runs[i : i + WAYS]), 0
            keys, values = scratch.array(size, np.uint64), scratch.array(size)
            for key, value in merged_runs(runs[i : i + WAYS], block):
                keys[done : done + len(key)], values[done : done + len(key)] = key, value
                done += len(key)
            fewer.append((keys, values))
        runs = fewer
    return merged_runs(runs, block)


def agreeing(text: np.ndarray, a: int, b: int, n: int) -> int:
    """Number of equal symbols from positions a and b on, at most n."""
    done, step = 0, 64
    while done < n:
        k = min(step, n - done)
        differ = np.flatnonzero(text[a + done : a + done + k] != text[b + done : b + done + k])
        if len(differ):
            return done + int(differ[0])
        done, step = done + k, min(2 * step, CHUNK)
    return n


class Stars:
    """Substrings from each star position to the next.

    A substring runs on to the first symbol that differs from the next star's, without that symbol's
    type: so any two different substrings differ in a symbol, and not in a type alone.
    """

    def __init__(self, text: np.ndarray, is_s: np.ndarray, scratch: Scratch) -> None:
        self.text, self.is_s, self.scratch = text, is_s, scratch
        self.at = star_positions(is_s, scratch)
        m = len(self.at)
        change = changes_after(text, self.at, scratch)
        self.size = scratch.array(m)  # symbols, the last one included
        for c in chunks(m):
            following = np.minimum(np.arange(c.start, c.stop) + 1, m - 1)
            self.size[c] = np.minimum(change[following], len(text) - 1) - self.at[c] + 1

    def word(self, i: np.ndarray, skip: int, per: int, bits: int) -> np.ndarray:
        """``per`` codes of the substrings ``i`` behind the first ``skip``: symbol and type plus one, zero behind the end."""
        start, size, out = self.at[i], self.size[i], np.zeros(len(i), np.uint64)
        for k in range(skip, skip + per):
            place = np.minimum(start + k, len(self.text) - 1)
            code = self.text[place].astype(np.int64) * 2 + (self.is_s[place] & (k < size - 1)) + 1
            out = (out << np.uint64(bits)) | np.where(k < size, code, 0).astype(np.uint64)
        return out

    def compare(self, i: int, j: int) -> int:
        a, b, m, n = int(self.at[i]), int(self.at[j]), int(self.size[i]), int(self.size[j])
        k = min(agreeing(self.text, a, b, min(m, n)), agreeing(self.is_s, a, b, min(m, n) - 1))
        code = lambda start, size: 0 if k >= size else int(self.text[start + k]) * 2 + bool(self.is_s[start + k] and k < size - 1) + 1
        x, y = code(a, m), code(b, n)
        return (x > y) - (x < y)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the substrings, in order, and common prefixes of neighbouring names.

        Substrings are told apart by a few symbols at a time: a group of equals so far is a range of
        ranks, and each round sorts the members of groups by (group, next symbols).
        """
        m, scratch = len(self.at), self.scratch
        bits = (2 * max(int(self.text[c].max()) for c in chunks(len(self.text))) + 2).bit_length()
        per = max(1, (64 - m.bit_length()) // bits)
        if m.bit_length() + bits > 64:
            raise ValueError("a shard of over two billion symbols")
        group, active = scratch.array(m), scratch.array(m)
        for c in chunks(m):
            active[c] = np.arange(c.start, c.stop)
        shift = np.uint64(bits * per)
        for round_ in range(NAME_ROUNDS):
            parts = ((group[i].astype(np.uint64) << shift) | self.word(i, round_ * per, per, bits) for i in (active[c] for c in chunks(len(active))))
            index = (active[c] for c in chunks(len(active)))
            kept, n_kept = scratch.array(len(active)), 0
            before, own, base, rank = None, None, 0, 0  # the last key, its old group and new rank, and how many records of that group came
            for key, value in sorted_records(zip(parts, index, strict=True), len(active), scratch):
                of = (key >> shift).astype(np.int64)
                new_group = np.r_[own is None or of[0] != own, of[1:] != of[:-1]]
                new_key = np.r_[before is None or key[0] != before, key[1:] != key[:-1]]
                at = np.arange(len(key))
                begun = np.maximum.accumulate(np.where(new_group, at, -rank))
                first = np.maximum.accumulate(np.where(new_key, at, -1))
                now = np.where(first >= 0, of + first - begun, base)
                group[value] = now
                alone = new_key & np.append(new_key[1:], False)  # at a block's end it may have equals: the next round tells
                chosen = value[~alone & (self.size[value] > (round_ + 1) * per)]
                kept[n_kept : n_kept + len(chosen)] = chosen
                n_kept += len(chosen)
                before, own, base, rank = key[-1], int(of[-1]), int(now[-1]), int(len(key) - begun[-1])
            active = kept[:n_kept]
            if not n_kept:
                break
        if len(active):  # long substrings, few of them
            rest = sorted(active.tolist(), key=lambda i: int(group[i]))
            begin = 0
            while begin < len(rest):
                own, end = int(group[rest[begin]]), begin
                while end < len(rest) and group[rest[end]] == own:
                    end += 1
                run = sorted(rest[begin:end], key=cmp_to_key(self.compare))
                base = own
                for k, i in enumerate(run):
                    if k and self.compare(run[k - 1], i):
                        base = own + k
                    group[i] = base
                begin = end
        used, number, total = scratch.array(m, bool), scratch.array(m), 0
        for c in chunks(m):
            used[group[c]] = True
        for c in chunks(m):
            number[c] = total + np.cumsum(used[c]) - 1
            total = int(number[c.stop - 1]) + 1
        one, common = scratch.array(total), scratch.array(total)
        for c in chunks(m):
            group[c] = number[group[c]]
            one[group[c]] = np.arange(c.start, c.stop)
        for c in chunks(total - 1):
            a, b = one[c], one[c.start + 1 : c.stop + 1]
            limit, k, live = np.minimum(self.size[a], self.size[b]), np.zeros(len(a), np.int64), np.arange(len(a))
            a, b = self.at[a], self.at[b]
            for _ in range(64):
                live = live[k[live] < limit[live]]
                live = live[self.text[a[live] + k[live]] == self.text[b[live] + k[live]]]
                k[live] += 1
            for i in live.tolist():
                k[i] += agreeing(self.text, int(a[i] + k[i]), int(b[i] + k[i]), int(limit[i] - k[i]))
            common[c.start + 1 : c.stop + 1] = k
        return group, common


def sorted_stars(text: np.ndarray, is_s: np.ndarray, depth: int, scratch: Scratch, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Star positions in suffix order, and common prefixes of neighbours (exact below ``depth``)."""
    found = Stars(text, is_s, scratch)
    stars, m = found.at, len(found.at)
    names, name_common = found.names()
    del found
    if len(name_common) == m:
        order, common = scratch.array(m), scratch.array(m)
        for c in chunks(m):
            order[names[c]] = np.arange(c.start, c.stop)
    elif m <= small:
        order, common = doubled(names, depth)
    else:
        order, common = recursive_order(names, depth, scratch, small)
    position, prefix, lows = scratch.array(m), scratch.array(m), Range(name_common, scratch)
    for c in chunks(m):
        position[c] = stars[order[c]]
    for c in chunks(m - 1):
        after = slice(c.start + 1, c.stop + 1)
        a, b = order[c] + common[after], order[after] + common[after]
        x, y = names[np.minimum(a, m - 1)], names[np.minimum(b, m - 1)]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        differ = (a < m) & (b < m) & (low <= high)
        more = np.zeros(len(a), np.int64)
        more[differ] = lows.least(low[differ], high[differ])
        prefix[after] = stars[np.minimum(b, m - 1)] - stars[order[after]] + more
    return position, prefix


def recursive_order(text: np.ndarray, depth: int, scratch: Scratch, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of names and common prefixes of neighbours; every symbol up to the largest occurs.

    A symbol's bucket is a stretch of the order, first its L and then its S suffixes.  ``lows`` and
    ``ats`` hold the records of the scan that are less than all later ones, so the least value since a
    symbol was last handed a record is found by bisection.
    """
    scratch.levels += 1
    n = len(text)
    is_s = types(text, scratch)
    stars, prefix = sorted_stars(text, is_s, depth, scratch, small)
    symbols = max(int(text[c].max()) for c in chunks(n)) + 1
    start, star_at = scratch.array(symbols + 1), scratch.array(symbols + 1)
    for c in chunks(n):
        np.add.at(start, text[c] + 1, 1)
    for c in chunks(len(stars)):
        np.add.at(star_at, text[stars[c]] + 1, 1)
    for counts in (start, star_at):
        total = 0
        for c in chunks(symbols + 1):
            counts[c] = total + np.cumsum(counts[c])
            total = int(counts[c.stop - 1])
    order, common, head, last = scratch.array(n), scratch.array(n + 1), scratch.array(symbols), scratch.array(symbols)
    tail = scratch.array(symbols)
    for c in chunks(symbols):
        head[c], tail[c] = start[c], start[c.start + 1 : c.stop + 1] - 1  # the next free slots
    last[:] = -1
    out = order, common
    order, common, head, tail, last, start, star_at, stars, prefix, text, is_s = map(memoryview, (order, common, head, tail, last, start, star_at, stars, prefix, text, is_s))
    order[0], tail[0] = n - 1, -1  # the sentinel

    def upwards() -> Iterator[tuple[int, int]]:
        for c in range(symbols):
            i = start[c]
            while i < head[c]:
                yield order[i], common[i]
                i += 1
            for k in range(star_at[c], star_at[c + 1]):
                if k > star_at[c]:
                    yield stars[k], prefix[k]
                else:
                    yield stars[k], min(run_length(text, order[i - 1]), run_length(text, stars[k])) if i > start[c] else 0

    def downwards() -> Iterator[tuple[int, int]]:
        for c in range(symbols - 1, -1, -1):
            i, stop = start[c + 1] - 1, start[c + 1]
            while i > tail[c]:
                yield order[i], common[i + 1] if i + 1 < stop else 0
                i -= 1
            if start[c] <= i < stop - 1:
                common[i + 1] = min(run_length(text, order[i]), run_length(text, order[i + 1]))
            while i >= start[c]:
                yield order[i], common[i + 1] if i + 1 < stop else 0
                i -= 1

    def hand_on(records: Iterator[tuple[int, int]], up: bool) -> None:
        ats: list[int] = []
        lows: list[int] = []
        for t, (position, low) in enumerate(records):
            while lows and lows[-1] >= low:
                lows.pop()
                ats.pop()
            lows.append(low)
            ats.append(t)
            if position and is_s[position - 1] != up:
                s = text[position - 1]
                since = last[s]
                if up:
                    slot = place = head[s]
                    head[s] += 1
                else:
                    slot = tail[s]
                    place = slot + 1
                    tail[s] -= 1
                order[slot] = position - 1
                if since >= 0:
                    common[place] = 1 + lows[bisect_right(ats, since)]
                last[s] = t

    hand_on(upwards(), True)
    for c in range(symbols):
        last[c] = -1
    hand_on(downwards(), False)
    for c in range(symbols):
        common[start[c]] = 0
    return out[0], out[1][:n]


class Induction:
    """Both scans over one string of symbols under 2^16; yields buckets downwards."""

    def __init__(self, text: np.ndarray, scratch: Scratch) -> None:
        self.text, self.scratch = text, scratch

    def _hand_on(self, position: np.ndarray, prefix: np.ndarray, chosen: np.ndarray, queues: dict[int, DiskQueue], since: dict[int, int]) -> None:
        """Push the predecessors of the chosen records to their queues.

        since: by queue, the least common prefix since the last record handed to it from this bucket.
        """
        at = np.flatnonzero(chosen)
        least = int(prefix.min()) if len(prefix) else 0
        if len(at):
            symbol = self.text[position[at] - 1]
            order = np.argsort(symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            new = np.r_[True, symbol[1:] != symbol[:-1]]
            start = np.where(new, 0, np.r_[0, at[:-1] + 1])
            pairs = np.empty(2 * len(at), np.int64)
            pairs[::2], pairs[1::2] = start, at + 1
            value = np.minimum.reduceat(np.append(prefix, np.iinfo(np.int64).max), pairs)[::2] + 1
            firsts = np.flatnonzero(new)
            lasts = np.append(firsts[1:], len(at))
            seen = set()
            for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True):
                s = int(symbol[i])
                seen.add(s)
                value[i] = min(int(value[i]), since[s] + 1) if s in since else 1
                if s not in queues:
                    queues[s] = DiskQueue(self.scratch)
                queues[s].push(position[at[i:j]] - 1, value[i:j])
                rest = prefix[at[j - 1] + 1 :]
                since[s] = int(rest.min()) if len(rest) else np.iinfo(np.int64).max - 1
            for s in since:
                if s not in seen:
                    since[s] = min(since[s], least)
        else:
            for s in since:
                since[s] = min(since[s], least)

    def _rounds(self, symbol: int, first: DiskQueue | None, queues: dict[int, DiskQueue], since: dict[int, int], up: bool) -> tuple[DiskQueue, int]:
        """Work off a bucket: records whose predecessor has the same symbol make the next round.  All records, and the number of rounds."""
        done, now, rounds, text = DiskQueue(self.scratch), first, 0, self.text
        while now is not None and now.size:
            rounds += 1
            following, own, head = DiskQueue(self.scratch), {}, True
            for position, prefix in now.read():
                prefix = prefix.copy()
                if head:
                    prefix[0] = rounds - 1 if rounds > 1 else 0
                    head = False
                done.push(position, prefix)
                before = text[np.maximum(position - 1, 0)]
                some = position > 0
                self._hand_on(position, prefix, some & ((before > symbol) if up else (before < symbol)), queues, since)
                self._hand_on(position, prefix, some & (before == symbol), own_queue := {symbol: following}, own)
                following = own_queue[symbol]
            now.drop()
            now = following
        return done, rounds

    def buckets(self, stars: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[DiskQueue, DiskQueue, int]]:
        """(S records downwards, L records upwards, common prefix where they meet) by symbol, from the largest."""
        text = self.text
        seen = sum(np.bincount(text[c], minlength=1 << 16) for c in chunks(len(text)))
        ends = np.cumsum(sum(np.bincount(text[stars[c]], minlength=len(seen)) for c in chunks(len(stars))))
        symbols = np.flatnonzero(seen).tolist()
        of_symbol = {s: (int(ends[s - 1]) if s else 0, int(ends[s])) for s in symbols}
        large: dict[int, DiskQueue] = {}
        large_done: dict[int, tuple[DiskQueue, int]] = {}
        for s in symbols:
            since: dict[int, int] = {}
            done, rounds = self._rounds(s, large.pop(s, None), large, since, up=True)
            large_done[s] = done, rounds
            a, b = of_symbol[s]
            for i in range(a, b, CHUNK):
                position, value = np.array(stars[i : min(b, i + CHUNK)]), np.array(prefix[i : min(b, i + CHUNK)])
                if i == a:
                    value[0] = min(rounds, run_length(text, int(position[0]))) if rounds else 0
                self._hand_on(position, value, position > 0, large, since)
        small: dict[int, DiskQueue] = {}
        for s in reversed(symbols):
            since = {}
            done, rounds = self._rounds(s, small.pop(s, None), small, since, up=False)
            lower, lower_rounds = large_done.pop(s)
            meet = min(rounds, lower_rounds) if rounds and lower_rounds else 0
            head = True
            for position, value in lower.read_back():
                if head:
                    value[0] = meet
                    head = False
                self._hand_on(position, value, (position > 0) & (text[np.maximum(position - 1, 0)] < s), small, since)
            yield done, lower, meet
            done.drop()
            lower.drop()


def suffix_order(text: np.ndarray, depth: int, memory: int = 1 << 20, small: int = 1 << 10) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order and common prefixes of neighbours; the last symbol is a unique smallest one."""
    n = len(text)
    scratch = Scratch(memory)
    try:
        stars, prefix = sorted_stars(text, types(text, scratch), depth, scratch, small)
        order, common, end = np.empty(n, np.int64), np.zeros(n, np.int64), n
        for upper, lower, meet in Induction(text, scratch).buckets(stars, prefix):
            for position, value in upper.read():
                k = len(position)
                order[end - k : end] = position[::-1]
                # a value belongs to a record and the one before it in this downward list: the next one upwards
                slots = np.arange(end - 1, end - 1 - k, -1) + 1
                common[slots[slots < n]] = value[slots < n]
                end -= k
            for position, value in lower.read_back():
                k = len(position)
                order[end - k : end] = position[::-1]
                slots = np.arange(end - 1, end - 1 - k, -1) + 1
                common[slots[slots < n]] = value[slots < n]
                if lower.size and k and end < n and order[end - 1] == lower.last[0]:
                    common[end] = meet
                end -= k
        order[0] = n - 1
        common[0] = 0
        common[1] = 0
        return order, common
    finally:
        scratch.close()


def repeated_starts(text: np.ndarray, length: int, memory: int = 1 << 20, small: int = 1 << 10) -> np.ndarray:
    """True at the positions whose next ``length`` symbols occur at another position too."""
    scratch = Scratch(memory)
    try:
        hit = scratch.array(len(text), bool)
        stars, prefix = sorted_stars(text, types(text, scratch), length, scratch, small)
        for upper, lower, meet in Induction(text, scratch).buckets(stars, prefix):
            for records, edge in ((upper.read(), 0), (lower.read_back(), meet)):
                before = None
                for position, value in records:
                    same = value >= length
                    if before is None:
                        same = same.copy()
                        same[0] = edge >= length
                        before = last if edge >= length else position[0]
                    hit[position[same]] = True
                    hit[np.concatenate([[before], position[:-1]])[same]] = True
                    before = position[-1]
                last = before if before is not None else 0
        return np.array(hit)
    finally:
        scratch.close()
