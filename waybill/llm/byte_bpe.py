"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Each adjacent pair that is a token has a merge rank; the
positions of all pairs of one rank lie in that rank's bucket.  A two-level bitmap says which
buckets have entries, so the next rank is two find-first-set steps away, whatever the length of the
pre-token.  An entry whose pair has changed since it was filed is stale and is skipped.  The cost is
O(log n) a merge, so very long pre-tokens (a megabyte of one letter, a base64 blob) stay cheap.

Edge cases: null text encodes as empty text (no ids); of equal ranks the leftmost pair merges first;
repeated rows each give a row; an empty table gives an empty table; texts are encoded whole, whatever
their length; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from waybill.llm.common import map_batches

LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
#: Pre-tokens remembered by a worker; the memory is emptied when it is full.
CACHE_ENTRIES = 600_000
#: Longer pre-tokens are encoded each time they occur.
CACHE_BYTES = 64

_loaded: dict[str, tuple[dict[bytes, int], dict[int, bytes]]] = {}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """The token-to-rank table of a rank file and its inverse; one load a worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = ranks, {rank: token for token, rank in ranks.items()}
    return _loaded[path]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: lowest rank first, leftmost among equals.

    ``root`` has a bit for each group of 256 ranks that has entries, ``leaves`` the bits of a
    group's ranks, ``buckets`` the positions filed under a rank.
    """
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    following, before, filed = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    root, leaves, buckets = 0, {}, {}
    new = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    while True:
        for rank, i in new:
            filed[i] = rank
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                group = rank >> LEAF_BITS
                leaves[group] = leaves.get(group, 0) | 1 << (rank & LEAF_MASK)
                root |= 1 << group
        if not root:
            break
        group = (root & -root).bit_length() - 1  # find first set: the lowest group, then its lowest rank
        leaf = leaves[group]
        low = leaf & -leaf
        rank = group << LEAF_BITS | low.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            leaves[group] = leaf = leaf ^ low
            if not leaf:
                root &= root - 1
        new = []
        if filed[i] != rank:
            continue  # stale: the pair has changed or its left part is gone
        gone = following[i]
        end = following[gone]
        following[i], filed[gone], filed[i] = end, -1, -1
        if end < n:
            before[end] = i
            rank = rank_of(piece[i : following[end]])
            if rank is not None:
                new.append((rank, i))
        left = before[i]
        if left >= 0:
            filed[left] = -1
            rank = rank_of(piece[left:end])
            if rank is not None:
                new.append((rank, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : following[i]]])
        i = following[i]
    return tuple(ids)


class Codec:
    """Encodes whole texts, keeping the ids of short pre-tokens it has met."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks, self.tokens = load_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            got = known.get(piece)
            if got is None:
                raw = piece.encode("utf-8")
                got = encode_piece(raw, self.ranks)
                if len(raw) <= CACHE_BYTES:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary): each text encoded, and its ids decoded again."""

    def make():
        own = codec(path, pattern)

        def work(doc_id, text):
            ids = [own.encode(t or "") for t in text]
            return {"doc_id": doc_id, "ids": ids, "decoded": [own.decode(x) for x in ids]}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken where the ids are made, so ids and bytes never leave the task.
    """

    def make():
        own = codec(path, pattern)
        words = [str(i) for i in range(max(own.tokens) + 1)]

        def work(doc_id, text):
            ids = [own.encode(t or "") for t in text]
            return {
                "doc_id": doc_id,
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join([words[i] for i in x]).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
