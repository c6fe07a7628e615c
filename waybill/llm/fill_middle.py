"""Fill-in-the-middle documents, cut on token bounds by way of a sparse exception index.

A text is held as UTF-8 bytes.  Most of them are ASCII, where a code point is a byte, so only the
exceptions are recorded: the code-point and byte positions of multibyte characters and the bytes each
has in excess of one, summed up.  A cut in code points becomes a cut in bytes, and the other way
round, by one binary search for the exceptions before it; between exceptions it is plain arithmetic.
Tokens (runs of ASCII letters, any other code point alone) are found on the bytes at once with numpy.

Two hashes of the document's id choose the cuts, a third whether it is transformed at all, a fourth the
order of its parts.  restored() rebuilds the text from output and form with column functions alone.

Edge cases: null and empty texts, and texts that hold a sentinel, stay plain; a null doc_id hashes as an
empty number; repeated rows give equal results; very long texts go through whole, a few at a time; ties of
the two cuts give an empty middle; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import bounded_chunks, map_batches

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Characters of text that a task works on at once.
CHUNK_CHARS = 4_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes a character has in excess of one, by its first byte; no other byte counts.
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:0xF8] = 1, 2, 3


@dataclass(frozen=True)
class MiddleParams:
    """Per cent of documents transformed, of these per cent with the suffix first, and the text before the id that is hashed."""

    transformed: int = 90
    suffix_first: int = 20
    salt: str = "1:"


class ExceptionIndex:
    """Where the multibyte characters of one text are: their first bytes, their code points, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray) -> None:
        excess = _EXCESS[data]
        self.byte_at = np.flatnonzero(excess)
        self.excess = np.concatenate([[0], np.cumsum(excess[self.byte_at])])  # of all exceptions before the i-th
        self.char_at = self.byte_at - self.excess[:-1]

    def to_bytes(self, chars: np.ndarray | int) -> np.ndarray:
        """Byte offsets of code-point offsets."""
        return chars + self.excess[np.searchsorted(self.char_at, chars, "left")]

    def to_chars(self, offsets: np.ndarray | int) -> np.ndarray:
        """Code-point offsets of byte offsets, which must lie between characters."""
        return offsets - self.excess[np.searchsorted(self.byte_at, offsets, "left")]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens start: each character that does not go on a run of letters."""
    letter = _LETTER[data]
    inside = (data & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def draws(doc_id: int | None, salt: str) -> list[int]:
    """The first four 32-bit numbers of the id's SHA-256."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def transform(doc_id: int | None, text: str | None, p: MiddleParams) -> tuple:
    """n (tokens), form, prefix and middle in code points (None if plain), output."""
    text = text or ""
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    starts = token_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, p.salt)
    if not raw or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= p.transformed:
        return n, "plain", None, None, text
    bounds = np.append(starts, len(raw))
    index = ExceptionIndex(data)
    a, b = index.to_chars(np.sort(bounds[[h1 % (n + 1), h2 % (n + 1)]])).tolist()  # cuts in code points are what is reported
    x, y = index.to_bytes(np.array([a, b])).tolist()
    before, middle, after = raw[:x], raw[x:y], raw[y:]
    parts = (SUFFIX.encode(), after, PREFIX.encode(), before) if h4 % 100 < p.suffix_first else (PREFIX.encode(), before, SUFFIX.encode(), after)
    form = "spm" if h4 % 100 < p.suffix_first else "psm"
    return n, form, a, b - a, b"".join((*parts, MIDDLE.encode(), middle)).decode("utf-8")


def fill_middle(docs: DataFrame, p: MiddleParams = MiddleParams()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs``."""

    def make():
        def work(doc_id, text):
            found = []
            at = 0
            for part in bounded_chunks(text, CHUNK_CHARS):
                found += [transform(i, t, p) for i, t in zip(doc_id[at : at + len(part)], part, strict=True)]
                at += len(part)
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"doc_id": doc_id} | {name: [row[k] for row in found] for k, name in enumerate(names)}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again.  No part holds a sentinel, so each ends where the next one's first stands."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    before, after, middle = parts(PREFIX, SUFFIX)
    after2, before2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(before2, middle2, after2)).otherwise(output)


def middle_digests(docs: DataFrame, p: MiddleParams = MiddleParams()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = fill_middle(docs, p)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
