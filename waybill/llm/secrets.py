"""Secret scan: fixed patterns, and a battery of randomness tests over token-like runs.

Each run of 12 or more token characters with digits and letters is a candidate, whether or not a fixed
pattern touches it; padding may follow, and groups of four or more characters that dashes or
underscores join, most of them with digits, are judged without these.  A candidate's encoding is
inferred as the smallest known alphabet that holds it.  Three tests ask how likely ordinary text
(letters at natural rates, few changes between letters and digits, correlated neighbours) would
look this random at this length: chi-squared uniformity over the alphabet, the number of runs of
character classes, and lag-one serial correlation.  Fisher's method joins the three p-values; they
are weighted by length and held to a false-discovery rate over all candidates of the table
(Benjamini-Hochberg on a fixed-width histogram of log p, so the driver sees bins, never candidates).
What it accepts are spans of kind ``random``, beside the base spans even where they overlap.

Edge cases: null or empty text has no spans; ties in start are listed by kind; very long texts are
scanned whole, in time linear in their length; repeated rows each give a row, and each weighs in the
false-discovery rate; an empty table gives an empty table; extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import cut, map_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: A maximal run, as a greedy leftmost search finds it, is 16 long or it fails.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: The least length that is tested, and what a group of a joined token needs.
LEAST, GROUP = 12, 4

#: Alphabets from small to large; the first that holds a candidate is its encoding.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567="),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_="),
)
_SETS = [(name, frozenset(chars)) for name, chars in ALPHABETS]

#: Relative letter frequencies of English prose, per cent, a to z.
LETTER_RATES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Of ordinary text: share of digits, rate of changes between character classes, correlation of neighbours.
DIGIT_SHARE, CHANGE_RATE, CORRELATION = 0.12, 0.15, 0.4


@dataclass(frozen=True)
class SecretParams:
    """``rate``: false-discovery rate over all candidates of the table.  ``full_length``: length with weight one."""

    rate: float = 0.001
    full_length: int = 32


def infer_encoding(token: str) -> tuple[str, int] | None:
    chars = frozenset(token)
    return next(((name, len(known)) for name, known in _SETS if chars <= known), None)


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@lru_cache(maxsize=4096)
def _null_chi(length: int, size: int, letters: int) -> tuple[float, float]:
    """Mean and deviation of chi-squared against uniformity when the string is ordinary text."""
    total = sum(LETTER_RATES[:letters])
    p = [(1 - DIGIT_SHARE) * x / total for x in LETTER_RATES[:letters]] + [DIGIT_SHARE / 10] * 10
    s2, s3 = sum(x * x for x in p), sum(x**3 for x in p)
    n = length
    mean = size + size * (n - 1) * s2 - n
    var = 4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2
    return mean, size / n * math.sqrt(max(var, 1e-9))


@lru_cache(maxsize=65536)
def _upper_binomial(n: int, k: int, rate: float) -> float:
    """P(at least k of n); a normal tail where n is large."""
    if n > 400:
        return _phi((n * rate - k + 0.5) / math.sqrt(n * rate * (1 - rate)))
    return min(1.0, sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k, n + 1)))


def without_joints(token: str) -> str:
    """The token without the dashes or underscores that join its groups, if there are three groups and most have digits."""
    groups = re.split("[-_]", token)
    if len(groups) >= 3 and min(map(len, groups)) >= GROUP and 2 * sum(any(map(str.isdigit, g)) for g in groups) > len(groups):
        return "".join(groups)
    return token


def battery(token: str) -> tuple[str, float] | None:
    """Encoding and joint p-value against the hypothesis of ordinary text; None where no test applies."""
    token = without_joints(token.rstrip("="))
    n, found = len(token), infer_encoding(token)
    if found is None or n < LEAST:
        return None
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in token]
    if "d" not in kinds or not ({"u", "l"} & set(kinds)):
        return None
    encoding, size = found
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    chi = size / n * sum(v * v for v in counts.values()) - n
    mean, deviation = _null_chi(n, size, 6 if encoding in ("hex", "HEX") else 26)
    p_chi = _phi((chi - mean) / deviation)
    p_runs = _upper_binomial(n - 1, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), CHANGE_RATE)
    alphabet = next(chars for name, chars in ALPHABETS if name == encoding)
    values = [alphabet.index(c) for c in token]
    x, y = values[:-1], values[1:]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    vx, vy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    r = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(vx * vy) if vx and vy else 1.0
    p_serial = _phi((math.atanh(min(abs(r), 0.999999)) - math.atanh(CORRELATION)) * math.sqrt(n - 4))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return encoding, math.exp(-half) * (1 + half + half * half / 2)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, leftmost and non-overlapping by kind; matches that are too short are dropped."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def candidates(text: str, p: SecretParams) -> list[tuple[int, int, float]]:
    """start, end and weighted -log10 p of the runs to which the battery applies."""
    found = []
    for m in CANDIDATE.finditer(text):
        if not m[0].isalpha() and (got := battery(m[0])):
            weight = min(1.0, len(m[0]) / p.full_length)
            found.append((m.start(), m.end(), min(29.99, max(0.0, -math.log10(max(got[1], 1e-300)) + math.log10(weight)))))
    return found


BINS_PER_DECADE, DECADES = 10, 30


def discovery_cut(bins: list[tuple[int, int]], rate: float) -> float:
    """The least -log10 p that Benjamini-Hochberg accepts, from (bin, count) pairs; infinite where none is accepted.

    A bin is judged by its lower edge, so binning never accepts more than the exact procedure.
    """
    total, above, best = sum(n for _, n in bins), 0, math.inf
    for b, n in sorted(bins, reverse=True):
        above += n
        if 10 ** (-b / BINS_PER_DECADE) <= rate * above / total:
            best = b / BINS_PER_DECADE
    return best


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end), in order of start, then kind."""

    def make():
        def work(doc_id, text):
            base = [base_spans(t or "") for t in text]
            tried = [candidates(t or "", p) for t in text]
            order = [sorted(b, key=lambda s: (s[1], KINDS.index(s[0]))) for b in base]
            return {
                "doc_id": doc_id,
                "base": [[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in order],
                "tried": [[{"start": s, "end": e, "score": x} for s, e, x in t] for t in tried],
            }

        return work

    schema = "doc_id bigint, base array<struct<kind: string, start: int, end: int>>, tried array<struct<start: int, end: int, score: double>>"
    found = cut(map_batches(docs.select("doc_id", "text"), make, schema))
    bins = found.select(F.explode("tried").alias("t")).groupBy(F.floor(F.col("t.score") * BINS_PER_DECADE).alias("bin")).count().collect()
    least = discovery_cut([(int(b), int(n)) for b, n in bins], p.rate)
    accepted = F.filter("tried", lambda t: t["score"] >= F.lit(least)) if math.isfinite(least) else F.slice("tried", 1, 0)
    added = F.transform(accepted, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The plain form of base_sha256, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def secret_report(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(docs, p)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)), F.signum(rank(a) - rank(b)).cast("int")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("long").alias("n_random"))
