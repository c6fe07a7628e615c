"""Order MinHash fingerprints, in DataFrame functions only.

The k-mers of a text are its runs of ``k`` words, each numbered by how often it has occurred before,
so that a repeated k-mer counts as often as it stands.  The hash of (k-mer, number) puts it into one
of 64 bins; the two least of a bin are kept, put back into their order in the text, and hashed as a
tuple.  Moving text about changes the tuples though it keeps the k-mers, which makes the share of
equal tuples follow edit distance.

The occurrence numbers come from one sort of the k-mers with their places, and the bins from one sort
of the numbered hashes; each step is a column of its own, linear in the text or a sort of it.

The document that comes next by descending doc_id is found in buckets of the id's quantiles: a window
in each bucket, with the first row of the bucket below added to its end.  A doc_id that fills several
buckets by itself is split by a hash of the text.  No task holds all rows, and the one window over all
buckets sees their numbers alone, no text.

Edge cases: null counts as empty text; texts of fewer than ``k`` words are one k-mer; very long texts
count whole, up to 2^28 words; equal texts have equal fingerprints and likeness 1, empty ones included;
rows with one doc_id follow each other by a hash of the text, then the text, and a null doc_id comes
last; a table of one row is its own next document; an empty table gives an empty table; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a place in the text, and of a bin's number, in a 63-bit record.
PLACE_BITS, BIN_BITS = 28, 6
PLACE_MASK = (1 << PLACE_BITS) - 1
BIN_SHIFT = 63 - BIN_BITS


@dataclass(frozen=True)
class OrderParams:
    """``rows``: documents a bucket, while ``buckets`` buckets are enough."""

    k: int = 3
    rows: int = 2_000
    buckets: int = 50_000


def with_fingerprint(df: DataFrame, text: str, out: str, p: OrderParams) -> DataFrame:
    """Add ``out``: one 64-bit number a filled bin, its number above a 32-bit tuple hash, by bin."""
    upper = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(PLACE_MASK)).cast("int")
    bin_ = lambda x: F.shiftright(x, BIN_SHIFT)
    indexes = lambda c: F.sequence(F.lit(0), F.size(c) - 1)
    df = df.withColumn("w_", F.transform(F.split(F.translate(text, "\t\n\r\f", "    "), " "), lambda w: F.xxhash64(w)))
    last = F.greatest(F.size("w_") - p.k + 1, F.lit(1))
    df = df.withColumn("k_", F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("w_", i, p.k)))).drop("w_")
    df = df.withColumn("s_", F.sort_array(F.transform("k_", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))))
    df = df.withColumn("r_", F.filter(indexes("s_"), lambda i: (i == 0) | (upper(F.get("s_", i)) != upper(F.get("s_", i - 1)))))

    def numbered(i: Column, start: Column) -> Column:
        record = F.get("s_", i)
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(upper(record), i - start), PLACE_BITS + 1), PLACE_BITS).bitwiseOR(record.bitwiseAND(F.lit(PLACE_MASK)))

    runs = F.transform("r_", lambda s, j: F.transform(F.sequence(s, F.coalesce(F.get("r_", j + 1), F.size("s_")) - 1), lambda i: numbered(i, s)))
    df = df.withColumn("v_", F.sort_array(F.flatten(runs))).drop("s_", "r_")
    df = df.withColumn("m_", F.filter("v_", lambda x, i: (i < 2) | (bin_(F.get("v_", i - 2)) != bin_(x)))).drop("v_")
    df = df.withColumn("f_", F.filter(indexes("m_"), lambda i: (i == 0) | (bin_(F.get("m_", i)) != bin_(F.get("m_", i - 1)))))

    def tuple_(i: Column) -> Column:
        a, b = F.get("m_", i), F.get("m_", i + 1)
        one = place(a)
        two = F.when(bin_(b) == bin_(a), place(b)).otherwise(one)
        both = F.xxhash64(F.get("k_", F.least(one, two)), F.get("k_", F.greatest(one, two)), one == two)
        return F.shiftleft(bin_(a), 32).bitwiseOR(F.shiftrightunsigned(both, 32))

    return df.withColumn(out, F.transform("f_", tuple_)).drop("k_", "m_", "f_")


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples over bins filled in either fingerprint."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below the key, by binary search in the literal list."""
    if not cuts:
        return F.lit(0)
    known = F.array(*map(F.lit, cuts))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.get(known, mid) <= key
        done = acc["lo"] >= acc["hi"]
        return F.when(done, acc).when(right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve)["lo"]


def bucketed(docs: DataFrame, p: OrderParams) -> DataFrame:
    """Rows (key, text, ...) with their bucket, ascending by key, and part: stretches of the text's hash where one key fills several buckets."""
    n = docs.count()
    buckets = min(p.buckets, -(-n // p.rows))
    raw: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        raw = sorted(docs.agg(F.percentile_approx("key", shares, max(10_000, 10 * buckets))).first()[0])
    hot = {k: raw.count(k) + 1 for k, after in zip(raw, raw[1:], strict=False) if k == after}
    cuts = sorted(set(raw) | {k + 1 for k in hot if k < (1 << 63) - 1})
    rows = docs.withColumn("bucket", bucket_of(F.col("key"), cuts)).withColumn("hash", F.xxhash64("text"))
    parts = F.lit(1)
    for k, m in hot.items():  # at most half as many as there are buckets, and few in any table
        parts = F.when(F.col("key") == k, m).otherwise(parts)
    return rows.withColumn("part", F.floor(F.shiftrightunsigned("hash", 1) / F.lit(float(1 << 63)) * parts).cast("int"))


def with_next(docs: DataFrame, p: OrderParams) -> DataFrame:
    """Rows (key, text, ...) with ``own``, the text's fingerprint, and ``next_text``, ``next_own`` of the next document.

    Next is by descending key (no nulls), then hash, then text; after the last comes the first.
    """
    rows = bucketed(docs, p)
    place = ["bucket", "part"]
    first = F.struct(-F.col("key").cast("decimal(20,0)"), "hash", "text")
    heads = rows.groupBy(*place).agg(F.min_by("text", first).alias("text"))
    order = Window.orderBy(F.desc("bucket"), "part")  # numbers only, one row a bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = heads.select(*place)
    below = below.select(*place, F.coalesce(F.lead(F.struct(*place)).over(order), F.first(F.struct(*place)).over(whole)).alias("b")).select(*place, F.col("b.bucket").alias("bucket_b"), F.col("b.part").alias("part_b"))
    named = heads.select(F.col("bucket").alias("bucket_b"), F.col("part").alias("part_b"), "text")
    ends = below.join(named, ["bucket_b", "part_b"]).select(*place, "text", F.lit(1).alias("end"))
    together = with_fingerprint(rows.withColumn("end", F.lit(0)).unionByName(ends, allowMissingColumns=True), "text", "own", p)
    inside = Window.partitionBy(*place).orderBy("end", F.desc("key"), "hash", "text")
    together = together.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_own", F.lead("own").over(inside))
    return together.filter("end = 0").drop(*place, "hash", "end")


def fingerprints(docs: DataFrame, p: OrderParams = OrderParams()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, p)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "new", p)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
