"""Sharding by proportional stratified interleaving: every shard gets the mixture of the sources.

Rows are shuffled within their source by a seeded hash and ranked there; a row's place is its fractional
rank, (rank + offset) / rows of the source, with one seeded offset in (0, 1) for each source, so that
sources of one row spread, too.  Rows sorted by place are cut into shards whose counts differ by one at
most.  A stretch of places holds the same share of every source, so each shard does (to within two
rows a source).

No window holds a source or the table.  A row's rank is the number of its source's rows in lower
hash buckets plus its number in its own bucket; its position is the number of rows in lower bins of
place plus its number in its own bin.  Buckets and bins are as many as the table needs to keep each to
about ``rows_per_bucket`` rows; their counts are aggregated before they are shuffled, and only counts
are summed up along buckets and bins.

Edge cases: a null source is a source of its own, beside the empty one; a null text has no bytes, so its
size is 1; a null doc_id is a value like any other; rows that agree in all key columns are ties and take
neighbouring ranks in any order, which gives equal results since they are alike; very long texts are
read for their size alone; an empty table gives an empty table; no column but those named is read by
positions(), whatever the others' names, while shards() hands all of them on and replaces columns
named shard and slot.  Copies of a text under other ids are rows of their own and spread like all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class InterleaveParams:
    """``rows_per_bucket``: wanted rows of a window; at least ``least_buckets`` buckets are made, so that small tables spread as well."""

    shards: int = 16
    seed: int = 11
    rows_per_bucket: int = 20_000
    least_buckets: int = 2048


def _buckets(n: int, p: InterleaveParams) -> int:
    return max(p.least_buckets, -(-n // p.rows_per_bucket))


def _unit(seed: int, *columns: Column) -> Column:
    """A seeded hash as a number in [0, 1): 52 bits, exact in a double."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12) / F.lit(float(1 << 52))


def _sums_before(counts: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over all lower ``order``: windows over counts, one row a bucket."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(rows: DataFrame, stratum: str, key: list[str], p: InterleaveParams = InterleaveParams()) -> DataFrame:
    """(row, shard, slot): every row of ``rows`` as a struct, with its shard and its number there, from 0.

    ``stratum``: column whose mixture every shard keeps.  ``key``: columns that tell rows apart; they
    decide the seeded order.
    """
    total = rows.count()
    buckets = _buckets(total, p)
    told = F.coalesce(F.concat(F.lit("="), F.col(f"row.{stratum}").cast("string")), F.lit(""))  # null apart from empty
    keyed = rows.select(F.struct(*rows.columns).alias("row")).withColumn("stratum", told)
    keyed = keyed.withColumn("draw", _unit(p.seed, *(F.col(f"row.{c}") for c in key))).withColumn("bucket", F.floor(F.col("draw") * buckets))

    counts = keyed.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lower = _sums_before(counts, ["stratum"], "bucket", "before")
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("size"))
    lower = lower.join(sizes, "stratum").select("stratum", "bucket", "before", "size")
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    rest = F.xxhash64(*(F.col(f"row.{c}") for c in plain))  # so that a task that runs again orders rows of one key alike
    inside = Window.partitionBy("stratum", "bucket").orderBy("draw", *(f"row.{c}" for c in key), rest)
    ranked = keyed.withColumn("number", F.row_number().over(inside)).join(lower, ["stratum", "bucket"])
    rank = F.col("before") + F.col("number") - 1
    place = (rank + _unit(p.seed + 1, F.col("stratum"))) / F.col("size")
    placed = ranked.select("row", "stratum", "draw", place.alias("place")).withColumn("bin", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)))

    bins = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    below = _sums_before(bins, [], "bin", "below").select("bin", "below")
    along = Window.partitionBy("bin").orderBy("place", "stratum", "draw")
    at = placed.withColumn("number", F.row_number().over(along)).join(below, "bin").select("row", (F.col("below") + F.col("number") - 1).alias("position"))
    shard = F.floor(F.col("position") * p.shards / max(total, 1))
    start = F.ceil(F.col("shard") * total / p.shards)
    return at.withColumn("shard", shard.cast("int")).select("row", "shard", (F.col("position") - start).cast("long").alias("slot"))


def shards(docs: DataFrame, stratum: str = "source", p: InterleaveParams = InterleaveParams()) -> DataFrame:
    """The rows of ``docs`` with all their columns, and shard and slot."""
    found = interleave(docs, stratum, ["doc_id", "text"], p)
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def write_shards(docs: DataFrame, path: str, stratum: str = "source", p: InterleaveParams = InterleaveParams()) -> None:
    """Write one folder a shard, its rows sorted by slot within each file; files of a shard hold consecutive slots."""
    out = shards(docs, stratum, p)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def positions(docs: DataFrame, p: InterleaveParams = InterleaveParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source for every row of ``docs``; texts are not shuffled."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "source")
    found = interleave(rows, "source", ["doc_id", "text_crc32", "size"], p)
    return found.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row.source")
