"""Scans over long histories, slice by slice.

A key's history may be longer than a task should sort.  It is cut into slices of time; each slice is
folded to a summary, the summaries of a key are composed in order (one row a slice), and each slice then
goes on from what came in.  No window over rows is longer than a slice.

Summaries are aggregated before they are shuffled.  They are a second read of the rows, so the rows
should be a scan or a written table; callers cut longer lineages first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.columns import whole_seconds

#: Length of a slice in seconds.
SLICE_SEC = 86_400


def slice_of(at: Column | str, seconds: int = SLICE_SEC) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(whole_seconds(at) / seconds)


def sliced(rows: DataFrame, slice_: Column) -> DataFrame:
    """``rows`` with ``slice_``."""
    return rows.withColumn("slice_", slice_)


def within(keys: list[str], *order: Column | str) -> Window:
    """The window of a slice."""
    return Window.partitionBy(*keys, "slice_").orderBy(*order)


def folded(rows: DataFrame, keys: list[str], **parts: Column) -> DataFrame:
    """A summary a slice."""
    return rows.groupBy(*keys, "slice_").agg(*(c.alias(name) for name, c in parts.items()))


def earlier(keys: list[str]) -> Window:
    """The slices of a key before this one."""
    return Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)


def next_to(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("slice_")


def last_value(value: Column, order: Column) -> Column:
    """The last value that is not null, as an aggregate."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def running_sum(rows: DataFrame, keys: list[str], at: str, value: Column, name: str, seconds: int = SLICE_SEC) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row."""
    cut = sliced(rows.withColumn("value_", value), slice_of(at, seconds))
    sums = folded(cut, keys, sum_=F.sum("value_")).withColumn("before_", F.sum("sum_").over(earlier(keys))).drop("sum_")
    inside = F.sum("value_").over(within(keys, at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = cut.withColumn("inside_", inside).join(sums, [*keys, "slice_"])
    return both.withColumn(name, F.coalesce("before_", F.lit(0)) + F.col("inside_")).select(*rows.columns, name)


def neighbours(rows: DataFrame, keys: list[str], at: str, seconds: int = SLICE_SEC) -> DataFrame:
    """``rows`` with prev_ts and next_ts, the times of the key's rows before and after."""
    cut = sliced(rows, slice_of(at, seconds))
    ends = folded(cut, keys, low_=F.min(at), high_=F.max(at))
    ends = ends.withColumn("prev_", F.lag("high_").over(next_to(keys))).withColumn("next_", F.lead("low_").over(next_to(keys))).drop("low_", "high_")
    w = within(keys, at)
    both = cut.withColumn("lag_", F.lag(at).over(w)).withColumn("lead_", F.lead(at).over(w)).join(ends, [*keys, "slice_"])
    return both.select(*rows.columns, F.coalesce("lag_", "prev_").alias("prev_ts"), F.coalesce("lead_", "next_").alias("next_ts"))
