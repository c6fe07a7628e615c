"""As-of join by slices of time: one union, one shuffle of the rows by key and slice; linear in both sides.

Each slice starts from the key's last reading of earlier slices, so a key with a long history is the work
of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators.scan import SLICE_SEC, earlier, folded, last_value, slice_of, sliced, within


def as_of(probes: DataFrame, readings: DataFrame, key: str, at: list[str], into: list[str], seconds: int = SLICE_SEC) -> DataFrame:
    """``probes`` with a struct (event_ts, value) for each column of ``at``: the key's last reading at or before it, or null.

    ``readings``: key, event_ts, value.  At one instant the reading counts.  A null probe means the newest
    reading.  All probes of a row go through the same union, so any number of columns costs one shuffle.
    Equal probe rows are one.
    """
    far = F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'")
    each = F.explode(F.array(*(F.struct(F.coalesce(F.col(c), far).alias("t"), F.lit(i).alias("which")) for i, c in enumerate(at)))).alias("e_")
    left = probes.select(F.col(key).alias("key_"), F.struct(*probes.columns).alias("probe_"), each).select("key_", "probe_", F.col("e_.t").alias("t_"), F.col("e_.which").alias("which_"))
    right = readings.select(F.col(key).alias("key_"), F.col("event_ts").alias("t_"), F.struct("event_ts", "value").alias("r_"), F.lit(-1).alias("which_"))
    both = sliced(left.unionByName(right, allowMissingColumns=True), slice_of("t_", seconds))
    brought = folded(both, ["key_"], end_=last_value(F.col("r_"), F.col("t_"))).withColumn("brought_", F.last("end_", ignorenulls=True).over(earlier(["key_"]))).drop("end_")
    w = within(["key_"], "t_", "which_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen_", F.last("r_", ignorenulls=True).over(w)).filter("which_ >= 0").join(brought, ["key_", "slice_"])
    seen = seen.withColumn("r_", F.coalesce("seen_", "brought_"))
    found = seen.groupBy("key_", "probe_").agg(*(F.max(F.when(F.col("which_") == i, F.col("r_"))).alias(name) for i, name in enumerate(into)))
    return found.select("probe_.*", *into)
