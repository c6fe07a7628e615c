"""Column expressions used by several operators; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.schemas import EARTH_M

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds (decimal), whatever the session's time zone."""
    gap = b - a
    part = lambda unit: F.extract(F.lit(unit), gap)
    return part("DAY").cast("long") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def epoch_seconds(ts: Column) -> Column:
    return seconds_between(F.expr(EPOCH), ts)


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970 without fractions, as a long, from the clock's own parts."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_ms(ts: Column) -> Column:
    return F.floor(epoch_seconds(ts) * 1000).cast("long")


def plus_seconds(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def haversine_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(half(lat0, lat) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * half(lon0, lon)))
