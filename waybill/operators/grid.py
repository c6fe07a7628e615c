"""A grid of latitude and longitude over fences, so that fixes meet only the fences near them.

A fence is filed on the level whose cells are as wide as its reach, so it lies in nine cells at most;
a fix looks up its own cell on each level in use.  The join is by cell, so it needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.columns import haversine_m
from waybill.schemas import ACCURACY_GATE_M, EARTH_M

#: Cells of level m are 360 / 2^m degrees wide; the finest are some 600 m at the equator.
FINEST = 16
#: A block of fences is what one row of beside_each() is spread to.
BLOCK = 1_000
#: Farther from the edge than this, in metres, a usable fix is a decisive OUT whatever its accuracy.
CLEAR_M = 2 * ACCURACY_GATE_M + 1.0


def _turns(level: Column) -> Column:
    """Cells around the globe."""
    return F.pow(F.lit(2.0), level).cast("long")


def _edge(level: Column) -> Column:
    return F.lit(360.0) / _turns(level)


def _row(lat: Column, edge: Column) -> Column:
    return F.floor((lat + 90.0) / edge)


def _column(lon: Column, edge: Column) -> Column:
    return F.floor((lon + 180.0) / edge)


def filed(fences: DataFrame) -> DataFrame:
    """A row a fence and cell of its reach: geofence_id, lat0, lon0, radius_m, active_from, active_to, level, gx, gy."""
    angle = (F.col("radius_m") + CLEAR_M) / EARTH_M
    tall = F.degrees(angle)
    ratio = F.sin(F.least(angle, F.lit(1.5))) / F.cos(F.radians("lat"))
    pole = (F.abs("lat") + tall >= 90.0) | (ratio >= 1.0)
    wide = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    level = F.greatest(F.least(F.floor(F.log2(F.lit(360.0) / F.greatest(tall, wide))), F.lit(FINEST)), F.lit(0)).cast("int")
    rows = fences.select("geofence_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "radius_m", "active_from", "active_to", tall.alias("tall"), wide.alias("wide"), level.alias("level"))
    edge, turns = _edge(F.col("level")), _turns(F.col("level"))
    # around a pole, and where the reach goes round, every cell of a row; elsewhere two or three
    reach = F.sequence(_column(F.col("lon0") - F.col("wide"), edge), _column(F.col("lon0") + F.col("wide"), edge))
    columns = F.array_distinct(F.transform(reach, lambda x: F.pmod(x, turns)))
    rows = rows.withColumn("gx", F.explode(columns))
    rows = rows.withColumn("gy", F.explode(F.sequence(_row(F.col("lat0") - F.col("tall"), edge), _row(F.col("lat0") + F.col("tall"), edge))))
    return rows.drop("tall", "wide")


def near(fixes: DataFrame, fences: DataFrame) -> DataFrame:
    """Each fix (lat, lon, event_ts and more) with the fences, active at its time, whose edge it is inside of or within CLEAR_M of, and its distance.

    A level is looked up only where a fence lies on it; levels in use are one value that runs with the query.
    """
    cells = filed(fences)
    levels = cells.agg(F.collect_set("level")).scalar()
    edge = _edge(F.col("level"))
    looked = fixes.withColumn("level", F.explode(levels))
    looked = looked.withColumn("gx", F.pmod(_column(F.col("lon"), edge), _turns(F.col("level")))).withColumn("gy", _row(F.col("lat"), edge))
    active = "event_ts >= active_from and (active_to is null or event_ts < active_to)"
    met = looked.join(cells, ["level", "gx", "gy"]).filter(active)
    met = met.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))
    return met.filter(F.col("distance_m") <= F.col("radius_m") + CLEAR_M).select(*fixes.columns, "geofence_id", "radius_m", "active_from", "active_to", "distance_m")


def beside_each(rows: DataFrame, fences: DataFrame, *columns: str) -> DataFrame:
    """Each row beside each fence, for results that have a row for both: joined by blocks of fences, spread from there."""
    blocks = F.greatest(F.ceil(fences.agg(F.count(F.lit(1))).scalar() / BLOCK), F.lit(1))
    filed_ = fences.groupBy(F.pmod(F.xxhash64("geofence_id"), blocks).alias("block_")).agg(F.collect_list(F.struct(*columns)).alias("fences_"))
    spread = rows.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    return spread.join(filed_, "block_").withColumn("f_", F.explode("fences_")).select(*rows.columns, *(F.col(f"f_.{c}").alias(c) for c in columns))
