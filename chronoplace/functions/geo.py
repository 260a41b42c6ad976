"""Distances, boxes and radius joins (GEO-*, FLT-6, JOI-17, REL-4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """GEO-1: kilometres between points; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box(lat: float, lon: float, radius: float) -> tuple[float, float, float | None, float | None]:
    """FLT-6: latitude and longitude bounds; no longitude bounds where the box crosses the 180th meridian."""
    dlat, dlon = radius / KM_PER_DEGREE, radius / max(1.0, KM_PER_DEGREE * abs(math.cos(math.radians(lat))))
    crosses = lon - dlon < -180 or lon + dlon > 180
    return lat - dlat, lat + dlat, None if crosses else lon - dlon, None if crosses else lon + dlon


def in_box(df: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Literal bounds, so that they reach the Parquet scan."""
    south, north, west, east = box(lat, lon, radius)
    out = df.filter(F.col("lat").between(south, north))
    return out if west is None else out.filter(F.col("lon").between(west, east))


def within_radius(df: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """REL-4: the box, then the exact distance; adds distance_km."""
    near = in_box(df, lat, lon, radius).withColumn("distance_km", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    return near.filter(F.col("distance_km") <= radius)


def radius_join(queries: DataFrame, df: DataFrame, radius: float, key: str = "query_id") -> DataFrame:
    """JOI-17 for many points: grid cells as the join key, then the exact distance. queries: key, q_lat, q_lon.

    A cell is as high as the radius, and a whole number of them goes round the
    earth. A query covers the cells of its box, whose width follows the latitude;
    longitudes wrap, and a box that reaches a pole has all of them.
    """
    size = max(radius / KM_PER_DEGREE, 0.01)
    columns = max(1, math.floor(360 / size))
    row = lambda c: F.floor((c + 90) / size)
    column = lambda c: F.floor((c + 180) / (360 / columns))
    top = F.abs(F.col("q_lat")) + size
    reach = F.when(top < 90, F.least(F.lit(180.0), radius / (KM_PER_DEGREE * F.cos(F.radians(top))))).otherwise(180.0)
    cells = queries.withColumn("__r", F.explode(F.sequence(row(F.col("q_lat") - size), row(F.col("q_lat") + size))))
    cells = cells.withColumn("__c", F.explode(F.array_distinct(F.transform(F.sequence(column(F.col("q_lon") - reach), column(F.col("q_lon") + reach)), lambda c: F.pmod(c, F.lit(columns))))))
    placed = df.filter("lat is not null and lon is not null").withColumn("__r", row(F.col("lat"))).withColumn("__c", F.pmod(column(F.col("lon")), F.lit(columns)))
    near = placed.join(cells, ["__r", "__c"]).withColumn("distance_km", haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))
    return near.filter(F.col("distance_km") <= radius).drop("__r", "__c")


def proximity(distance: Column, radius: float, weight: float = 0.5) -> Column:
    """GEO-2."""
    return F.coalesce(F.greatest(F.lit(0.0), weight * (1 - distance / max(radius, 1.0))), F.lit(0.0))


def clusters(df: DataFrame, degrees: float) -> DataFrame:
    """GEO-4: points of each grid cell."""
    cells = df.filter("lat is not null and lon is not null").groupBy(F.floor(F.col("lat") / degrees).alias("row"), F.floor(F.col("lon") / degrees).alias("column"))
    return cells.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
