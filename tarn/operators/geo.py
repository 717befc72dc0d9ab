"""Geo members: a sorted set (key, member, score) whose score is the 52-bit cell number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G


def add(state: DataFrame, points: DataFrame, only_new: bool = False, only_old: bool = False) -> DataFrame:
    """GEOADD of points (key, member, lon, lat); invalid coordinates raise when evaluated."""
    checked = points.withColumn("_ok", F.assert_true(G.valid(F.col("lon"), F.col("lat")), "invalid longitude or latitude"))
    new = checked.select("key", "member", G.encode(F.col("lon"), F.col("lat")).cast("double").alias("score"), "_ok").filter(F.col("_ok").isNull()).drop("_ok")
    if only_new:
        return state.unionByName(new.join(state, ["key", "member"], "left_anti"))
    if only_old:
        new = new.join(state.select("key", "member"), ["key", "member"], "left_semi")
    return state.join(new, ["key", "member"], "left_anti").unionByName(new)


def positions(state: DataFrame) -> DataFrame:
    """GEOPOS and GEOHASH of every member: lon, lat and geohash of its cell's centre."""
    lon, lat = G.decode(F.col("score").cast("long"))
    placed = state.withColumn("lon", lon).withColumn("lat", lat)
    return placed.withColumn("geohash", G.base32(F.col("lon"), F.col("lat")))


def pair_distance(placed: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """GEODIST of pairs (key, a, b) of members; NULL where one is missing."""
    a = placed.select("key", F.col("member").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = placed.select("key", F.col("member").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    both = pairs.join(a, ["key", "a"], "left").join(b, ["key", "b"], "left")
    return both.select("key", "a", "b", (G.distance(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) / G.UNITS[unit]).alias("distance"))


def search(placed: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """GEOSEARCH and GEORADIUS around a point: members within a radius or box, with ``distance`` in the unit.

    A bounding box on lon and lat comes first, which a scan of stored columns can use.
    """
    scale = G.UNITS[unit]
    if (radius is None) == (box is None):
        raise ValueError("give a radius or a box")
    reach = radius * scale if radius is not None else ((box[0] * scale / 2) ** 2 + (box[1] * scale / 2) ** 2) ** 0.5 * 1.001 if max(box) * scale < 4e6 else 2.1e7
    west, south, east, north = G.bounds(lon, lat, reach)
    near = placed.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    metres = G.distance(lon, lat, F.col("lon"), F.col("lat"))
    inside = metres <= radius * scale if radius is not None else G.in_box(F.col("lon"), F.col("lat"), lon, lat, box[0] * scale, box[1] * scale)
    out = near.filter(inside).withColumn("distance", metres / scale)
    if count is not None:
        return out.orderBy(F.col("distance").desc() if descending else F.col("distance").asc(), "member").limit(count)
    return out


def search_member(placed: DataFrame, member: str, **how) -> DataFrame:
    """GEOSEARCH FROMMEMBER: around a member's own place; an unknown member raises."""
    row = placed.filter(F.col("member") == member).select("lon", "lat").first()
    if row is None:
        raise KeyError(member)
    return search(placed, row["lon"], row["lat"], **how)


def store(found: DataFrame, dest: str, distances: bool = False) -> DataFrame:
    """GEOSEARCHSTORE: the found members as a sorted set, scored by cell or by distance."""
    return found.select(F.lit(dest).alias("key"), "member", (F.col("distance") if distances else F.col("score")).alias("score"))
