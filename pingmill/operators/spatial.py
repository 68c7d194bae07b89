"""Zones: point in polygon by cells, centroids, assignment of trip ends.

zones, a row a polygon: zone_id, ring_id, rings array<array<struct<lon, lat>>> (the border and the holes, closed or open),
min_lon, max_lon, min_lat, max_lat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.geo import haversine_km

CELL_DEG = 0.05


def inside(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside; edges are half-open, so a shared edge belongs to one side."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def crosses(a: Column, i: Column) -> Column:
            b = F.element_at(ring, (i + 1) % n + 1)
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            return spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

        return F.size(F.filter(F.transform(ring, crosses), lambda x: x))

    return F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring)) % 2 == 1


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def _spread(zones: DataFrame, cell: float) -> DataFrame:
    """Zones with the cells of their boxes."""
    wide = zones.withColumn("_cx", F.explode(F.sequence(_cell(F.col("min_lon"), cell), _cell(F.col("max_lon"), cell))))
    return wide.withColumn("_cy", F.explode(F.sequence(_cell(F.col("min_lat"), cell), _cell(F.col("max_lat"), cell))))


def zone_hits(points: DataFrame, zones: DataFrame, lon: str, lat: str, keys: list[str], cell: float = CELL_DEG) -> DataFrame:
    """(keys, zone_id) of points and the polygons that hold them.

    Zones are spread over the cells of their boxes, points meet them by cell, then box, then exact test.
    """
    spread = _spread(zones, cell)
    at = points.select(*keys, F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).withColumn("_cx", _cell(F.col("_lon"), cell)).withColumn("_cy", _cell(F.col("_lat"), cell))
    box = F.col("_lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("_lat").between(F.col("min_lat"), F.col("max_lat"))
    return at.join(spread, ["_cx", "_cy"]).where(box).where(inside(F.col("rings"), F.col("_lon"), F.col("_lat"))).select(*keys, "zone_id")


def assign_zones(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", into: str = "zone_id", keys: list[str] | None = None, cell: float = CELL_DEG) -> DataFrame:
    """``points`` with the zone that holds each, the greatest of several, null for none.

    A cell's polygons are one row, so each point meets one row at most and nothing is grouped by point.
    ``keys`` name a point; they are not needed to tell points apart.
    """
    polygons = F.collect_list(F.struct("zone_id", "rings", "min_lon", "max_lon", "min_lat", "max_lat"))
    held = _spread(zones, cell).groupBy("_cx", "_cy").agg(polygons.alias("_polygons"))
    x, y = F.col(lon), F.col(lat)
    holds = lambda p: x.between(p["min_lon"], p["max_lon"]) & y.between(p["min_lat"], p["max_lat"]) & inside(p["rings"], x, y)
    zone = F.array_max(F.transform(F.filter("_polygons", holds), lambda p: p["zone_id"]))
    met = points.withColumns({"_cx": _cell(x, cell), "_cy": _cell(y, cell)}).join(held, ["_cx", "_cy"], "left")
    return met.withColumn(into, zone).drop("_cx", "_cy", "_polygons")


def assign_trip_zones(trips: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Trips with o_zone and d_zone; only those with both. Both ends meet the zones in one pass."""
    end = lambda side, lon, lat: F.struct(F.lit(side).alias("_side"), F.col(lon).alias("_end_lon"), F.col(lat).alias("_end_lat"))
    ends = trips.select(*keys, F.explode(F.array(end("o", "s_lon", "s_lat"), end("d", "t_lon", "t_lat"))).alias("_e")).select(*keys, "_e.*")
    hits = zone_hits(ends, zones, "_end_lon", "_end_lat", [*keys, "_side"])
    of = lambda side: F.max(F.when(F.col("_side") == side, F.col("zone_id")))
    found = hits.groupBy(*keys).agg(of("o").alias("o_zone"), of("d").alias("d_zone")).where("o_zone is not null and d_zone is not null")
    return trips.join(found, keys)


def in_named_zone(points: DataFrame, zones: DataFrame, zone: int, keys: list[str]) -> DataFrame:
    found = assign_zones(points, zones.where(F.col("zone_id") == zone), keys=keys)
    return found.withColumn("inside", F.when(F.col("zone_id").isNotNull(), 1).otherwise(0)).drop("zone_id")


def zone_centroids(zones: DataFrame) -> DataFrame:
    """Mean of the corners of each zone's border of most corners, the first of equal ones."""
    bordered = zones.withColumn("ring", F.col("rings")[0])
    order = Window.partitionBy("zone_id").orderBy(F.desc(F.size("ring")), "ring_id")
    largest = bordered.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    mean = lambda c: F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x) / F.size("ring")
    return largest.select("zone_id", mean("lon").alias("c_lon"), mean("lat").alias("c_lat"))


def zone_map(small: DataFrame, large: DataFrame) -> DataFrame:
    """Small zone to the large zone that holds its centroid."""
    centres = zone_centroids(small).withColumnRenamed("zone_id", "small_zone")
    return assign_zones(centres, large, "c_lon", "c_lat", "large_zone", ["small_zone"]).select("small_zone", "large_zone")


def map_od(trips: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds o_large and d_large by the map; pairs with an unknown side go."""
    o = mapping.select(F.col("small_zone").alias("o_zone"), F.col("large_zone").alias("o_large"))
    d = mapping.select(F.col("small_zone").alias("d_zone"), F.col("large_zone").alias("d_large"))
    return trips.join(o, "o_zone").join(d, "d_zone").where("o_large is not null and d_large is not null")


def zone_distances(centroids: DataFrame) -> DataFrame:
    """Km between all pairs of different zones. The pairs are the result; zone tables have thousands of rows."""
    a = centroids.select(F.col("zone_id").alias("o_zone"), F.col("c_lon").alias("o_lon"), F.col("c_lat").alias("o_lat"))
    b = centroids.select(F.col("zone_id").alias("d_zone"), F.col("c_lon").alias("d_lon"), F.col("c_lat").alias("d_lat"))
    km = haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    return a.join(b, F.col("o_zone") != F.col("d_zone")).select("o_zone", "d_zone", km.alias("km"))


def zone_values(zones: DataFrame, values: DataFrame, value: str) -> DataFrame:
    return zones.select("zone_id").distinct().join(values, "zone_id", "left").select("zone_id", F.coalesce(value, F.lit(0.0)).alias(value))


def home_tracts(homes: DataFrame, tracts: DataFrame) -> DataFrame:
    """(user_id, tract) of users whose home lies in a tract; homes: user_id, home_lon, home_lat."""
    known = homes.where("home_lon is not null and home_lat is not null").select("user_id", "home_lon", "home_lat")
    return assign_zones(known, tracts, "home_lon", "home_lat", "tract", ["user_id"]).where("tract is not null").select("user_id", "tract")


def tract_income(homes: DataFrame, incomes: DataFrame) -> DataFrame:
    """Home tract with the tract's income; users of tracts without one go."""
    return homes.join(incomes.select("tract", "income"), "tract").select("user_id", "tract", "income")
