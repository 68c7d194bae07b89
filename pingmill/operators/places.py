"""Point clusters, home and work, most frequent trips, stays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import asin, cos, pi, sin, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.classes import local_time
from pingmill.functions.geo import EARTH_KM
from pingmill.functions.storage import materialise
from pingmill.operators.components import connected_components
from pingmill.operators.trips import keep, trip_ends

#: Degrees up to which places are one: means of equal places differ in the last digits.
SAME = 1e-9


#: Pairs of places of two cells that are compared one by one; cells of more pairs are halved first.
DIRECT = 4096


def _box(lon: str, lat: str) -> list[Column]:
    return [f(c).alias(f"_{n}{k}") for c, n in ((lon, "x"), (lat, "y")) for k, f in ((0, F.min), (1, F.max))]


def _apart(least: bool) -> Column:
    """The least or the greatest distance that points of the boxes a and b can have."""
    gap = []
    for c in ("x", "y"):
        one, other = F.col(f"b._{c}0") - F.col(f"a._{c}1"), F.col(f"a._{c}0") - F.col(f"b._{c}1")
        gap.append(F.greatest(one, other, F.lit(0.0)) if least else F.greatest(-one, -other))
    return F.sqrt(gap[0] * gap[0] + gap[1] * gap[1])


def _cell_links(spots: DataFrame, cells: DataFrame, group: list[str], eps: float, side: float, lon: str, lat: str) -> DataFrame:
    """(group, src, dst): ids of cells up to two apart that have a place each within ``eps`` of each other.

    Boxes that are near or far as a whole decide. Of the others, small ones compare their places; large ones are
    quartered along both sides until boxes decide or both are single places.
    """
    steps = F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x in range(3) for y in range(-2, 3) if (x, y) > (0, 0)))
    asked = cells.withColumn("_s", F.explode(steps)).withColumns({"_tx": F.col("_cx") + F.col("_s.x"), "_ty": F.col("_cy") + F.col("_s.y")}).alias("a")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    met = asked.join(cells.alias("b"), [*same, F.col("a._tx") == F.col("b._cx"), F.col("a._ty") == F.col("b._cy")]).where(_apart(True) <= eps)
    pairs = materialise(
        met.select(*(F.col(f"a.{g}").alias(g) for g in group), F.col("a._id").alias("src"), F.col("b._id").alias("dst"), (_apart(False) <= eps).alias("sure"), (F.col("a._places") * F.col("b._places")).alias("work")), "cells"
    )
    ids = [*group, "src", "dst"]
    links = [pairs.where("sure").select(*ids)]
    open_ = pairs.where("not sure")
    own = spots.select(*group, "_cx", "_cy", lon, lat).join(cells.select(*group, "_cx", "_cy", "_id"), [*group, "_cx", "_cy"])

    def side_of(name: str) -> DataFrame:
        return own.select(*group, F.col("_id").alias(name), F.col(lon).alias(f"_{name}_lon"), F.col(lat).alias(f"_{name}_lat"))

    dx, dy = F.col("_dst_lon") - F.col("_src_lon"), F.col("_dst_lat") - F.col("_src_lat")
    small = open_.where(F.col("work") <= DIRECT).select(*ids).join(side_of("src"), [*group, "src"]).join(side_of("dst"), [*group, "dst"])
    links.append(small.where(F.sqrt(dx * dx + dy * dy) <= eps).select(*ids).distinct())
    # a node of a cell is named by its column and row, at first those of the cell
    nodes = open_.where(F.col("work") > DIRECT).select(*ids, *(F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")))
    large, level = materialise(nodes, "nodes"), 0
    while not large.isEmpty():
        was, size = (None if level == 0 else side / 4**level), side / 4 ** (level + 1)
        cut = lambda c, s: F.lit(0).cast("long") if s is None else F.floor(F.col(c) / s)
        ends = large.select(*group, F.col("src").alias("_id")).union(large.select(*group, F.col("dst"))).distinct()
        parts = own.join(ends, [*group, "_id"], "left_semi").withColumns({"px": cut(lon, was), "py": cut(lat, was), "sx": cut(lon, size), "sy": cut(lat, size)})
        parts = parts.groupBy(*group, "_id", "px", "py", "sx", "sy").agg(*_box(lon, lat))
        a, b = parts.alias("a"), parts.alias("b")
        at = lambda t, end, x: [*(F.col(f"l.{g}") == F.col(f"{t}.{g}") for g in group), F.col(f"l.{end}") == F.col(f"{t}._id"), F.col(f"l.{x}x") == F.col(f"{t}.px"), F.col(f"l.{x}y") == F.col(f"{t}.py")]
        closer = large.alias("l").join(a, at("a", "src", "a")).join(b, at("b", "dst", "b")).where(_apart(True) <= eps)
        closer = materialise(closer.select(*(F.col(f"l.{c}").alias(c) for c in ids), F.col("a.sx").alias("ax"), F.col("a.sy").alias("ay"), F.col("b.sx").alias("bx"), F.col("b.sy").alias("by"), (_apart(False) <= eps).alias("sure")), "nodes")
        sure = closer.where("sure").select(*ids).distinct()
        links.append(sure)
        large, level = materialise(closer.join(sure, ids, "left_anti").drop("sure"), "nodes"), level + 1
    return reduce(DataFrame.union, links)


def cluster_points(points: DataFrame, group: list[str], eps: float, min_pts: int = 1, lon: str = "lon", lat: str = "lat", order: str = "idx") -> DataFrame:
    """``points`` with ``label``, the least ``order`` of its cluster; null for noise.

    With ``min_pts`` 1 or 2 density clusters are the components of the graph of points within ``eps``.
    Points of one cell of side eps / sqrt 2 are in one cluster, so only cells are linked (``_cell_links``), and
    a cell of any number of places takes work in proportion to it. Points without a place are left out.
    """
    side = eps / sqrt(2) * (1 - 1e-9)
    celled = materialise(points.withColumn("_cx", F.floor(F.col(lon) / side)).withColumn("_cy", F.floor(F.col(lat) / side)), "points")
    spots = materialise(celled.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(*group, "_cx", "_cy", lon, lat).agg(F.min(order).alias("_id"), F.count(F.lit(1)).alias("_n")), "places")
    cells = materialise(spots.groupBy(*group, "_cx", "_cy").agg(F.min("_id").alias("_id"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_places"), *_box(lon, lat)), "cells")
    labels = connected_components(_cell_links(spots, cells, group, eps, side, lon, lat), group).withColumnRenamed("node", "_id")
    label = F.coalesce("label", F.when((F.col("_n") > 1) | F.lit(min_pts < 2), F.col("_id")))
    named = cells.join(labels, [*group, "_id"], "left").select(*group, "_cx", "_cy", label.alias("label"))
    return materialise(celled.join(named, [*group, "_cx", "_cy"]).drop("_cx", "_cy"), "labelled")


def cluster_centroids(points: DataFrame, group: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.where("label is not null").groupBy(*group, "label").agg(F.avg(lon).alias("c_lon"), F.avg(lat).alias("c_lat"), F.count(F.lit(1)).alias("n"))


def main_place(points: DataFrame, group: list[str], eps: float = 0.001, min_pts: int = 2, share: float = 0.4) -> DataFrame:
    """The largest cluster of each group, the first of equal ones, if it has ``share`` of all its points."""
    labelled = cluster_points(points, group, eps, min_pts)
    total = labelled.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "label"))
    top = cluster_centroids(labelled, group).withColumn("_rank", rank).where("_rank = 1").join(total, group)
    return top.where(F.col("n") >= share * F.col("total")).select(*group, F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat"))


def place_pools(trips: DataFrame, zone: str = "US/Central") -> DataFrame:
    """(user_id, pool, idx, lon, lat): trip ends that tell of home and of work by local hour and weekday.

    trips: a summary with ``idx``, which orders it. Home: departures before 10, arrivals after 16. Work, on
    weekdays by departure: arrivals before 11, departures after 15.
    """
    dep, arr = local_time(F.col("dep_ts"), zone), local_time(F.col("arr_ts"), zone)
    week = F.weekday(dep) < 5

    def end(pool: str, k: int, lon: str, lat: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(pool).alias("pool"), (F.col("idx") * 4 + k).alias("idx"), F.col(lon).alias("lon"), F.col(lat).alias("lat")))

    ends = F.array(
        end("home", 0, "s_lon", "s_lat", F.hour(dep) < 10), end("home", 1, "t_lon", "t_lat", F.hour(arr) > 16),
        end("work", 2, "t_lon", "t_lat", week & (F.hour(arr) < 11)), end("work", 3, "s_lon", "s_lat", week & (F.hour(dep) > 15)),
    )
    return trips.select("user_id", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("user_id", "e.*")


def home_work(trips: DataFrame, eps: float = 0.001, min_pts: int = 2, share: float = 0.4) -> DataFrame:
    """user_id, home_lon, home_lat, work_lon, work_lat of every user with a trip; null where there is no main place."""
    trips = materialise(trips.select("user_id", "idx", "dep_ts", "arr_ts", "s_lon", "s_lat", "t_lon", "t_lat"), "trips")
    places = main_place(place_pools(trips), ["user_id", "pool"], eps, min_pts, share)
    at = lambda pool, c: F.max(F.when(F.col("pool") == pool, F.col(c))).alias(f"{pool}_{c}")
    found = places.groupBy("user_id").agg(at("home", "lon"), at("home", "lat"), at("work", "lon"), at("work", "lat"))
    return trips.select("user_id").distinct().join(found, "user_id", "left")


def significant_places(points: DataFrame, k: int = 1, eps: float = 0.005, ends: DataFrame | None = None) -> DataFrame:
    """The ``k``-th most frequent directed pair of end clusters of each user, with centroids and trips.

    n_user_trips are all of the user's trips, n_trips those of the pair. Among pairs of equal counts the
    one whose first trip is latest comes first. A user without a ``k``-th pair has no row. ``ends``: the points' ``trip_ends``, if known.
    """
    ends = trip_ends(points) if ends is None else ends
    both = ends.select(
        "user_id", "trip_id", "dep_ts",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat")), F.struct(F.lit(1).alias("side"), F.col("t_lon").alias("lon"), F.col("t_lat").alias("lat")))).alias("e"),
    ).select("user_id", "trip_id", "dep_ts", "e.*")
    labelled = cluster_points(both.withColumn("idx", F.col("trip_id") * 2 + F.col("side")), ["user_id"], eps, 1)
    centres = cluster_centroids(labelled, ["user_id"])
    pair = labelled.groupBy("user_id", "trip_id").agg(F.max(F.when(F.col("side") == 0, F.col("label"))).alias("o"), F.max(F.when(F.col("side") == 1, F.col("label"))).alias("d"))
    counts = pair.groupBy("user_id", "o", "d").agg(F.count(F.lit(1)).alias("n_trips"), F.min("trip_id").alias("first"), F.collect_list("trip_id").alias("trips"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n_trips"), F.desc("first")))
    ranked = counts.select("*", rank.alias("_rank"), F.sum("n_trips").over(Window.partitionBy("user_id")).alias("n_user_trips"))
    top = ranked.where(F.col("_rank") == k).drop("_rank", "first")
    o = centres.select("user_id", F.col("label").alias("o"), F.col("c_lon").alias("o_lon"), F.col("c_lat").alias("o_lat"))
    d = centres.select("user_id", F.col("label").alias("d"), F.col("c_lon").alias("d_lon"), F.col("c_lat").alias("d_lat"))
    return top.join(o, ["user_id", "o"]).join(d, ["user_id", "d"])


def trips_of_od_rank(points: DataFrame, k: int = 1, least: int = 10, eps: float = 0.005) -> DataFrame:
    """Points of the trips of that pair if it has ``least`` trips, led to both centroids: ``pos`` -1, then 0 for points, then 1."""
    known = materialise(trip_ends(points), "ends")
    places = significant_places(points, k, eps, known).where(F.col("n_trips") >= least)
    chosen = materialise(places.select("user_id", F.explode("trips").alias("trip_id"), "o_lon", "o_lat", "d_lon", "d_lat"), "chosen")
    columns = ["user_id", "trip_id", "ts", "lon", "lat", "ping_id"]
    own = keep(points, chosen, ["user_id", "trip_id"]).select(*columns, F.lit(0).alias("pos"))
    ends = known.join(chosen, ["user_id", "trip_id"])
    lead = ends.where(f"abs(s_lon - o_lon) > {SAME} or abs(s_lat - o_lat) > {SAME}").select("user_id", "trip_id", F.col("dep_ts").alias("ts"), F.col("o_lon").alias("lon"), F.col("o_lat").alias("lat"), F.lit(-1).cast("long").alias("ping_id"), F.lit(-1).alias("pos"))
    tail = ends.where(f"abs(t_lon - d_lon) > {SAME} or abs(t_lat - d_lat) > {SAME}").select("user_id", "trip_id", F.col("arr_ts").alias("ts"), F.col("d_lon").alias("lon"), F.col("d_lat").alias("lat"), F.lit(-1).cast("long").alias("ping_id"), F.lit(1).alias("pos"))
    return own.unionByName(lead).unionByName(tail)


def stay_points(pings: DataFrame, radius_km: float = 0.3, least_s: int = 600) -> DataFrame:
    """user_id, arrival_ts, duration, lon, lat: stays longer than ``least_s`` within ``radius_km`` of a running centroid.

    A fold over each partition, sorted by user and time, that carries one user's open stay from batch to
    batch, so a user of any number of points takes the same memory. A repeated record is skipped; the
    last, open stay is not given. Points without a time or place are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, begin, c_lon, c_lat, n, ts, p_lon, p_lat = None, None, 0.0, 0.0, 0, 0, 0.0, 0.0
        half = pi / 360
        for batch in batches:
            out: list[tuple] = []
            for u, t, lon, lat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != user or begin is None:
                    user, begin, c_lon, c_lat, n = u, t, lon, lat, 1
                elif t == ts and lon == p_lon and lat == p_lat:
                    continue
                else:
                    square = sin((lat - c_lat) * half) ** 2 + cos(c_lat * 2 * half) * cos(lat * 2 * half) * sin((lon - c_lon) * half) ** 2
                    if 2 * EARTH_KM * asin(sqrt(square)) > radius_km:
                        if ts - begin > least_s:  # the stay lasts until the last point before the one that leaves
                            out.append((user, begin, ts - begin, c_lon, c_lat))
                        begin, c_lon, c_lat, n = t, lon, lat, 1
                    else:
                        c_lon, c_lat, n = (c_lon * n + lon) / (n + 1), (c_lat * n + lat) / (n + 1), n + 1
                ts, p_lon, p_lat = t, lon, lat
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 3 + (pa.float64(),) * 2, strict=True)], names=["user_id", "arrival_ts", "duration", "lon", "lat"])

    rows = pings.where("ts is not null and lon is not null and lat is not null").select(F.col("user_id").cast("long"), F.col("ts").cast("long"), "ping_id", F.col("lon").cast("double"), F.col("lat").cast("double"))
    track = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "ping_id", "lon", "lat").drop("ping_id")
    return track.mapInArrow(run, "user_id long, arrival_ts long, duration long, lon double, lat double")


def merge_visits(visits: DataFrame, keys: list[str], gap_s: int = 3600) -> DataFrame:
    """Joins visits of one place whose gap is at most ``gap_s``; visits: keys, start_ts, end_ts."""
    order = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    until = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = visits.withColumn("_new", F.when(F.col("start_ts") - until <= gap_s, 0).otherwise(1))
    return flagged.withColumn("visit", F.sum("_new").over(order)).groupBy(*keys, "visit").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def home_from_stays(stays: DataFrame, eps: float = 0.0005, zone: str = "US/Central") -> DataFrame:
    """The cluster of stays with most merged visits by night or on weekends; the first of equal ones."""
    labelled = cluster_points(stays.withColumn("idx", F.col("arrival_ts")), ["user_id"], eps, 2).where("label is not null")
    visits = merge_visits(labelled.select("user_id", "label", F.col("arrival_ts").alias("start_ts"), (F.col("arrival_ts") + F.col("duration")).alias("end_ts")), ["user_id", "label"])
    at = local_time(F.col("start_ts"), zone)
    night = (F.weekday(at) >= 5) | (F.hour(at) <= 8) | (F.hour(at) >= 20)
    counts = visits.groupBy("user_id", "label").agg(F.count_if(night).alias("nights"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("nights"), "label"))
    return counts.withColumn("_rank", rank).where("_rank = 1").drop("_rank").join(cluster_centroids(labelled, ["user_id"]), ["user_id", "label"]).select("user_id", "c_lon", "c_lat", "nights")
