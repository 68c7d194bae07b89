"""Pings to trips: inventories, legs, segmentation, summaries and trip filters.

Points have user_id, ts, lon, lat and ping_id, which orders points of one time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingmill.functions.geo import CELL, GRID_ROWS, grid_bounds, grid_id, grid_manhattan, haversine_km, near_grids
from pingmill.functions.storage import materialise

#: Points that a task sorts. Left to itself Spark sizes tasks by compressed bytes, and ids that follow each other take a tenth of their rows.
TASK_ROWS = 800_000
#: To so many partitions Spark writes without a sort (spark.shuffle.sort.bypassMergeThreshold); for more, tasks that read hold what they write.
UNSORTED = 200


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "ping_id")


def by_trip():
    return Window.partitionBy("user_id", "trip_id").orderBy("ts", "ping_id")


def filter_accuracy(pings: DataFrame, most: float = 150) -> DataFrame:
    return pings.where(~(F.col("accuracy") > most)).drop("accuracy")


def keep(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``keys``; Spark broadcasts ``keys`` where it knows them to be small."""
    return df.join(keys.select(*on), on, "left_semi")


def drop(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def task_count(points: DataFrame) -> int:
    """So many tasks that each has some ``TASK_ROWS`` of the points, which are counted for it; one a core at least.

    Above ``UNSORTED`` tasks these grow before they become more, to ten times ``TASK_ROWS`` each.
    """
    n, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(UNSORTED, -(-n // TASK_ROWS)), -(-n // (10 * TASK_ROWS)))


def user_inventory(pings: DataFrame) -> DataFrame:
    return pings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_inventory(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(F.sum("n_records").alias("n_records"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def select_users(inventory: DataFrame, span: int = 60, log_records: float = 3.0, most_span: float | None = 200, most_log: float = 7.0) -> DataFrame:
    """Users whose span, whole elapsed days and one, and records exceed the least ones and not the caps."""
    days = F.floor((F.col("last_ts") - F.col("first_ts")) / 86400) + 1
    out = inventory.withColumn("span_days", days).where((F.col("span_days") > span) & (F.log10("n_records") > log_records) & (F.log10("n_records") <= most_log))
    return out if most_span is None else out.where(F.col("span_days") <= most_span)


def selection_summary(inventory: DataFrame, selected: DataFrame) -> DataFrame:
    flagged = inventory.join(selected.select("user_id", F.lit(1).alias("in")), "user_id", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_users"), F.count("in").alias("kept_users"), F.sum("n_records").alias("n_records"),
        F.sum(F.when(F.col("in") == 1, F.col("n_records")).otherwise(0)).alias("kept_records"),
    )


def sample_intervals(pings: DataFrame, order: str = "ping_id") -> DataFrame:
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", order))
    return pings.select("user_id", "ts", gap.alias("interval_s")).where("interval_s > 0")


def legs(points: DataFrame, window=None) -> DataFrame:
    """Each point with the seconds and km from the one before; null at the first."""
    before = {c: F.lag(c).over(window or by_trip()) for c in ("ts", "lon", "lat")}
    return points.select("*", (F.col("ts") - before["ts"]).alias("leg_s"), haversine_km(before["lat"], before["lon"], F.col("lat"), F.col("lon")).alias("leg_km"))


def _numbered(points: DataFrame, breaks: Column, more_than: int, by: list[str]) -> DataFrame:
    """Numbers the runs between breaks, keeps those of more than so many points, and numbers again without holes."""
    order = Window.partitionBy(*by).orderBy("ts", "ping_id")
    run = points.withColumn("_run", F.sum(F.when(breaks, 1).otherwise(0)).over(order))
    kept = run.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))).where(F.col("_n") > more_than)
    return kept.withColumn("trip_id", F.dense_rank().over(Window.partitionBy(*by).orderBy("_run")).cast("long")).drop("_run", "_n")


def segment_trips(points: DataFrame, gap_h: float = 0.3, jump_km: float = 10, more_than: int = 5) -> DataFrame:
    """Breaks before a point that ends a leg longer than ``gap_h`` hours or ``jump_km`` km; short pieces go."""
    breaks = (F.col("leg_s") > gap_h * 3600) | (F.col("leg_km") > jump_km)
    return _numbered(legs(points, by_user()), breaks, more_than, ["user_id"]).drop("leg_s", "leg_km")


def segment_trips_fine(points: DataFrame, gap_s: float = 60, jump_deg: float = 0.01, more_than: int = 5) -> DataFrame:
    flat = F.sqrt(F.pow(F.col("lon") - F.lag("lon").over(by_user()), 2) + F.pow(F.col("lat") - F.lag("lat").over(by_user()), 2))
    timed = points.withColumn("_s", F.col("ts") - F.lag("ts").over(by_user())).withColumn("_d", flat)
    return _numbered(timed, (F.col("_s") > gap_s) | (F.col("_d") > jump_deg), more_than, ["user_id"]).drop("_s", "_d")


def combine_trips(monthly: DataFrame, month: str = "month") -> DataFrame:
    """One id space per user over monthly trip ids: by month, then id."""
    rank = F.dense_rank().over(Window.partitionBy("user_id").orderBy(month, "trip_id"))
    return monthly.repartition(task_count(monthly), "user_id").withColumn("trip_id", rank).drop(month)


def number_trips(monthly: DataFrame, month: str = "month", users: int = 4096) -> DataFrame:
    """One id space for all users over monthly trip ids: ``trip_no`` from 0 by month, user, then id.

    Trips are ranked within a month and a range of ``users`` ids, and shifted by what ranges before hold: a
    window without keys sees one row a range only.
    """
    trip = [month, "user_id", "trip_id"]
    ranged = monthly.select(*trip).distinct().withColumn("_range", F.floor(F.col("user_id") / users))
    sizes = ranged.groupBy(month, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(month, "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(month, "_range").orderBy("user_id", "trip_id")) - 1
    numbered = ranged.withColumn("_rank", rank).join(sizes.select(month, "_range", before.alias("_before")), [month, "_range"])
    return monthly.repartition(task_count(monthly), *trip).join(numbered.select(*trip, (F.col("_before") + F.col("_rank")).alias("trip_no")), trip)


def trip_ends(points: DataFrame) -> DataFrame:
    at = F.struct("ts", "ping_id")
    return points.groupBy("user_id", "trip_id").agg(
        F.min("ts").alias("dep_ts"), F.max("ts").alias("arr_ts"), F.count(F.lit(1)).alias("n_points"),
        *(f(c, at).alias(n) for f, c, n in ((F.min_by, "lon", "s_lon"), (F.min_by, "lat", "s_lat"), (F.max_by, "lon", "t_lon"), (F.max_by, "lat", "t_lat"))),
    )


def trip_summary(points: DataFrame, more_than: int = 5, most_min: float = 120) -> DataFrame:
    """First and last times and places of trips with more points than ``more_than`` and 0 < minutes < ``most_min``."""
    out = trip_ends(points).withColumn("minutes", F.round((F.col("arr_ts") - F.col("dep_ts")) / 60, 2))
    return out.where((F.col("n_points") > more_than) & (F.col("minutes") > 0) & (F.col("minutes") < most_min))


def vehicular_trips(points: DataFrame, least_points: int = 5, least_km: float = 2.0, least_kmh: float = 10) -> DataFrame:
    """Trips of enough points, km from end to end and speed; trips without duration go."""
    km = haversine_km(F.col("s_lat"), F.col("s_lon"), F.col("t_lat"), F.col("t_lon"))
    timed = trip_ends(points).withColumn("km", km).withColumn("hours", (F.col("arr_ts") - F.col("dep_ts")) / 3600)
    return timed.where((F.col("n_points") >= least_points) & (F.col("km") >= least_km) & (F.col("hours") > 0) & (F.col("km") >= least_kmh * F.col("hours")))


def filter_vehicular(points: DataFrame, **limits: float) -> DataFrame:
    return keep(points, vehicular_trips(points, **limits), ["user_id", "trip_id"])


def trips_per_user(trips: DataFrame) -> DataFrame:
    return trips.groupBy("user_id").agg(F.countDistinct("trip_id").alias("n_trips"))


def filter_active_users(trips: DataFrame, least: int = 300) -> DataFrame:
    return keep(trips, trips_per_user(trips).where(F.col("n_trips") >= least), ["user_id"])


def survival_counts(per_user: DataFrame, col: str = "n_trips") -> DataFrame:
    """For each count, the users with more: a running sum over the counts' frequency table."""
    freq = per_user.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return freq.withColumn("users_above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def arc_length(points: DataFrame) -> DataFrame:
    """Running km along each trip, and the share of the whole; 0 for trips without length."""
    whole = Window.partitionBy("user_id", "trip_id")
    run = legs(points).withColumn("along_km", F.sum(F.coalesce("leg_km", F.lit(0.0))).over(by_trip().rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("along_km").over(whole)
    return run.withColumn("total_km", total).withColumn("position", F.when(F.col("total_km") > 0, F.col("along_km") / F.col("total_km")).otherwise(0.0))


def trip_vectors(points: DataFrame, most: float = 0.1) -> DataFrame:
    dx, dy = F.lead("lon").over(by_trip()) - F.col("lon"), F.lead("lat").over(by_trip()) - F.col("lat")
    return points.select("user_id", "trip_id", "ts", dx.alias("dx"), dy.alias("dy")).where(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) <= most)


def trip_to_grids(points: DataFrame) -> DataFrame:
    """The cells a trip passes, without repeats in a row."""
    celled = points.withColumn("grid", grid_id(F.col("lon"), F.col("lat")))
    return celled.withColumn("_before", F.lag("grid").over(by_trip())).where("_before is null or grid <> _before").drop("_before")


def split_grid_runs(cells: DataFrame, w: int = 2, more_than: int = 5) -> DataFrame:
    """Splits cell sequences where the next cell is outside the neighbourhood; keeps runs of more cells than ``more_than``."""
    before = cells.withColumn("_before", F.lag("grid").over(by_trip()))
    far = F.coalesce(~near_grids(F.col("_before"), F.col("grid"), w), F.lit(False))
    flagged = before.withColumn("_far", far).drop("_before").withColumnRenamed("trip_id", "source_trip")
    return _numbered(flagged, F.col("_far"), more_than, ["user_id", "source_trip"]).drop("_far")


def od_grid_trips(points: DataFrame) -> DataFrame:
    ends = trip_ends(points)
    return ends.withColumn("o_grid", grid_id(F.col("s_lon"), F.col("s_lat"))).withColumn("d_grid", grid_id(F.col("t_lon"), F.col("t_lat")))


#: Rows of cells that are looked at together at least, and matches of gaps and cells that are held at once.
CELLS, MATCHES = 1 << 16, 1 << 20
#: Numbers of cells of one user lie in so wide a range.
USER = 1 << 34


def fill_grid_gaps(cells: DataFrame, fine: DataFrame, w: int = 2) -> DataFrame:
    """(user_id, trip_id, seq, grid): cell sequences with their gaps filled from the user's high-resolution trips ``fine``.

    A step to a cell outside the ``w`` neighbourhood is a gap. The first trip of ``fine`` by trip_id that
    passes both its ends gives its cells from the one to before the other, none if it passes them the other
    way round: at the ends themselves (first passage), else next to them, else two cells off (last passage).
    Trips of less than three cells are not used. A gap that no trip fills keeps its far end.
    """
    names = ["user_id", "trip_id", "ts", "ping_id", "grid"]
    return fill_trip_gaps(cells.select(*names, F.lit(False).alias("high")).unionByName(fine.select(*names, F.lit(True).alias("high"))), w)


def fill_trip_gaps(cells: DataFrame, w: int = 2) -> DataFrame:
    """``fill_grid_gaps`` of one table, in which ``high`` says which trips fill the others.

    A fold over each user's cells in order, those of high trips first: it holds these, twelve bytes a cell and its
    share of an index, and the trips that it fills as they come. Tables dealt by user are not moved.
    """
    user = Window.partitionBy("user_id").orderBy(F.desc("high"), "trip_id", "ts", "ping_id")
    same = (F.lag("trip_id").over(user) == F.col("trip_id")) & (F.lag("high").over(user) == F.col("high"))
    near = cells.withColumn("near", F.when(same, F.lag("grid").over(user))).withColumns({"starts": F.row_number().over(user) == 1, "begins": ~F.coalesce(same, F.lit(False))})
    gap = F.coalesce(~near_grids(F.col("near"), F.col("grid"), w), F.lit(False)) & ~F.col("high")
    rows = near.sortWithinPartitions("user_id", F.desc("high"), "trip_id", "ts", "ping_id").select("user_id", "trip_id", "grid", "near", gap.alias("gap"), "high", "starts", "begins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = [], CELLS
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(x.num_rows for x in held) < least:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            high, starts, begins = (table.column(c).to_numpy() for c in ("high", "starts", "begins"))
            cut = table.num_rows if batch is None else int(np.flatnonzero(begins)[-1]) if begins.any() else 0
            own, grid, seq = _steps(table.slice(0, cut), high[:cut], starts[:cut], begins[:cut])
            own, grid = pa.array(own), pa.array(grid)
            columns = [table.column("user_id").take(own), table.column("trip_id").take(own), pa.chunked_array([pa.array(seq, pa.int64())]), table.column("grid").take(grid)]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=CELLS)
            if batch is None:
                return
            users = np.append(0, np.flatnonzero(starts))
            first = int(users[users <= cut][-1])
            left = np.append(first + np.flatnonzero(high[first:cut]), np.arange(cut, table.num_rows))
            held = table.take(pa.array(left)).combine_chunks().to_batches()
            least = max(CELLS, 2 * len(left))

    names = ["user_id", "trip_id", "seq", "grid"]
    kinds = cells.schema
    schema = T.StructType([T.StructField(c, T.LongType() if c == "seq" else kinds[c].dataType) for c in names])
    return rows.mapInArrow(run, schema)


def _steps(table: pa.Table, high: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the trips that are not high with what fills their gaps: the row of the trip, the row of the cell, and its number in the trip."""
    empty = np.empty(0, np.int64)
    if not len(high) or high.all():
        return empty, empty, empty
    numbers = lambda c: table.column(c).fill_null(0).to_numpy().astype(np.int64)
    cell, near, known = numbers("grid"), numbers("near"), table.column("grid").is_valid().to_numpy()
    user = np.cumsum(np.append(True, starts[1:]))
    trip = np.cumsum(np.append(True, begins[1:])) - 1
    first = np.flatnonzero(np.append(True, begins[1:]))
    many = np.diff(np.append(first, len(cell)))
    low, top = np.minimum.reduceat(np.where(known, cell, USER), first), np.maximum.reduceat(np.where(known, cell, -USER), first)
    index = np.flatnonzero(high & known & (many[trip] >= 3) & table.column("user_id").is_valid().to_numpy())
    index = index[np.argsort(user[index] * USER + cell[index], kind="stable")]
    keys, gaps = user[index] * USER + cell[index], np.flatnonzero(table.column("gap").to_numpy())
    ends = np.stack([near[gaps], cell[gaps]], axis=1)
    middle = ends[:, :, None] + np.arange(-2, 3) * GRID_ROWS
    base = user[gaps][:, None, None] * USER + middle
    begin, stop = np.searchsorted(keys, base - 2, "left"), np.searchsorted(keys, base + 2, "right")
    sizes = (stop - begin).reshape(len(gaps), -1)
    both = (sizes[:, :5].any(axis=1) & sizes[:, 5:].any(axis=1)) if len(gaps) else np.empty(0, bool)
    filler, since, until = np.full(len(gaps), -1), np.zeros(len(gaps), np.int64), np.zeros(len(gaps), np.int64)
    asked = np.flatnonzero(both)
    ahead = np.cumsum(sizes[asked].sum(axis=1)) if len(asked) else empty
    a = 0
    while a < len(asked):
        b = max(a + 1, int(np.searchsorted(ahead, (ahead[a - 1] if a else 0) + MATCHES, "right")))
        g, a = asked[a:b], b
        n = sizes[g].ravel()
        range_ = np.repeat(np.arange(len(n)), n)
        met = index[np.repeat(begin[g].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        gap, end, off = g[range_ // 10], range_ % 10 // 5, np.abs(range_ % 5 - 2)
        level = np.maximum(off, np.abs(cell[met] - middle[g].ravel()[range_]))
        by = trip[met]
        inside = (top[by] >= ends[gap].min(axis=1) - (GRID_ROWS + 2)) & (low[by] <= ends[gap].max(axis=1) + GRID_ROWS + 2)
        pair, of = np.unique((gap * len(first) + by)[inside], return_inverse=True)
        at, end, level = (met - first[by])[inside], end[inside], level[inside]
        span = np.full((2, len(pair)), -1)
        for k in range(3):
            passed = np.full((2, len(pair)), -1 if k else USER)
            now = level <= k
            (np.maximum if k else np.minimum).at(passed, (end[now], of[now]), at[now])
            found = ((passed >= 0) & (passed < USER)).all(axis=0) & (span[0] < 0)
            span[:, found] = passed[:, found]
        pair, span = pair[span[0] >= 0], span[:, span[0] >= 0]
        gap, one = np.unique(pair // len(first), return_index=True)
        filler[gap], since[gap], until[gap] = pair[one] % len(first), span[0, one], span[1, one]
    own = np.flatnonzero(~high)
    size, source = np.ones(len(cell), np.int64), np.arange(len(cell))
    full = np.flatnonzero(filler >= 0)
    size[gaps[full]], source[gaps[full]] = np.maximum(0, until[full] - since[full]), first[filler[full]] + since[full]
    n = size[own]
    rows = np.repeat(own, n)
    cells = np.repeat(source[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    of = trip[rows]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else empty
    return rows, cells, np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))


def lat_lon(points: DataFrame) -> DataFrame:
    """Points as latitude, longitude beside their keys."""
    return points.select("user_id", "trip_id", "ping_id", "lat", "lon")


def in_box(points: DataFrame, west: float, east: float) -> DataFrame:
    return points.where(F.col("lon").between(west, east))


def count_entities(points: DataFrame) -> DataFrame:
    """Distinct users, and distinct trips of users, through one row a trip."""
    per_user = points.select("user_id", "trip_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_trips"))


def avg_distance(ends: DataFrame) -> DataFrame:
    """Mean km from end to end of each user's trips."""
    return ends.groupBy("user_id").agg(F.avg(haversine_km(F.col("s_lat"), F.col("s_lon"), F.col("t_lat"), F.col("t_lon"))).alias("distance"))


def lon_series(points: DataFrame, west: float, east: float, step: float) -> DataFrame:
    """(user_id, trip_id, seq, slot, lat): runs of points in one slot of longitude, with their mean latitude."""
    slots = in_box(points, west, east).withColumn("slot", ((F.col("lon") - west) / step).cast("int"))
    run = F.sum(F.when(F.col("_was").isNull() | (F.col("_was") != F.col("slot")), 1).otherwise(0)).over(by_trip())
    runs = slots.withColumn("_was", F.lag("slot").over(by_trip())).withColumn("seq", run - 1)
    return runs.groupBy("user_id", "trip_id", "seq", "slot").agg(F.avg("lat").alias("lat"))


def first_users(trips: DataFrame, n: int = 50) -> DataFrame:
    """Rows of the first ``n`` users by id."""
    return keep(trips, trips.select("user_id").distinct().orderBy("user_id").limit(n), ["user_id"])


def all_users(*parts: DataFrame) -> DataFrame:
    """Users of any of the parts."""
    out = parts[0].select("user_id")
    for more in parts[1:]:
        out = out.union(more.select("user_id"))
    return out.distinct()


def common_users(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("user_id").intersect(b.select("user_id"))


def concatenate(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns go by name."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sorted_by_user(points: DataFrame) -> DataFrame:
    """A user's points in one partition, in order of time."""
    return points.repartition("user_id").sortWithinPartitions("user_id", "ts", "ping_id")


def trips_top_od_grid(points: DataFrame, least: int = 13) -> DataFrame:
    """Points of the trips of each user's commonest pair of cells, the least of equal ones, if it has ``least`` trips."""
    cells = od_grid_trips(points)
    counts = cells.groupBy("user_id", "o_grid", "d_grid").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "o_grid", "d_grid"))
    top = counts.withColumn("_rank", rank).where((F.col("_rank") == 1) & (F.col("n") >= least))
    return keep(points, keep(cells, top, ["user_id", "o_grid", "d_grid"]), ["user_id", "trip_id"])


def trips_frequent_od(points: DataFrame, least: int = 13, apart: int = 10) -> DataFrame:
    """(user_id, trip_id, o_grid, d_grid) of the trips of all pairs of cells that are ``apart`` cells from each other and have ``least`` trips of a user."""
    cells = od_grid_trips(points).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "o_grid", "d_grid")))
    return cells.where((F.col("_n") >= least) & (grid_manhattan(F.col("o_grid"), F.col("d_grid")) >= apart)).select("user_id", "trip_id", "o_grid", "d_grid")


def block_sequence(points: DataFrame, blocks: DataFrame, cell: float = CELL) -> DataFrame:
    """Each trip's blocks in order, without repeats in a row: points look the block of their cell's borders up, and those without one go.

    blocks: block_id, min_lon, max_lon, min_lat, max_lat. The result has the first point of each run.
    The blocks are written first, so Spark knows how few they are and leaves the points where they are.
    """
    blocks = materialise(blocks, "blocks")
    bounds = grid_bounds(F.col("lon"), F.col("lat"), cell)
    named = points.withColumns(bounds).join(blocks, list(bounds)).drop(*bounds)
    order = Window.partitionBy("user_id", "trip_id").orderBy("ts", "ping_id")
    return named.withColumn("_was", F.lag("block_id").over(order)).where("_was is null or _was <> block_id").drop("_was")
