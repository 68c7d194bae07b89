"""Main routes: trip shapes, pairwise distances, clusters, assignment of sparse trips, cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingmill.functions.geo import EARTH_KM, PLANAR, euclid
from pingmill.functions.storage import materialise
from pingmill.operators.components import connected_components
from pingmill.operators.trips import drop, keep, legs

TRIP = ["user_id", "trip_id"]
#: Steps to half of the cells up to two apart; the others are the same pairs seen from the other side.
FORWARD = [(x, y) for x in range(3) for y in range(-2, 3) if (x, y) > (0, 0)]
#: A cell's number is its column times this, plus its row.
ROWS = 1 << 21


def high_res_trips(points: DataFrame, most_km: float = 1.0) -> DataFrame:
    """(user_id, trip_id) of trips whose largest leg is at most ``most_km``; one-point trips are none."""
    return legs(points).groupBy(*TRIP).agg(F.max("leg_km").alias("largest")).where(F.col("largest") <= most_km).select(*TRIP)


def mark_high_res(points: DataFrame, most_km: float = 1.0) -> DataFrame:
    """Points with ``high_res``, whether their trip is one of ``high_res_trips``, in the pass that finds the legs."""
    largest = F.max("leg_km").over(Window.partitionBy(*TRIP))
    return legs(points).withColumn("high_res", F.coalesce(largest <= most_km, F.lit(False))).drop("leg_s", "leg_km")


def resample_linear(points: DataFrame, n: int = 100) -> DataFrame:
    """``n`` points at even index positions of each trip, by straight lines between its points."""
    order = Window.partitionBy(*TRIP).orderBy("ts", "ping_id")
    at = points.select(*TRIP, "lon", "lat", (F.row_number().over(order) - 1).alias("i"), F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2"), F.count(F.lit(1)).over(Window.partitionBy(*TRIP)).alias("m"))
    step = (F.col("m") - 1) / (n - 1)
    ks = F.sequence(F.ceil(F.col("i") / step), F.least(F.lit(n - 1), F.ceil((F.col("i") + 1) / step) - 1))
    inner = at.where("lon2 is not null").withColumn("k", F.explode(ks)).withColumn("t", F.col("k") * step - F.col("i"))
    body = inner.where("t >= 0 and t < 1").select(*TRIP, "k", (F.col("lon") + (F.col("lon2") - F.col("lon")) * F.col("t")).alias("lon"), (F.col("lat") + (F.col("lat2") - F.col("lat")) * F.col("t")).alias("lat"))
    last = at.where("lon2 is null").select(*TRIP, F.lit(n - 1).cast("long").alias("k"), "lon", "lat")
    return body.where(F.col("k") < n - 1).unionByName(last)


def _spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the rows of y at 0, 1, 2, ... without knots next to the ends, in linear time; columns are apart.

    Without those knots the second derivative at 1 is a sixth of its right side, and so is the last but one;
    the others follow from elimination forwards and substitution backwards.
    """
    n = len(y)
    m = np.zeros_like(y)
    m[1:-1] = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    m[1] /= 6
    if n > 4:
        m[-2] /= 6
        pivot = [0.0] * n
        for k in range(2, n - 2):
            pivot[k] = 1 / (4 - pivot[k - 1])
            m[k] = (m[k] - m[k - 1]) * pivot[k]
        for k in range(n - 3, 1, -1):
            m[k] -= pivot[k] * m[k + 1]
    elif n == 4:
        m[2] /= 6
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    i = np.minimum(at.astype(int), n - 2)
    t = (at - i)[:, None]
    return y[i] * (1 - t) + y[i + 1] * t + ((1 - t) ** 3 - (1 - t)) * m[i] / 6 + (t**3 - t) * m[i + 1] / 6


def _any_near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of ``a`` and one of ``b`` are within ``eps``: boxes that are near or far as a whole decide, others are halved."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        low, high = np.minimum.reduce, np.maximum.reduce
        a0, a1, b0, b1 = low(a), high(a), low(b), high(b)
        if np.hypot(*np.maximum(0, np.maximum(b0 - a1, a0 - b1))) > eps:
            continue
        if np.hypot(*np.maximum(b1 - a0, a1 - b0)) <= eps:
            return True
        if len(a) * len(b) <= 4096:
            if (np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) <= eps).any():
                return True
            continue
        halved, other = (a, b) if len(a) >= len(b) else (b, a)
        axis = int(np.argmax(np.ptp(halved, axis=0)))
        order = np.argpartition(halved[:, axis], len(halved) // 2)
        stack += [(halved[half], other) for half in (order[: len(order) // 2], order[len(order) // 2 :])]
    return False


def _collapsed(xy: np.ndarray, eps: float) -> np.ndarray:
    """Points replaced by the centroid of their chain of points within ``eps``, without repeats in a row.

    Points of one cell of eps / sqrt 2 are within eps of each other; cells up to two apart are linked if some of their points are.
    """
    cell, inside = np.unique(np.floor(xy / (eps / np.sqrt(2) * (1 - 1e-9))).astype(np.int64), axis=0, return_inverse=True)
    inside = inside.ravel()
    order = np.argsort(inside, kind="stable")
    members = np.split(xy[order], np.cumsum(np.bincount(inside))[:-1])
    at = {c: k for k, c in enumerate(map(tuple, cell.tolist()))}
    root = list(range(len(cell)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for (x, y), k in at.items():
        for dx, dy in FORWARD:
            other = at.get((x + dx, y + dy))
            if other is not None and find(k) != find(other) and _any_near(members[k], members[other], eps):
                root[find(k)] = find(other)
    label = np.array([find(k) for k in range(len(cell))])[inside]
    many = np.maximum(np.bincount(label, minlength=len(cell)), 1)
    centre = np.column_stack([np.bincount(label, xy[:, c], len(cell)) / many for c in (0, 1)])[label]
    return centre[np.append(True, (label[1:] != label[:-1]))]


def _equal(size: np.ndarray, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines of equal sizes and the places of their points (lines, points), so many that ``cells`` hold the pairs of points of each line."""
    begin = np.cumsum(size) - size
    for n in np.unique(size):
        rows, step = np.flatnonzero(size == n), max(1, cells // max(1, int(n)) ** 2)
        for k in range(0, len(rows), step):
            yield rows[k : k + step], begin[rows[k : k + step]][:, None] + np.arange(n)


def _taken(xy: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and sizes of some of the lines, in the order of ``rows``."""
    begin, n = (np.cumsum(size) - size)[rows], size[rows]
    return xy[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


#: Lines of more points are collapsed one by one.
SHORT = 64


def _all_collapsed(xy: np.ndarray, size: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``_collapsed`` of lines of ``size`` points each; short lines of equal sizes are reckoned together."""
    centre, kept, whole = np.empty_like(xy), np.zeros(len(xy), bool), np.isfinite(xy).all(axis=1)
    for rows, at in _equal(size):
        n = at.shape[1]
        if n > SHORT or not whole[at].all():
            for line in at:
                steps = _collapsed(xy[line], eps)
                centre[line[: len(steps)]], kept[line[: len(steps)]] = steps, True
            continue
        p = xy[at]
        near = np.hypot(p[:, :, None, 0] - p[:, None, :, 0], p[:, :, None, 1] - p[:, None, :, 1]) <= eps
        label = np.tile(np.arange(n), (len(rows), 1))
        linked = np.flatnonzero(near.sum(axis=(1, 2)) > n)
        while len(linked):
            own = label[linked]
            least = np.where(near[linked], own[:, None, :], n).min(axis=2)
            least = np.take_along_axis(least, least, axis=1)
            label[linked] = least
            linked = linked[(least != own).any(axis=1)]
        code = (np.arange(len(rows))[:, None] * n + label).ravel()
        many = np.maximum(np.bincount(code, minlength=len(code)), 1)
        for c in (0, 1):
            centre[at, c] = (np.bincount(code, p[:, :, c].ravel(), len(code)) / many)[code].reshape(at.shape)
        kept[at] = np.column_stack([np.ones(len(rows), bool), label[:, 1:] != label[:, :-1]])
    return centre[kept], np.add.reduceat(kept, np.cumsum(size) - size, dtype=np.int64) if len(size) else size


Trace = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def splines(n: int = 100, eps: float | None = None) -> Trace:
    """Points and sizes of lines to those of ``smooth_traces``."""

    def trace(xy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, left = _all_collapsed(xy, size, eps) if eps else (xy, size)
        smooth = left >= 4
        out = np.where(smooth, n, size)
        lines, begin = np.empty((int(out.sum()), 2)), np.cumsum(out) - out
        same, n_same = _taken(xy, size, np.flatnonzero(~smooth))
        lines[np.repeat(~smooth, out)] = same
        for rows, at in _equal(np.where(smooth, left, 0)):
            if at.shape[1]:
                first = (np.cumsum(left) - left)[rows]
                y = steps[first + np.arange(at.shape[1])[:, None]].reshape(at.shape[1], -1)
                drawn = _spline(y, np.linspace(0, at.shape[1] - 1, n)).reshape(n, len(rows), 2)
                lines[begin[rows][:, None] + np.arange(n)] = drawn.transpose(1, 0, 2)
        return lines, out

    return trace


def smooth_traces(points: DataFrame, n: int = 100, eps: float | None = None) -> DataFrame:
    """Each trip as ``n`` points of a cubic spline over its points, collapsed within ``eps`` if given; trips of less than four stay as they are.

    points: user_id, trip_id, k (order), lon, lat. A trip is one array; trips have hundreds of points. Those of equal sizes are reckoned together.
    """
    trace = splines(n, eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            xy, size = trace(np.column_stack([batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3)]), size)
            trip, ks = pa.array(np.repeat(np.arange(len(size)), size)), np.arange(len(xy)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(trip) for k in (0, 1)), pa.array(ks), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=[*TRIP, "k", "lon", "lat"])

    whole = points.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))
    lines = whole.select(*(F.col(c).cast("long") for c in TRIP), *(F.col(f"p.{c}").cast("array<double>").alias(c) for c in ("lon", "lat")))
    return lines.mapInArrow(run, "user_id long, trip_id long, k long, lon double, lat double")


def collapse(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points replaced by their cluster's centroid, without repeats in a row; labels: points' keys with label, c_lon, c_lat."""
    order = Window.partitionBy(*TRIP).orderBy("ts", "ping_id")
    joined = points.join(labels, [*TRIP, "ping_id"])
    flagged = joined.withColumn("_was", F.lag("label").over(order)).where("_was is null or _was <> label")
    return flagged.select(*TRIP, F.row_number().over(order).alias("k"), F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat"))


def _trip(trip: list[str]) -> Column:
    return F.col(trip[0]) if len(trip) == 1 else F.struct(*trip)


def _shaped(points: DataFrame, group: list[str], trip: list[str]) -> DataFrame:
    """Per trip an array of (lon, lat, along, position) by k; position 0 for trips without length."""
    keys = [*group, *trip]
    order = Window.partitionBy(*keys).orderBy("k")
    leg = euclid(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    run = points.withColumn("_leg", F.coalesce(leg, F.lit(0.0))).withColumn("along", F.sum("_leg").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = run.withColumn("_all", F.max("along").over(Window.partitionBy(*keys)))
    placed = whole.withColumn("position", F.when(F.col("_all") > 0, F.col("along") / F.col("_all")).otherwise(0.0))
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat", "along", "position"))).alias("p")).select(*group, _trip(trip).alias("trip"), "p")


def _needed(rank: float) -> Column:
    """How many points of a trip ``n`` decide its distance: those up to the rank."""
    return (F.least(F.floor(F.col("n") * rank), F.col("n") - 1) + 1).cast("int")


def _celled(shapes: DataFrame, within: float) -> DataFrame:
    """Adds n, the numbers of the points' cells (codes), and those of all cells around them (around)."""
    size = within * PLANAR * (1 + 1e-9)
    code = lambda p: F.floor(p["lon"] / size) * ROWS + F.floor(p["lat"] / size)
    return shapes.withColumns({"n": F.size("p"), "codes": F.transform("p", code)}).withColumn("around", _cells_around(F.col("codes")))


def _cells_around(codes: Column) -> Column:
    steps = F.array(*(F.lit(x * ROWS + y).cast("long") for x in (-1, 0, 1) for y in (-1, 0, 1)))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(codes), lambda c: F.transform(steps, lambda d: c + d))))


def candidate_pairs(celled: DataFrame, rank: float = 0.88, group: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """(group, trip_i, trip_j), trip_i < trip_j: a superset of the pairs within the distance that the cells were made for.

    So many points of i as decide the distance must lie in cells around j. Then of i's rarest cells, taken
    until they hold more points than may miss, one at least is around j: only these cells are joined, not
    the common ones where all trips begin. What is found is counted over all points of i.
    """
    cells = celled.select(*group, "trip", "n", F.explode("codes").alias("code")).groupBy(*group, "trip", "code").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    around = celled.select(*group, "trip", F.explode("around").alias("code"))
    trips = around.groupBy(*group, "code").agg(F.count(F.lit(1)).alias("trips"))
    order = Window.partitionBy(*group, "trip").orderBy("trips", "code").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(order), F.lit(0))
    rare = cells.join(trips, [*group, "code"]).withColumn("_before", before).where(F.col("_before") <= F.col("n") - _needed(rank))
    met = rare.select(*group, "code", F.col("trip").alias("trip_i")).join(around.withColumnRenamed("trip", "trip_j"), [*group, "code"]).where("trip_i < trip_j")
    pairs = met.select(*group, "trip_i", "trip_j").distinct()
    i = celled.select(*group, F.col("trip").alias("trip_i"), "n", "codes")
    j = celled.select(*group, F.col("trip").alias("trip_j"), F.col("around").alias("_around"))
    near = F.size(F.filter("codes", lambda c: F.array_contains("_around", c)))
    return pairs.join(i, [*group, "trip_i"]).join(j, [*group, "trip_j"]).where(near >= _needed(rank)).select(*group, "trip_i", "trip_j")


def route_distances(points: DataFrame, window: float = 2.0, rank: float = 0.88, within: float | None = None, group: list[str] = ["user_id"], trip: list[str] = ["trip_id"]) -> DataFrame:  # noqa: B006
    """(group, trip_i, trip_j, dist), trip_i < trip_j: the modified Hausdorff distance of each pair of a group's trips.

    For each point of i: the partner in j of nearest position, the first of equal ones; among j's points
    within window / 2 of it along the trip, the least distance. The distance is the value at ``rank``.
    ``within``: pairs that are farther may be left out. ``trip`` columns name a trip in its group; if there are several,
    trip_i and trip_j are structs of them, and ``within`` forms only ``candidate_pairs``. The trips of one user are compared in blocks.
    """
    shapes = _shaped(points, group, trip)
    if trip == ["trip_id"]:
        return _block_pairs(shapes, group, ["lon", "lat", "along", "position"], "dist", lambda a, b: _distances(a, b, window, rank), within)
    if within is None:
        i, j = (shapes.select(*group, F.col("trip").alias(f"trip_{x}"), F.col("p").alias(f"{x}{y}")) for x, y in ("ia", "jb"))
        pairs = i.join(j, group).where("trip_i < trip_j")
    else:
        shapes = materialise(_celled(shapes, within), "shapes")
        i, j = (shapes.select(*group, F.col("trip").alias(f"trip_{x}"), F.col("p").alias(f"{x}{y}")) for x, y in ("ia", "jb"))
        pairs = candidate_pairs(shapes, rank, group).join(i, [*group, "trip_i"]).join(j, [*group, "trip_j"])
    return _measured(pairs, [*group, "trip_i", "trip_j"], window, rank)


def _measured(pairs: DataFrame, names: list[str], window: float, rank: float) -> DataFrame:
    """``names`` and dist of each row's trips ``ia`` and ``jb``; rows of equal sizes are reckoned together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[len(names) :]
            sizes = [columns[k].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4)]
            begins = [np.cumsum(x) - x for x in sizes]
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in columns]
            dist, kind = np.empty(batch.num_rows), sizes[0] * (1 << 32) + sizes[1]
            for one in np.unique(kind):
                rows = np.flatnonzero(kind == one)
                n, m = (int(x[rows[0]]) for x in sizes)
                step = max(1, CELLS // (n * m))
                for k in range(0, len(rows), step):
                    r = rows[k : k + step]
                    left, right = (np.stack([f[begin[r][:, None] + np.arange(w)] for f in own], axis=1) for own, begin, w in ((flat[:4], begins[0], n), (flat[4:], begins[1], m)))
                    dist[r] = _distances(left, right, window, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(dist, pa.float64())], names=[*names, "dist"])

    fields = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("ia", "jb") for c in ("lon", "lat", "along", "position")]
    schema = T.StructType([*pairs.select(*names).schema.fields, T.StructField("dist", T.DoubleType())])
    return pairs.select(*names, *fields).mapInArrow(run, schema)


#: Trips of a block, and cells of the arrays that compare a block's pairs at once.
BLOCK, CELLS = 200, 1 << 18


def _block_pairs(shapes: DataFrame, group: list[str], fields: list[str], name: str, values: Callable[[np.ndarray, np.ndarray], np.ndarray], most: float | None = None) -> DataFrame:
    """(group, trip_i, trip_j, name), trip_i < trip_j, of all pairs of a group's trips, or of those of a value up to ``most``.

    shapes: group, trip (a number), p (points in order). A group's trips are dealt into blocks of some ``BLOCK``, and a pair of
    blocks is one row of arrays: a trip moves once for each block of its group, never once for each pair.
    ``values`` takes the ``fields`` of pairs of trips of equal sizes: (pairs, fields, points) on either side.
    """
    names = [*group, "trip_i", "trip_j", name]
    own = shapes.select(*group, "trip", F.struct(*(F.col(f"p.{c}").alias(c) for c in fields)).alias("p"))
    sizes = shapes.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = own.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64("trip"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high")
    tiles = dealt.groupBy(*group, low, high).agg(F.collect_list(F.struct("trip", "_own", "p")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, i, j, out, lists = [], [], [], [], batch.column(len(group) + 2)
            members, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            trips, blocks = (members.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            lines = [members.field(2).field(k) for k in range(len(fields))]
            length, flat = lines[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [x.flatten().to_numpy(zero_copy_only=False) for x in lines]
            begin = np.cumsum(length) - length
            lows, highs = (batch.column(len(group) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                order = a + np.argsort(trips[a:b], kind="stable")
                x, y = np.triu_indices(b - a, 1)
                x, y = order[x], order[y]
                if lows[k] != highs[k]:
                    across = blocks[x] != blocks[y]
                    x, y = x[across], y[across]
                tile.append(np.full(len(x), k)), i.append(x), j.append(y)
                if k + 1 < len(ends) and sum(map(len, i)) < CELLS // 16:
                    continue
                at, x, y = map(np.concatenate, (tile, i, j))
                tile, i, j = [], [], []
                value = np.empty(len(x))
                kind = length[x] * (1 << 32) + length[y]
                for one in np.unique(kind):
                    rows = np.flatnonzero(kind == one)
                    n, m = int(length[x[rows[0]]]), int(length[y[rows[0]]])
                    step = max(1, CELLS // (n * m))
                    for s in range(0, len(rows), step):
                        r = rows[s : s + step]
                        left, right = (np.stack([f[begin[z[r]][:, None] + np.arange(w)] for f in flat], axis=1) for z, w in ((x, n), (y, m)))
                        value[r] = values(left, right)
                kept = np.arange(len(x)) if most is None else np.flatnonzero(value <= most)
                at = pa.array(at[kept])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(group))), pa.array(trips[x[kept]]), pa.array(trips[y[kept]]), pa.array(value[kept])], names=names)

    kinds = shapes.schema
    schema = T.StructType([*(kinds[g] for g in group), *(T.StructField(c, kinds["trip"].dataType) for c in names[len(group) : -1]), T.StructField(name, T.DoubleType())])
    return tiles.select(*group, "_low", "_high", "m").mapInArrow(run, schema)


def _distances(a: np.ndarray, b: np.ndarray, window: float, rank: float) -> np.ndarray:
    """``_distance`` of pairs of trips of equal sizes: (pairs, 4, points)."""
    square = (a[:, 0, :, None] - b[:, 0, None, :]) ** 2 + (a[:, 1, :, None] - b[:, 1, None, :]) ** 2
    if not (b[:, 2] <= window / 2).all():  # else the window around any partner holds all of the other trip
        partner = np.abs(a[:, 3, :, None] - b[:, 3, None, :]).argmin(axis=2)
        near = np.abs(np.take_along_axis(b[:, 2], partner, axis=1)[:, :, None] - b[:, 2, None, :]) <= window / 2
        square = np.where(near, square, np.inf)
    least = np.sort(np.sqrt(square.min(axis=2)) / PLANAR, axis=1)
    return least[:, min(int(least.shape[1] * rank), least.shape[1] - 1)]


def _distance(a: tuple, b: tuple, window: float, rank: float) -> float:
    """lon, lat, along and position of two trips' points in order."""
    partner = np.abs(a[3][:, None] - b[3]).argmin(axis=1)
    near = np.abs(b[2][partner][:, None] - b[2]) <= window / 2
    square = (a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2
    least = np.sort(np.sqrt(np.where(near, square, np.inf).min(axis=1)) / PLANAR)
    return float(least[min(int(len(least) * rank), len(least) - 1)])


def cluster_pairs(pairs: DataFrame, eps: float = 0.002, min_pts: int = 1, group: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """(group, trip_id, label) of components of pairs within ``eps``; trips without one are left out, for ``min_pts`` 1 too.

    Callers that keep single trips join the labels from the left and give a single trip its own id.
    """
    edges = pairs.where(F.col("dist") <= eps).select(*group, F.col("trip_i").alias("src"), F.col("trip_j").alias("dst"))
    return connected_components(edges, group).select(*group, F.col("node").alias("trip_id"), "label")


#: Distance within which points of a trace are one.
NEAR = 0.001


def shapes(points: DataFrame, high: DataFrame, samples: int = 100, near: float = NEAR) -> DataFrame:
    """user_id, trip_id, k, lon, lat of the smoothed traces of the trips in ``high``."""
    order = Window.partitionBy(*TRIP).orderBy("ts", "ping_id")
    return smooth_traces(keep(points, high, TRIP).withColumn("k", F.row_number().over(order)), samples, near)


def trip_lines(points: DataFrame, most_km: float = 1.0) -> DataFrame:
    """(user_id, trip_id, high, lon, lat): a trip's points in order as two arrays, and whether it is one of ``high_res_trips``."""
    order = F.array_sort(F.collect_list(F.struct("ts", "ping_id", "lon", "lat")))
    rows = legs(points).groupBy(*TRIP).agg(order.alias("p"), F.max("leg_km").alias("largest"))
    return rows.select(*TRIP, F.coalesce(F.col("largest") <= most_km, F.lit(False)).alias("high"), *(F.col(f"p.{c}").cast("array<double>").alias(c) for c in ("lon", "lat")))


def shaped_lines(shaped: DataFrame) -> DataFrame:
    """``trip_lines`` of traces (user_id, trip_id, k, lon, lat), all of them high."""
    rows = shaped.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))
    return rows.select(*TRIP, F.lit(True).alias("high"), *(F.col(f"p.{c}").cast("array<double>").alias(c) for c in ("lon", "lat")))


def linear(n: int = 100) -> Trace:
    """Points and sizes of lines to those of ``resample_linear``."""

    def trace(xy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, at = (np.cumsum(size) - size)[:, None], np.arange(n) * ((size - 1) / (n - 1))[:, None]
        i = np.minimum(np.floor(at).astype(np.int64), np.maximum(size[:, None] - 2, 0))
        a, b = xy[begin + i], xy[begin + np.minimum(i + 1, size[:, None] - 1)]
        lines = a + (b - a) * (at - i)[:, :, None]
        lines[:, -1] = xy[begin[:, 0] + size - 1]
        kept = (size[:, None] > 1) | (np.arange(n) == n - 1)
        return lines[kept], kept.sum(axis=1)

    return trace


def as_given(xy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return xy, size


def _placed(xy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lon, lat, along and position of each point; position 0 on lines without length."""
    out = np.zeros((4, len(xy)))
    out[:2] = xy.T
    for _, at in _equal(size):
        p = xy[at]
        along = np.zeros(at.shape)
        leg = np.sqrt((p[:, 1:, 0] - p[:, :-1, 0]) ** 2 + (p[:, 1:, 1] - p[:, :-1, 1]) ** 2) / PLANAR
        np.cumsum(np.where(np.isnan(leg), 0, leg), axis=1, out=along[:, 1:])
        whole = along.max(axis=1, keepdims=True)
        out[2, at], out[3, at] = along, np.divide(along, whole, out=np.zeros(at.shape), where=whole > 0)
    return out


def _meeting(first: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row k with ``first[k]`` and the ``many[k]`` - 1 rows after it, so many at once that they stay few."""
    ends = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
        n = many[a:b]
        yield np.repeat(np.arange(a, b), n), np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a = b


def _near_pairs(lines: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float, window: float, rank: float) -> np.ndarray:
    """Which pairs of lines x, y are within ``eps``. Of a pair only the box is looked at if too few points of x are that near to the box of y."""
    begin, found, kind = np.cumsum(size) - size, np.zeros(len(x), bool), size[x] * (1 << 32) + size[y]
    low, high = (f.reduceat(lines[:2], begin, axis=1) for f in (np.fmin, np.fmax)) if len(size) else (lines[:2], lines[:2])
    reach = eps * PLANAR * (1 + 1e-9)
    for one in np.unique(kind):
        rows = np.flatnonzero(kind == one)
        n, m = int(size[x[rows[0]]]), int(size[y[rows[0]]])
        needed, step = min(int(n * rank), n - 1) + 1, max(1, CELLS // n)
        inside = []
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            p, b0, b1 = lines[:2, begin[x[r]][:, None] + np.arange(n)], low[:, y[r], None] - reach, high[:, y[r], None] + reach
            inside.append(r[((p >= b0) & (p <= b1)).all(axis=0).sum(axis=1) >= needed])
        rows, step = np.concatenate(inside), max(1, CELLS // (n * m))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            left, right = (lines[:, begin[z[r]][:, None] + np.arange(w)].transpose(1, 0, 2) for z, w in ((x, n), (y, m)))
            found[r] = _distances(left, right, window, rank) <= eps
    return found


def _least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number that pairs lead to, of 0 to n - 1 each."""
    label = np.arange(n)
    while len(x):
        least, own = np.minimum(label[x], label[y]), label
        label = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == own).all():
            break
    return label


def _farthest(low: np.ndarray, n_low: np.ndarray, high: np.ndarray, n_high: np.ndarray, x: np.ndarray, y: np.ndarray, most_km: float) -> np.ndarray:
    """km from each low line x to its high line y: the greatest over x's points of the least to y's; inf if it is over ``most_km``. Points without a place do not count.

    The sines of half the angles to the box of y are a lower bound that most pairs end with.
    """
    begin, other, km, kind = np.cumsum(n_low) - n_low, np.cumsum(n_high) - n_high, np.full(len(x), np.inf), n_low[x] * (1 << 32) + n_high[y]
    b0, b1 = (f.reduceat(high, other, axis=0) for f in (np.fmin, np.fmax)) if len(n_high) else (high, high)
    flat = np.minimum(np.cos(np.radians(b0[:, 1])), np.cos(np.radians(b1[:, 1])))
    bound = sin(min(most_km / EARTH_KM / 2, pi / 2)) ** 2 * (1 + 1e-9) + 1e-18
    for one in np.unique(kind):
        rows = np.flatnonzero(kind == one)
        n, m = int(n_low[x[rows[0]]]), int(n_high[y[rows[0]]])
        step, open_ = max(1, CELLS // n), []
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            p, c0, c1 = low[begin[x[r]][:, None] + np.arange(n)], b0[y[r], None], b1[y[r], None]
            off = np.radians(np.maximum(0, np.maximum(c0 - p, p - c1)))
            side = np.where(c1[:, :, 0] - c0[:, :, 0] + off[:, :, 0] < 180, np.sin(off[:, :, 0] / 2) ** 2, 0)
            least = np.sin(off[:, :, 1] / 2) ** 2 + np.cos(np.radians(p[:, :, 1])) * flat[y[r], None] * side
            open_.append(r[~(least > bound).any(axis=1)])
        rows = np.concatenate(open_)
        if n * m > CELLS:
            for r in rows:
                a, b = low[begin[x[r]] :][:n], high[other[y[r]] :][:m]
                found = _farthest_km(a[:, 0], a[:, 1], b[:, 0], b[:, 1], most_km)
                km[r] = np.inf if found is None else found
            continue
        step = max(1, CELLS // (n * m))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            p, q = low[begin[x[r]][:, None] + np.arange(n)], high[other[y[r]][:, None] + np.arange(m)]
            a, b = np.radians(p[:, :, 1]), np.radians(q[:, :, 1])
            up = np.sin((b[:, None, :] - a[:, :, None]) / 2) ** 2
            east = np.sin(np.radians(q[:, None, :, 0] - p[:, :, None, 0]) / 2) ** 2
            square = up + np.cos(a)[:, :, None] * np.cos(b)[:, None, :] * east
            km[r] = np.fmax.reduce(2 * EARTH_KM * np.arcsin(np.sqrt(np.fmin.reduce(square, axis=2))), axis=1)
    return np.where(km <= most_km, km, np.inf)


def _related(lines: DataFrame, trace: Trace, eps: float | None, most_km: float | None = None, window: float = 2.0, rank: float = 0.88) -> DataFrame:
    """(user_id, trip_id, high, label, other, km, blocks): what a user's trips are to each other, written once.

    lines: user_id, trip_id, high, lon, lat. A high trip's label is the first trip that pairs of traces within ``eps`` lead to. ``other`` is
    the nearest high trip, the last of equal ones, within ``most_km`` of all points of a trip that is not high, and label that trip's.
    Trips are dealt into blocks of some ``BLOCK``; a pair of blocks is one row, so a user of one block is settled by one row, and
    of others a trip has a result of each pair of blocks. Tables dealt by user are not moved.
    """
    kinds = lines.schema
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("user_id")) / BLOCK).cast("int")
    dealt = lines.withColumn("blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("trip_id"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high")
    tiles = dealt.groupBy("user_id", "blocks", *pair).agg(F.collect_list(F.struct("trip_id", "_own", "high", "lon", "lat")).alias("m"))
    names = [*TRIP, "high", "label", "other", "km", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, many = batch.column(4).flatten(), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            tile, trip, own, high = np.repeat(np.arange(len(many)), many), *(members.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            size = members.field(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            xy = np.column_stack([members.field(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4)])
            order = np.lexsort((trip, tile))
            tile, trip, own, high = tile[order], trip[order], own[order], high[order].astype(bool)
            whole = (batch.column(2).to_numpy(zero_copy_only=False) == batch.column(3).to_numpy(zero_copy_only=False))[tile]
            up, down = np.flatnonzero(high), np.flatnonzero(~high)
            apart = lambda x, y: whole[x] | (own[x] != own[y])  # noqa: B023, E731
            traced, n = trace(*_taken(xy, size, order[up])) if len(up) else (np.empty((0, 2)), np.empty(0, np.int64))
            label = np.arange(len(up))
            if eps is not None:
                links, places, ends = [(np.empty(0, np.int64),) * 2], _placed(traced, n), np.searchsorted(tile[up], tile[up], "right")
                for x, y in _meeting(np.arange(len(up)) + 1, ends - np.arange(len(up)) - 1):
                    met = apart(up[x], up[y])
                    x, y = x[met], y[met]
                    near = _near_pairs(places, n, x, y, eps, window, rank)
                    links.append((x[near], y[near]))
                label = _least_labels(len(up), *map(np.concatenate, zip(*links, strict=True)))
            other, km = np.full(len(trip), -1), np.full(len(trip), np.nan)
            if most_km is not None and len(down) and len(up):
                sparse, n_sparse = _taken(xy, size, order[down])
                first = np.searchsorted(tile[up], tile[down])
                for x, y in _meeting(first, np.searchsorted(tile[up], tile[down], "right") - first):
                    met = apart(down[x], up[y])
                    x, y = x[met], y[met]
                    far = _farthest(sparse, n_sparse, traced, n, x, y, most_km)
                    near = np.flatnonzero(np.isfinite(far))
                    best = near[np.lexsort((-y[near], far[near], x[near]))]
                    best = best[np.unique(x[best], return_index=True)[1]]
                    other[down[x[best]]], km[down[x[best]]] = y[best], far[best]
            named, at = np.full(len(trip), -1), np.flatnonzero(other >= 0)
            named[up], named[at] = up[label], up[label[other[at]]]
            other[at] = up[other[at]]
            ids = lambda k: pa.array(trip[np.maximum(k, 0)], members.field(0).type, mask=k < 0)  # noqa: B023, E731
            tile = pa.array(tile)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(tile), pa.array(trip, members.field(0).type), pa.array(high), ids(named), ids(other), pa.array(km, mask=other < 0), batch.column(1).take(tile)], names=names)

    trip = kinds["trip_id"].dataType
    schema = T.StructType([T.StructField("user_id", kinds["user_id"].dataType), T.StructField("trip_id", trip), T.StructField("high", T.BooleanType()), T.StructField("label", trip), T.StructField("other", trip), T.StructField("km", T.DoubleType()), T.StructField("blocks", T.IntegerType())])
    return materialise(tiles.mapInArrow(run, schema), "related")


def _nearest(found: DataFrame) -> DataFrame:
    """(user_id, trip_id, other) of the trips that are not high, over all pairs of blocks: null where none is near."""
    near = F.when(F.col("other").isNotNull(), F.struct("km", (-F.col("other")).alias("last")))
    return found.where("not high").groupBy(*TRIP).agg(F.min_by("other", near).alias("other"))


def _labelled(found: DataFrame) -> DataFrame:
    """(user_id, trip_id, high, label) of ``_related``: users of several blocks are put together by the components of their blocks' labels."""
    names = [*TRIP, "high", "label"]
    rows, parted = found.where("blocks = 1").select(*names), found.where("blocks > 1")
    if parted.isEmpty():
        return rows
    links = parted.where("high").select("user_id", F.col("trip_id").alias("src"), F.col("label").alias("dst"))
    labels = connected_components(links, ["user_id"])
    near = _nearest(parted).join(labels.withColumnRenamed("node", "other"), ["user_id", "other"], "left")
    return rows.unionByName(labels.select("user_id", F.col("node").alias("trip_id"), F.lit(True).alias("high"), "label")).unionByName(near.select(*TRIP, F.lit(False).alias("high"), "label"))


def _routed(found: DataFrame) -> DataFrame:
    """(user_id, trip_id, high, route_id) of users who have a high trip; routes are numbered from 0 by their first trip, -1 is none."""
    user = Window.partitionBy("user_id")
    route = F.dense_rank().over(user.orderBy(F.col("label").asc_nulls_last())) - 1
    rows = _labelled(found).withColumns({"route_id": F.when(F.col("label").isNull(), -1).otherwise(route), "_some": F.max("high").over(user)})
    return rows.where("_some").select(*TRIP, "high", "route_id")


def main_routes(points: DataFrame, eps: float = 0.002, samples: int = 100, trace: Trace | None = None) -> DataFrame:
    """(user_id, trip_id, route_id) of high-resolution trips; routes are numbered from 0 by their first trip.

    Trips are compared as smoothed traces (``shapes``), or those of ``trace``.
    """
    lines = trip_lines(points).where("high")
    return _routed(_related(lines, trace or splines(samples, NEAR), eps)).select(*TRIP, "route_id")


def _farthest_km(lon: np.ndarray, lat: np.ndarray, h_lon: np.ndarray, h_lat: np.ndarray, most_km: float) -> float | None:
    """The greatest over points of the least distance to the other points; None as soon as it is over ``most_km``."""
    worst, a, b = np.nan, np.radians(lat), np.radians(h_lat)
    for k in range(0, len(a), 64):
        up = np.sin((b[None, :] - a[k : k + 64, None]) / 2) ** 2
        side = np.sin(np.radians(h_lon[None, :] - lon[k : k + 64, None]) / 2) ** 2
        square = up + np.cos(a[k : k + 64, None]) * np.cos(b)[None, :] * side
        worst = np.fmax(worst, np.fmax.reduce(2 * EARTH_KM * np.arcsin(np.sqrt(np.fmin.reduce(square, axis=1)))))
        if worst > most_km:
            return None
    return None if np.isnan(worst) else float(worst)


def assign_low_res(points: DataFrame, routes: DataFrame | None = None, most_km: float = 1.5, shaped: DataFrame | None = None, eps: float = 0.002, trace: Trace | None = None) -> DataFrame:
    """Routes of the other trips of users with main routes: that of the nearest high-resolution trip, the last of equal ones, else -1.

    The distance is the greatest over the trip's points of the least to the other trip's points, which
    are those of its smoothed trace. ``routes``: those of ``main_routes``, which are found on the way if they are not given.
    """
    if routes is None:
        return _routed(_related(trip_lines(points), trace or splines(eps=NEAR), eps, most_km)).where("not high").select(*TRIP, "route_id")
    low = trip_lines(drop(keep(points, routes, ["user_id"]), routes, TRIP)).withColumn("high", F.lit(False))
    high = shaped_lines(keep(shapes(points, routes) if shaped is None else shaped, routes, TRIP))
    found = _nearest(_related(low.unionByName(high), as_given, None, most_km))
    named = routes.select("user_id", F.col("trip_id").alias("other"), "route_id")
    return found.join(named, ["user_id", "other"], "left").select(*TRIP, F.coalesce("route_id", F.lit(-1)).alias("route_id"))


def detect_routes(points: DataFrame, eps: float = 0.002, samples: int = 100, most_km: float = 1.5, trace: Trace | None = None) -> DataFrame:
    """Routes of all trips of users who have a high-resolution trip."""
    return _routed(_related(trip_lines(points), trace or splines(samples, NEAR), eps, most_km)).select(*TRIP, "route_id")


def route_clusters(shaped: DataFrame, eps: float = 0.003) -> DataFrame:
    """(user_id, trip_id, label) of trips that have another within ``eps``: density clusters of two and more."""
    return line_clusters(shaped_lines(shaped), eps)


def line_clusters(lines: DataFrame, eps: float = 0.003, trace: Trace = as_given) -> DataFrame:
    """``route_clusters`` of lines (user_id, trip_id, lon, lat) that are compared as their traces."""
    labels = _labelled(_related(lines.withColumn("high", F.lit(True)), trace, eps))
    return labels.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "label"))).where("_n > 1").select(*TRIP, "label")


CORRIDOR = ["o_zone", "d_zone"]
#: Rounds in which open trips are compared with one trip of another part, before they are with all.
ROUNDS = 3
#: Cells along the limit by which a part's points are told near or far.
FINE = 8


def corridor_shapes(shaped: DataFrame, zoned: DataFrame) -> DataFrame:
    """Traces of the trips of all users with their corridor: the pair of zones of their ends; zoned: user_id, trip_id, o_zone, d_zone."""
    ends = zoned.where("o_zone is not null and d_zone is not null").select(*TRIP, *CORRIDOR)
    return shaped.join(ends, TRIP)


def near_parts(points: DataFrame, within: float, group: list[str], trip: list[str], window: float = 2.0, rank: float = 0.88) -> DataFrame:
    """(group, trip, part) of all trips: parts are the components of ``route_distances`` up to ``within``, named by their first trip.

    Trips of one route are all near each other, so their pairs are not formed. Each trip is compared with the first one
    that has its cells at three places, and these first ones with each other. A trip is then open to another part if as many of its
    points as decide a distance are near cells of that part; open trips are compared with one trip of such a part until that joins no
    more parts, and last with all trips of the parts that are still others. So all pairs that may join two parts are looked at.
    Whether a point is near another part is told from cells of a ``FINE``-th of the limit that the part's points lie in.
    """
    keys, names = [*group, "trip"], [*group, "trip_i", "trip_j"]
    places = F.array(*(F.element_at("codes", F.ceil(F.col("n") * q / 4).cast("int")) for q in (1, 2, 3)))
    size = within * PLANAR * (1 + 1e-9) / FINE
    small = lambda p: F.struct(F.floor(p["lon"] / size).alias("x"), F.floor(p["lat"] / size).alias("y"))
    shapes = materialise(_celled(_shaped(points, group, trip), within).drop("around").withColumns({"key": places, "fine": F.transform("p", small)}), "shapes")
    side = lambda df, x, y: df.select(*group, F.col("trip").alias(f"trip_{x}"), F.col("p").alias(f"{x}{y}"))
    near = lambda pairs: _measured(pairs, names, window, rank).where(F.col("dist") <= within)
    found = lambda pairs: near(pairs.join(side(shapes, "i", "a"), [*group, "trip_i"]).join(side(shapes, "j", "b"), [*group, "trip_j"]))

    least = shapes.groupBy(*group, "key").agg(F.min("trip").alias("trip")).select(*keys)
    firsts = materialise(shapes.join(least, keys, "left_semi"), "firsts")
    named = firsts.select(*group, "key", F.col("trip").alias("trip_i"), F.col("p").alias("ia"))
    same = near(shapes.select(*group, "key", F.col("trip").alias("trip_j"), F.col("p").alias("jb")).join(named, [*group, "key"]).where("trip_i < trip_j"))
    pairs = candidate_pairs(firsts.withColumn("around", _cells_around(F.col("codes"))), rank, group)
    joined = near(pairs.join(side(firsts, "i", "a"), [*group, "trip_i"]).join(side(firsts, "j", "b"), [*group, "trip_j"]))
    tops = connected_components(joined, group, "trip_i", "trip_j").select(*group, F.col("node").alias("own"), F.col("label").alias("top"))
    own = shapes.select(*keys).join(same.select(*group, F.col("trip_j").alias("trip"), "trip_i"), keys, "left").select(*keys, F.coalesce("trip_i", "trip").alias("own"))
    parts = materialise(own.join(tops, [*group, "own"], "left").select(*keys, F.coalesce("top", "own").alias("part")), "parts")

    whole, rounds = False, 0
    while not whole:
        member = shapes.select(*keys, "n", "codes", "fine").join(parts, keys)
        cells = materialise(member.select(*group, "part", F.explode(F.arrays_zip("codes", "fine")).alias("c")).select(*group, "part", F.col("c.codes").alias("code"), "c.fine.x", "c.fine.y").distinct(), "cells")
        around = cells.select(*group, F.col("part").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(_cells_around(F.array("code"))).alias("code"))
        between = lambda a, b: F.pow(F.greatest(F.abs(F.col(a) - F.col(b)) - 1, F.lit(0)), 2)
        meeting = cells.join(around, [*group, "code"]).where((F.col("part") != F.col("other")) & (between("x", "ox") + between("y", "oy") <= FINE**2))
        shared = materialise(meeting.select(*group, "part", "other", "code", F.struct("x", "y").alias("fine")).distinct(), "shared")
        lists = shared.groupBy(*group, "part", "other").agg(F.collect_set("fine").alias("shared"))
        open_ = member.join(lists, [*group, "part"]).where(F.size(F.filter("fine", lambda c: F.array_contains("shared", c))) >= _needed(rank))
        open_ = materialise(open_.select(*keys, "part", "other", "n", "codes"), "open")
        if open_.isEmpty():
            return parts
        alone, meets = open_.dropDuplicates(keys), shared.select(*group, "part", "other", "code").distinct()
        others = meets.groupBy(*group, "part", "code").agg(F.count(F.lit(1)).alias("others"))
        points_in = alone.select(*keys, "part", "n", F.explode("codes").alias("code")).groupBy(*keys, "part", "n", "code").agg(F.count(F.lit(1)).alias("m"))
        order = Window.partitionBy(*keys).orderBy(F.coalesce("others", F.lit(0)), "code").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("m").over(order), F.lit(0))
        rare = points_in.join(others, [*group, "part", "code"], "left").withColumn("_before", before).where(F.col("_before") <= F.col("n") - _needed(rank))
        asked = materialise(rare.select(*keys, "part", "code").join(open_.select(*keys, "other"), keys).join(meets, [*group, "part", "other", "code"]).select(*group, F.col("trip").alias("trip_i"), "other", "code"), "asked")
        theirs = member.withColumnRenamed("part", "other").join(asked.select(*group, "other").distinct(), [*group, "other"], "left_semi")
        theirs = theirs.select(*group, "other", F.col("trip").alias("trip_j"), F.explode(_cells_around(F.col("codes"))).alias("code"))
        if whole := rounds == ROUNDS:
            met = asked.join(theirs, [*group, "other", "code"]).where("trip_i < trip_j").select(*names).distinct()
            i = alone.select(*group, F.col("trip").alias("trip_i"), "n", "codes")
            j = shapes.select(*group, F.col("trip").alias("trip_j"), _cells_around(F.col("codes")).alias("_around"))
            enough = F.size(F.filter("codes", lambda c: F.array_contains("_around", c))) >= _needed(rank)
            met = met.join(i, [*group, "trip_i"]).join(j, [*group, "trip_j"]).where(enough).select(*names)
        else:
            met = asked.join(theirs.groupBy(*group, "other", "code").agg(F.min("trip_j").alias("trip_j")), [*group, "other", "code"])
            met = met.select(*group, F.least("trip_i", "trip_j").alias("trip_i"), F.greatest("trip_i", "trip_j").alias("trip_j")).distinct()
        part = lambda x: parts.select(*group, F.col("trip").alias(f"trip_{x}"), F.col("part").alias(f"part_{x}"))
        links = materialise(found(met).join(part("i"), [*group, "trip_i"]).join(part("j"), [*group, "trip_j"]).select(*group, "part_i", "part_j").distinct(), "links")
        if links.isEmpty():
            rounds = ROUNDS
            continue
        tops = connected_components(links, group, "part_i", "part_j").select(*group, F.col("node").alias("part"), F.col("label").alias("top"))
        parts = materialise(parts.join(tops, [*group, "part"], "left").select(*keys, F.coalesce("top", "part").alias("part")), "parts")
        rounds += 1
    return parts


def corridor_clusters(shaped: DataFrame, clusters: int = 30, within: float | None = None) -> DataFrame:
    """(o_zone, d_zone, user_id, trip_id, label) of each corridor's trips, of all users, merged down to ``clusters`` routes.

    label is the first (user_id, trip_id) of a route. ``within``: pairs farther apart have no affinity, so merging ends where
    none is left. A corridor of at least ``clusters`` parts (``near_parts``) is merged down to these, whatever the order of
    merges, so none of its pairs are needed; in others the parts are separate tasks. A corridor of one trip has that trip.
    shaped: traces with o_zone and d_zone (``corridor_shapes``).
    """
    if within is None:
        pairs = materialise(route_distances(shaped, group=CORRIDOR, trip=TRIP), "corridors")
        alone = shaped.select(*CORRIDOR, F.struct(*TRIP).alias("trip_id")).distinct()
        named = alone.join(agglomerate(pairs, clusters, CORRIDOR), [*CORRIDOR, "trip_id"], "left")
        return named.select(*CORRIDOR, "trip_id.*", F.coalesce("label", "trip_id").alias("label"))
    parts = near_parts(shaped, within, CORRIDOR, TRIP).withColumnRenamed("trip", "trip_id")
    counts = parts.groupBy(*CORRIDOR).agg(F.countDistinct("part").alias("_parts"), F.count(F.lit(1)).alias("_trips"))
    few = materialise(counts.where((F.col("_parts") < clusters) & (F.col("_trips") > F.col("_parts"))).select(*CORRIDOR), "few")
    done = drop(parts, few, CORRIDOR).select(*CORRIDOR, "trip_id.*", F.col("part").alias("label"))
    if few.isEmpty():
        return done
    pairs = materialise(route_distances(keep(shaped, few, CORRIDOR), within=within, group=CORRIDOR, trip=TRIP).where(F.col("dist") <= within), "corridors")
    alone = keep(parts, few, CORRIDOR).select(*CORRIDOR, "trip_id")
    named = alone.join(agglomerate(pairs, clusters, CORRIDOR, True, alone), [*CORRIDOR, "trip_id"], "left")
    return done.unionByName(named.select(*CORRIDOR, "trip_id.*", F.coalesce("label", "trip_id").alias("label")))


def region_routes(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user_id, trip_id, region_a, region_b) of trips through a valid pair of regions; points with zone_id, pairs: region_a < region_b."""
    return region_pair(region_sequence(points)).join(pairs.select("region_a", "region_b").distinct(), ["region_a", "region_b"], "left_semi")


def clean_routes(routes: DataFrame, more_than: int = 2) -> DataFrame:
    """Drops routes of few trips, the unmatched among them, unless a user has a single route."""
    user, route = Window.partitionBy("user_id"), Window.partitionBy("user_id", "route_id")
    counted = routes.select("*", F.count(F.lit(1)).over(route).alias("_n"), F.min("route_id").over(user).alias("_a"), F.max("route_id").over(user).alias("_b"))
    return counted.where((F.col("_n") > more_than) | (F.col("_a") == F.col("_b"))).drop("_n", "_a", "_b")


def route_counts(routes: DataFrame, more_than: int = 2) -> DataFrame:
    """Per user: trips before cleaning, routes after it."""
    before = routes.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_trips"))
    after = clean_routes(routes, more_than).groupBy("user_id").agg(F.countDistinct("route_id").alias("n_routes"))
    return before.join(after, "user_id", "left")


def profile_with_counts(profile: DataFrame, counts: DataFrame) -> DataFrame:
    return profile.join(counts, "user_id", "left").withColumn("n_trips", F.coalesce("n_trips", F.lit(-1))).withColumn("n_routes", F.coalesce("n_routes", F.lit(-1)))


def complete_trips(trips: DataFrame, routes: DataFrame) -> DataFrame:
    return trips.join(routes, TRIP)


def local_scale(pairs: DataFrame, k: int = 2, low: float = 0.4, high: float = 20.0) -> DataFrame:
    """The ``k``-th least distance of each trip to the user's others, the greatest if there are fewer, clipped."""
    both = pairs.select("user_id", F.col("trip_i").alias("trip_id"), "dist").union(pairs.select("user_id", F.col("trip_j").alias("trip_id"), "dist"))
    trip = Window.partitionBy(*TRIP)
    ranked = both.withColumns({"_r": F.row_number().over(trip.orderBy("dist")), "_n": F.count(F.lit(1)).over(trip)})
    return ranked.where(F.col("_r") == F.least("_n", F.lit(k))).select(*TRIP, F.greatest(F.least("dist", F.lit(high)), F.lit(low)).alias("scale"))


def affinity(pairs: DataFrame, scales: DataFrame) -> DataFrame:
    a = scales.select("user_id", F.col("trip_id").alias("trip_i"), F.col("scale").alias("s_i"))
    b = scales.select("user_id", F.col("trip_id").alias("trip_j"), F.col("scale").alias("s_j"))
    value = F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("s_i") * F.col("s_j")))
    return pairs.join(a, ["user_id", "trip_i"]).join(b, ["user_id", "trip_j"]).select("user_id", "trip_i", "trip_j", value.alias("affinity"))


def similarity_aligned(points: DataFrame) -> DataFrame:
    """One over the mean distance of the points of equal k of each pair of a user's trips."""
    shapes = points.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("double").alias("k"), "lon", "lat"))).alias("p")).withColumnRenamed("trip_id", "trip")

    def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.sqrt((b[:, 1, None, :] - a[:, 1, :, None]) ** 2 + (b[:, 2, None, :] - a[:, 2, :, None]) ** 2) / PLANAR
        same = a[:, 0, :, None] == b[:, 0, None, :]
        many = same.sum(axis=(1, 2))
        return np.where(many > 0, 1 / (np.where(same, d, 0).sum(axis=(1, 2)) / np.maximum(many, 1) + 1e-6), np.nan)

    return _block_pairs(shapes, ["user_id"], ["k", "lon", "lat"], "similarity", similarity).where(~F.isnan("similarity"))


def merges(i: np.ndarray, j: np.ndarray, dist: np.ndarray, n: int, until: int = 1) -> list[tuple[int, int, float]]:
    """(a, b, affinity) of each merge of groups named by their first members, a < b, while there are more than ``until`` groups.

    Groups of greatest mean inverse squared distance merge first, of equal ones the pair of first a, then b; pairs that are not
    given have no affinity, and merging ends where none is left. The best partner of each group is kept; a
    merge looks only those up again whose partner was merged, so the work grows with the square of n.
    """
    weight = np.zeros((n, n))
    weight[i, j] = weight[j, i] = 1 / (dist * dist + 1e-6)
    size, alive, out = np.ones(n), np.ones(n, bool), []
    best, partner = np.zeros(n), np.zeros(n, np.int64)

    def look(k: int) -> None:
        mean = np.where(alive[k + 1 :], weight[k, k + 1 :] / (size[k] * size[k + 1 :]), 0)
        at = int(mean.argmax()) if len(mean) else 0
        best[k], partner[k] = (mean[at], k + 1 + at) if len(mean) else (0, k)

    for k in range(n):
        look(k)
    while n - len(out) > until:
        a = int(best.argmax())
        b, affinity = int(partner[a]), float(best[a])
        if affinity <= 0:
            break
        out.append((a, b, affinity))
        alive[b], best[b] = False, 0
        weight[a] += weight[b]
        weight[:, a] = weight[a]
        size[a] += size[b]
        again = alive & ((partner == a) | (partner == b)) & (best > 0)
        again[a] = True
        mean = weight[:a, a] / (size[:a] * size[a])  # others whose best the merged group has become
        better = alive[:a] & ~again[:a] & ((mean > best[:a]) | (mean == best[:a]) & (a < partner[:a]) & (mean > 0))
        best[:a][better], partner[:a][better] = mean[better], a
        for k in np.flatnonzero(again):
            look(int(k))
    return out


def _merged(pairs: DataFrame, group: list[str], clusters: int) -> DataFrame:
    """(group, trip_id, label) of groups that are one task each, whose merges lead to the labels at once."""
    kind = pairs.schema["trip_i"].dataType
    names = [*group, "trip_id", "label"]

    def one(table: pa.Table) -> pa.Table:
        both = pa.chunked_array([*table.column("trip_i").chunks, *table.column("trip_j").chunks])
        if isinstance(kind, T.StructType):
            rows = both.to_pylist()
            own = {tuple(t.values()): t for t in rows}
            order = sorted(own)
            at = {t: k for k, t in enumerate(order)}
            place = np.array([at[tuple(t.values())] for t in rows])
            trips = [own[t] for t in order]
        else:
            trips, place = np.unique(both.to_numpy(), return_inverse=True)
        half, label = len(place) // 2, np.arange(len(trips))
        for a, b, _ in merges(place[:half], place[half:], table.column("dist").to_numpy(), len(trips), clusters):
            label[label == b] = a
        found = [pa.array(trips, table.schema.field("trip_i").type), pa.array(trips, table.schema.field("trip_i").type).take(pa.array(label))]
        keys = [pa.array([table.column(c)[0].as_py()] * len(trips), table.schema.field(c).type) for c in group]
        return pa.table([*keys, *found], names=names)

    schema = T.StructType([*pairs.select(*group).schema.fields, T.StructField("trip_id", kind), T.StructField("label", kind)])
    return pairs.select(*group, "trip_i", "trip_j", "dist").groupBy(*group).applyInArrow(one, schema)


def agglomerate(pairs: DataFrame, clusters: int, group: list[str] = ["user_id"], split: bool = False, trips: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(group, trip_id, label): each group's trips merged, by greatest mean inverse squared distance, down to ``clusters``.

    pairs: group, trip_i < trip_j, dist. A group is one task unless ``split``: then each connected part is,
    and of all parts' merges those of greatest affinity are made, of equal ones those of the part with the first trip.
    That is the same, for a pair between two parts has no affinity. ``trips`` (group, trip_id) counts trips
    without a pair; they are in no row of the result.
    """
    if not split:
        return _merged(pairs, group, clusters)
    given = pairs.select(*group, F.col("trip_i").alias("trip_id")).union(pairs.select(*group, F.col("trip_j"))).distinct()
    parts = connected_components(pairs.select(*group, F.col("trip_i").alias("src"), F.col("trip_j").alias("dst")), group)
    keyed = pairs.join(parts.select(*group, F.col("node").alias("trip_i"), F.col("label").alias("part")), [*group, "trip_i"])
    kind = pairs.schema["trip_i"].dataType
    names = [*group, "part"]

    def one(table: pa.Table) -> pa.Table:
        both = pa.chunked_array([*table.column("trip_i").chunks, *table.column("trip_j").chunks]).to_pylist()
        key = (lambda t: tuple(t.values())) if isinstance(kind, T.StructType) else (lambda t: t)
        own = {key(t): t for t in both}
        order = sorted(own)
        at = {t: k for k, t in enumerate(order)}
        place = np.array([at[key(t)] for t in both])
        half = len(place) // 2
        found = merges(place[:half], place[half:], table.column("dist").to_numpy(), len(order), 1)
        ends = [pa.array([own[order[m[c]]] for m in found], table.schema.field("trip_i").type) for c in (0, 1)]
        keys = [pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in names]
        return pa.table([*keys, *ends, pa.array([m[2] for m in found], pa.float64()), pa.array(range(len(found)), pa.int64())], names=[*names, "src", "dst", "affinity", "step"])

    schema = T.StructType([*keyed.select(*names).schema.fields, T.StructField("src", kind), T.StructField("dst", kind), T.StructField("affinity", T.DoubleType()), T.StructField("step", T.LongType())])
    made = keyed.select(*names, "trip_i", "trip_j", "dist").groupBy(*names).applyInArrow(one, schema)
    n = (given if trips is None else trips).groupBy(*group).agg((F.count(F.lit(1)) - clusters).alias("_most"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("affinity"), "part", "step"))
    made = made.withColumn("_rank", rank).join(n, group).where("_rank <= _most")
    labels = connected_components(made.select(*group, "src", "dst"), group).select(*group, F.col("node").alias("trip_id"), "label")
    return given.join(labels, [*group, "trip_id"], "left").select(*group, "trip_id", F.coalesce("label", "trip_id").alias("label"))


def cluster_summary(labels: DataFrame, group: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """(group, label, n_trips, n_users) of the clusters of each group; a label is one of its own group only."""
    return labels.groupBy(*dict.fromkeys([*group, "label"])).agg(F.count(F.lit(1)).alias("n_trips"), (F.lit(1).cast("long") if "user_id" in group else F.countDistinct("user_id")).alias("n_users"))


def region_sequence(points: DataFrame) -> DataFrame:
    """points with zone_id: regions of each trip in order, without repeats in a row and points outside all."""
    order = Window.partitionBy(*TRIP).orderBy("ts", "ping_id")
    return points.where("zone_id is not null").withColumn("_was", F.lag("zone_id").over(order)).where("_was is null or _was <> zone_id").drop("_was")


def region_pair(sequence: DataFrame) -> DataFrame:
    """The first two of the sorted regions of trips through two or three."""
    sets = sequence.groupBy(*TRIP).agg(F.sort_array(F.collect_set("zone_id")).alias("r"))
    return sets.where(F.size("r").between(2, 3)).select(*TRIP, F.col("r")[0].alias("region_a"), F.col("r")[1].alias("region_b"))
