"""What keeps queries whole and even on larger tables: sizes that Spark is told, links that are fewer, pairs in blocks."""

import pytest
from pyspark.sql import functions as F

from pingmill.functions import geo
from pingmill.operators import spatial
from pingmill.plans import fixtures as fx


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("many"))
    orders = spark.range(200_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 20_000).alias("o_custkey"), F.expr("timestamp_seconds(id % 1000 * 86400)").alias("o_orderdate"), F.lit("x" * 20).alias("o_comment"))
    orders.coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["complete_trips", "number_trips"])
def test_millions_of_pings_are_not_broadcast(spark, many_orders, name):
    import __spark_entry__ as entry

    assert "BroadcastHashJoin" not in entry.queries()[name](spark, many_orders)._jdf.queryExecution().sparkPlan().toString()


def test_pings_count_as_large_as_they_are(spark, many_orders):
    pings = fx.pings(spark, many_orders)
    assert int(pings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 10 << 20


def test_zones_are_assigned_without_grouping_points(spark, many_orders):
    plan = spatial.assign_zones(fx.pings(spark, many_orders), fx.zones(spark), keys=["user_id", "ping_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_the_greatest_zone_counts_and_points_without_a_place_have_none(spark):
    zones = fx.zones(spark).where("zone_id = 101")
    twice = zones.union(zones.withColumn("zone_id", F.lit(7).cast("long")))
    points = spark.createDataFrame([(1, -97.8, 32.17), (1, -97.8, 32.17), (2, None, 32.17), (3, 0.0, 0.0)], "k long, lon double, lat double")
    assert sorted(spatial.assign_zones(points, twice, keys=["k"]).select("k", "zone_id").collect(), key=str) == sorted([(1, 101), (1, 101), (2, None), (3, None)], key=str)


def test_near_grids_are_the_neighbours(spark):
    cells = spark.range(4).select((F.col("id") * 699 + F.col("id") * 349 % 699 + 699 * 5).alias("a")).crossJoin(spark.range(699 * 12).withColumnRenamed("id", "b"))
    for w in (0, 1, 2):
        assert cells.where(geo.near_grids(F.col("a"), F.col("b"), w) != F.array_contains(geo.neighbour_grids(F.col("a"), w), F.col("b"))).isEmpty()


def test_few_blocks_do_not_move_the_points(spark, many_orders):
    import __spark_entry__ as entry

    plan = entry.queries()["block_sequence"](spark, many_orders)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in entry.queries()["filter_zips"](spark, many_orders)._jdf.queryExecution().executedPlan().toString()


def test_links_of_alike_sets_are_few(spark):
    """300 sets, each linked to the least of each of 40 random halves: 39 links a set before."""
    from pingmill.llm.chosen_path import gathered
    from pingmill.operators.components import connected_components

    pairs = spark.range(300).crossJoin(spark.range(40).withColumnRenamed("id", "run")).where(F.pmod(F.xxhash64("id", "run"), F.lit(8)) == 0)
    least = pairs.groupBy("run").agg(F.min("id").alias("dst"))
    links = pairs.join(least, "run").where("id <> dst").select(F.col("id").alias("src"), "dst").union(spark.sql("select 1001l, 1000l"))
    few = gathered(links).cache()
    assert few.count() < 1.5 * 300 < links.distinct().count() / 2
    assert sorted(connected_components(few).collect()) == sorted(connected_components(links).collect())


def test_pairs_in_blocks_are_all_pairs_once(spark, monkeypatch):
    """Trips of several sizes, users of several blocks, against the distance of each pair by itself."""
    import numpy as np

    from pingmill.operators import routes

    monkeypatch.setattr(routes, "BLOCK", 5)
    rng = np.random.default_rng(3)
    rows = [(u, t, k, float(x), float(y)) for u in (1, 2) for t in range(17 * u) for k, (x, y) in enumerate(rng.random((3 + t % 3, 2)))]
    points = spark.createDataFrame(rows, "user_id long, trip_id long, k long, lon double, lat double")
    found = {(r.user_id, r.trip_i, r.trip_j): r.dist for r in routes.route_distances(points).collect()}
    shapes = {(r.user_id, r.trip): [np.array([x[c] for x in r.p]) for c in ("lon", "lat", "along", "position")] for r in routes._shaped(points, ["user_id"], ["trip_id"]).collect()}
    wanted = {(u, i, j): routes._distance(shapes[u, i], shapes[u, j], 2.0, 0.88) for u in (1, 2) for i in range(17 * u) for j in range(i + 1, 17 * u)}
    assert found == wanted and len(found) == routes.route_distances(points).count()
    near = {(r.user_id, r.trip_i, r.trip_j): r.dist for r in routes.route_distances(points, within=0.1).collect()}
    assert near == {k: v for k, v in wanted.items() if v <= 0.1} and 0 < len(near) < len(wanted)


def test_a_pair_moves_no_trips(spark, many_orders):
    """The shapes of both trips went through a join for each pair; now no join but that of the blocks' numbers is left."""
    import __spark_entry__ as entry

    plan = entry.queries()["distance_matrix"](spark, many_orders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and entry.queries()["similarity_aligned"](spark, many_orders)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_gaps_are_filled_from_cells_that_are_written_once(spark, many_orders):
    """The plan held ten segmentations of all pings, and each gap was fifty rows."""
    import __spark_entry__ as entry

    plan = entry.queries()["fill_grid_gaps"](spark, many_orders)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and plan.count("Join ") <= 2


@pytest.mark.parametrize("name", ["combine_trips", "number_trips"])
def test_tasks_that_number_trips_hold_so_many_points(spark, many_orders, monkeypatch, name):
    """2,700,000 points were dealt to the session's partitions at most, and to fewer as they compress well."""
    import __spark_entry__ as entry

    monkeypatch.setattr("pingmill.operators.trips.TASK_ROWS", 100_000, raising=False)
    sizes = [r["count"] for r in entry.queries()[name](spark, many_orders).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_700_000 and max(sizes) < 130_000


@pytest.mark.parametrize(("rows", "tasks"), [(100_000, 8), (1000, 100), (100, 200), (10, 1000)])
def test_tasks_grow_before_they_are_more_than_are_written_without_a_sort(spark, monkeypatch, rows, tasks):
    """With 912 tasks those that read 730,000,000 points held 940 MB and spilled all of them."""
    from pingmill.operators import trips

    monkeypatch.setattr(trips, "TASK_ROWS", rows)
    assert trips.task_count(spark.range(100_000)) == tasks


def test_orders_are_dealt_by_user_and_no_pings_move(spark, many_orders):
    """All pings went through a shuffle by user, 51 MB on sf0.1; now their orders do."""
    import __spark_entry__ as entry

    plan = entry.queries()["smooth_traces"](spark, many_orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(o_custkey" in plan


def test_dealt_pings_are_the_pings_in_tasks_of_so_many(spark, many_orders, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 100_000, raising=False)
    dealt = fx.pings(spark, many_orders, dealt=True)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_700_000 and max(sizes) < 130_000
    assert dealt.exceptAll(fx.pings(spark, many_orders)).isEmpty()


def test_alike_sizes_are_smoothed_at_once_as_one_by_one(spark):
    """Chains within the distance, copies, lines of less than four points left, and lines too long to be reckoned with others."""
    import numpy as np

    from pingmill.operators import routes

    rng = np.random.default_rng(5)
    size = np.append(rng.integers(1, 18, 600), [64, 65, 200])
    lines = [rng.normal(size=(1, 2)) + np.cumsum(rng.normal(scale=rng.choice([0, 2e-4, 8e-4, 4e-3]), size=(n, 2)), axis=0) for n in size]
    for eps in (None, 0.001):
        steps = [routes._collapsed(x, eps) if eps else x for x in lines]
        want = [routes._spline(s, np.linspace(0, len(s) - 1, 30)) if len(s) >= 4 else x for s, x in zip(steps, lines, strict=True)]
        got, n = routes.splines(30, eps)(np.concatenate(lines), size)
        assert n.tolist() == [len(x) for x in want] and np.array_equal(got, np.concatenate(want)) and 3 < (n != 30).sum() < 600


def test_rounding_of_many_rows_is_that_of_spark(spark):
    from pingmill.plans import registry

    rows = spark.range(200_000).selectExpr("(rand(3) - 0.5) * 200 as x").union(spark.range(20_000).selectExpr("(id - 10000) / 2000000 + 97 as x"))
    rows = rows.union(spark.sql("select explode(array(null, double('nan'), double('inf'), -double('inf'), -0.0d, -1e-7d, 1e300d, 123456789.1234565d, 1e-320d)) as x"))
    assert registry.many_r6(rows, "x").exceptAll(registry.r6(rows, "x")).isEmpty()


@pytest.mark.parametrize("w", [0, 1, 2])
def test_gaps_across_strips_against_plain_loops(spark, w):
    """Cells on all sides of a strip's border and of a column's end, negative numbers among them."""
    from pingmill.operators import trips

    draw = __import__("random").Random(w)
    walk = lambda n: [draw.randrange(-20, 20) + 699 * draw.randrange(-2, 3) for _ in range(n)]
    fine, coarse = {t: walk(12) for t in range(6)}, {10 + t: walk(5) for t in range(8)}
    apart = lambda a, b: max(abs(r := (b - a + 349) % 699 - 349), abs((b - a - r) // 699))
    table = lambda lines: spark.createDataFrame([(1, t, k, k, g) for t, line in lines.items() for k, g in enumerate(line)], "user_id long, trip_id long, ts long, ping_id long, grid int")
    want = {}
    for t, line in coarse.items():
        out = line[:1]
        for near, grid in zip(line[:-1], line[1:], strict=True):
            part = [grid]
            for cells in fine.values() if apart(near, grid) > w else ():
                if max(cells) < min(near, grid) - 701 or min(cells) > max(near, grid) + 701:
                    continue
                at = lambda end, k: [n for n, c in enumerate(cells) if apart(end, c) <= k]  # noqa: B023, E731
                span = next(((f(at(near, k)), f(at(grid, k))) for k, f in ((0, min), (1, max), (2, max)) if at(near, k) and at(grid, k)), None)
                if span:
                    part = cells[span[0] : span[1]]
                    break
            out += part
        want[t] = out
    got = {}
    for r in trips.fill_grid_gaps(table(coarse), table(fine), w).orderBy("trip_id", "seq").collect():
        got.setdefault(r.trip_id, []).append(r.grid)
    assert got == want and got != coarse


def trip_rows(users=2, trips=40, seed=4):
    """Trips of a few routes, and sparse ones, some of them near no route; a user's trips are in several blocks of 5."""
    draw, rows = __import__("random").Random(seed), []
    for u in range(users):
        for t in range(trips * (u + 1)):
            north, sparse, n = draw.choice([0, 0.004, 0.03]), draw.random() < 0.4, draw.randrange(18, 24)
            xy = [(-97 + u + k * 0.004 + draw.gauss(0, 4e-4), 32 + north + draw.gauss(0, 4e-4) + (0.2 if sparse and t % 5 == 0 else 0)) for k in range(n)][:: 5 if sparse else 1]
            rows += [(u, t, 100 * t + k, 60 * k, x, y) for k, (x, y) in enumerate(xy)]
    return rows + [(9, 1, k, 60 * k, -97 + k / 10, 32.0) for k in range(5)]  # a user without a high-resolution trip


@pytest.mark.parametrize("block", [5, 1000])
def test_routes_of_users_of_many_blocks_against_all_pairs(spark, monkeypatch, block):
    """Components of all pairs, and the nearest of all high-resolution trips, the last of equal ones."""
    import numpy as np

    from pingmill.operators import routes

    monkeypatch.setattr(routes, "BLOCK", block)
    points = spark.createDataFrame(trip_rows(), "user_id long, trip_id long, ping_id long, ts long, lon double, lat double").cache()
    high = {tuple(r) for r in routes.high_res_trips(points).collect()}
    low = {(r.user_id, r.trip_id) for r in points.select("user_id", "trip_id").distinct().collect() if r.user_id < 9} - high
    shaped = routes.shapes(points, routes.high_res_trips(points), 30).cache()
    labels = {t: t[1] for t in high} | {(r.user_id, r.trip_id): r.label for r in routes.cluster_pairs(routes.route_distances(shaped), 0.0006).collect()}
    route = {t: sorted({v for (u, _), v in labels.items() if u == t[0]}).index(labels[t]) for t in high}
    trace, raw = {}, {}
    for df, out in ((shaped.orderBy("k"), trace), (points.orderBy("ts"), raw)):
        for r in df.collect():
            out.setdefault((r.user_id, r.trip_id), []).append((r.lon, r.lat))
    for t in low:
        km = {h: routes._farthest_km(*np.array(raw[t]).T, *np.array(trace[h]).T, 1.5) for h in high if h[0] == t[0]}
        near = [(v, -h[1], h) for h, v in km.items() if v is not None]
        route[t] = route[min(near)[2]] if near else -1
    assert len(set(route.values())) > 3 and -1 in route.values() and len(high) < len(route)
    found = lambda df: {(r.user_id, r.trip_id): r.route_id for r in df.collect()}
    assert found(routes.detect_routes(points, 0.0006, 30)) == route
    assert found(routes.main_routes(points, 0.0006, 30)) == {t: v for t, v in route.items() if t in high}
    given = spark.createDataFrame([(*t, v) for t, v in route.items() if t in high], "user_id long, trip_id long, route_id int")
    want = {t: v for t, v in route.items() if t in low}
    assert found(routes.assign_low_res(points, given, shaped=shaped)) == want == found(routes.assign_low_res(points, eps=0.0006, trace=routes.splines(30, 0.001)))
    all_ = routes.resample_linear(points, 10).cache()
    pairs = {(r.user_id, r.trip_id): r.label for r in routes.cluster_pairs(routes.route_distances(all_), 0.0006).collect()}
    for df in (routes.route_clusters(all_, 0.0006), routes.line_clusters(routes.trip_lines(points), 0.0006, routes.linear(10))):
        assert {(r.user_id, r.trip_id): r.label for r in df.collect()} == pairs


def test_points_without_a_place_do_not_count(spark):
    from pingmill.operators import routes

    line = [(-97 + k * 0.004, 32.0) for k in range(12)]
    rows = [(1, t, 100 * t + k, 60 * k, *p) for t, xy in {1: line, 2: [*line[::5], (None, None)], 3: [(-97.0, 33.0), (None, None), (-96.9, 33.0)]}.items() for k, p in enumerate(xy)]
    got = {r.trip_id: r.route_id for r in routes.detect_routes(spark.createDataFrame(rows, "user_id long, trip_id long, ping_id long, ts long, lon double, lat double")).collect()}
    assert got == {1: 0, 2: 0, 3: -1}


@pytest.mark.parametrize("name", ["assign_low_res", "detect_routes", "main_routes", "route_clusters"])
def test_routes_write_one_row_a_trip(spark, many_orders, tmp_path, monkeypatch, name):
    """Pings were segmented up to six times, and traces and cells joined: 608 MB of shuffle on sf0.1. Now each trip is written as one short row."""
    import __spark_entry__ as entry
    from pingmill.operators import routes

    written = []
    monkeypatch.setattr(routes, "materialise", lambda df, name: written.append(df) or df)
    entry.queries()[name](spark, many_orders)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(o_custkey" in plan and "Join" not in plan
    assert len(written) == 1 and not {"lon", "lat"} & set(written[0].columns)


def walks(seed, trips=14, users=3):
    """Cells of trips around each other, those of the first half high."""
    draw = __import__("random").Random(seed)
    return [(u, t, k, k, draw.randrange(-12, 12) + 699 * draw.randrange(-2, 3), t < trips // 2) for u in range(users) for t in range(trips) for k in range(draw.randrange(2, 14))]


def test_gaps_are_filled_alike_whatever_is_held(spark, monkeypatch):
    """Users, trips and their cells begin and end within what is looked at together; a user's high trips are held as long as needed."""
    from pingmill.operators import trips

    cells = spark.createDataFrame(walks(1), "user_id long, trip_id long, ts long, ping_id long, grid int, high boolean").repartition(2, "user_id").cache()
    whole = sorted(trips.fill_trip_gaps(cells).collect())
    monkeypatch.setattr(trips, "CELLS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(trips.fill_trip_gaps(cells).collect()) == whole and len(whole) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_gaps_of_many_matches_are_looked_up_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from pingmill.operators import trips

    rows = sorted(walks(2), key=lambda r: (r[0], not r[5], r[1], r[2]))
    user, trip, _, _, grid, high = (np.array(c) for c in zip(*rows, strict=True))
    starts, begins = np.append(True, user[1:] != user[:-1]), np.append(True, (trip[1:] != trip[:-1]) | (user[1:] != user[:-1]))
    near = np.where(begins, 0, np.roll(grid, 1))
    row = (grid - near + 349) % 699 - 349
    gap = ~begins & ~high & ((np.abs(row) > 2) | (np.abs(grid - near - row) > 2 * 699))
    table = pa.table({"user_id": user, "grid": grid.astype(np.int32), "near": pa.array(near.astype(np.int32), mask=begins), "gap": gap})
    whole = trips._steps(table, high, starts, begins)
    monkeypatch.setattr(trips, "MATCHES", 1)
    assert all(map(np.array_equal, trips._steps(table, high, starts, begins), whole)) and len(whole[0]) > (~high).sum()


def test_cells_are_not_moved_and_no_join_is_left(spark, many_orders, monkeypatch):
    """Cells went through two joins and six shuffles, 129 MB on sf0.1; now orders move, 2 MB."""
    import __spark_entry__ as entry
    from pingmill.plans import registry

    written = []
    monkeypatch.setattr(registry, "materialise", lambda df, name: written.append(df) or df)
    entry.queries()["fill_grid_gaps"](spark, many_orders)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(o_custkey" in plan and "Join" not in plan and len(written) == 1
