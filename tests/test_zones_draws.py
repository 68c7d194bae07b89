"""Zones with holes and their files, stays of long tracks, draws that hang on no partition, and the queries of ``paths`` against DuckDB."""

import json
import math
import os
import random

import pytest

from pyspark.sql import functions as F

from pingmill.operators import places, spatial, stats, trips
from pingmill.plans import paths, registry  # noqa: F401: ``paths`` adds to the registry
from pingmill.sources import tables

SF = "/root/testdata/sf0.001"
SQUARE = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]


def zone_file(path):
    features = [
        {"properties": {"ID": 1, "name": "holed"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE(0, 10), SQUARE(2, 8)]}},
        {"properties": {"ID": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE(3, 7), SQUARE(4, 6)], [SQUARE(4.5, 5.5)], [SQUARE(20, 21)]]}},
        {"properties": {"ID": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"ID": 4}, "geometry": None},
    ]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def at(spark, zones, places_):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places_)], "id long, lon double, lat double")
    found = {r.id: r.zone_id for r in spatial.assign_zones(df, zones, keys=["id"], cell=2.0).collect()}
    return [found[k] for k in range(len(places_))]


POINTS = [(1.0, 1.0), (2.5, 5.0), (3.5, 5.0), (4.2, 5.0), (5.0, 5.0), (20.5, 20.5), (9.0, 5.0), (11.0, 5.0), (2.0, 2.0), (8.0, 8.0), (0.0, 0.0), (10.0, 10.0)]
#: Between the rings of 1, in its hole, in 2, in the hole of 2, on its island, its far part, in 1, outside; corners are half-open.
WANT = [1, None, 2, None, 2, 2, 1, None, None, 1, 1, None]


def test_both_kinds_of_polygons_are_read_and_holes_are_outside(spark, tmp_path):
    zone_file(tmp_path / "z.json")
    zones = tables.read_zones(spark, str(tmp_path / "z.json"), "ID")
    assert sorted((z.zone_id, z.ring_id, len(z.rings), z.max_lon) for z in zones.collect()) == [(1, 0, 2, 10.0), (2, 0, 2, 7.0), (2, 1, 1, 5.5), (2, 2, 1, 21.0)]
    assert at(spark, zones, POINTS) == WANT


def test_a_written_zone_file_is_read_back(spark, tmp_path):
    zone_file(tmp_path / "z.json")
    zones = tables.read_zones(spark, str(tmp_path / "z.json"), "ID")
    extra = spatial.zone_centroids(zones).withColumn("name", F.when(F.col("zone_id") == 1, "one"))
    for n, per_file in enumerate((1000, 1)):
        path = str(tmp_path / f"out{n}")
        tables.write_zone_file(zones, extra, path, "GEOID", per_file)
        again = tables.read_zones(spark, path, "GEOID")
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(again) == rows(zones) and at(spark, again, POINTS) == WANT
        files = [json.loads(f.read_text()) for f in (tmp_path / f"out{n}").rglob("part-*") if f.suffix == ".txt"]
        properties = [f["properties"] for c in files for f in c["features"]]
        assert all(c["type"] == "FeatureCollection" for c in files) and {p["GEOID"]: p.get("name") for p in properties} == {1: "one", 2: None}
        assert all({"c_lon", "c_lat"} <= p.keys() for p in properties)


def plain_inside(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def test_random_stars_with_holes_against_plain_loops(spark):
    draw = random.Random(2)
    star = lambda r: [(r * (0.6 + 0.4 * draw.random()) * math.cos(a / 3), r * (0.6 + 0.4 * draw.random()) * math.sin(a / 3)) for a in range(19)]
    shapes = {k: [[(x + 3 * k, y) for x, y in star(r)] for r in (2.0, 0.9)] for k in range(5)}
    rows = [(k, 0, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    zones = tables.with_boxes(spark.createDataFrame(rows, "zone_id long, ring_id int, rings array<array<struct<lon:double,lat:double>>>"))
    points = [(draw.uniform(-3, 15), draw.uniform(-3, 3)) for _ in range(600)]
    want = [max((k for k, rings in shapes.items() if plain_inside(rings, *p)), default=None) for p in points]
    assert at(spark, zones, points) == want and len(set(want)) == 6


def plain_stays(track):
    def km(a, b):
        square = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6372.8 * math.asin(math.sqrt(square))

    out, held, last = [], [], None
    for t, lon, lat in track:
        if (t, lon, lat) == last:
            continue
        if held and km((sum(p[1] for p in held) / len(held), sum(p[2] for p in held) / len(held)), (lon, lat)) > 0.3:
            if held[-1][0] - held[0][0] > 600:
                out.append((held[0][0], held[-1][0] - held[0][0], len(held)))
            held = []
        held.append((t, lon, lat))
        last = t, lon, lat
    return out


def test_stays_of_users_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    draw, rows, want = random.Random(4), [], {}
    for user in range(6):
        t, lon, lat, track = 0, -97.0, 32.0, []
        for _ in range(300):
            t += draw.choice((0, 60, 200))
            if draw.random() < 0.05:
                lon, lat = lon + draw.uniform(0.01, 0.02), lat
            track.append((t, lon + draw.uniform(0, 0.0005), lat) if draw.random() < 0.9 or not track else track[-1])
        track.sort(key=lambda p: p[0])
        want[user] = [s[:2] for s in plain_stays(track)]
        rows += [(user, p[0], k, p[1], p[2]) for k, p in enumerate(track)]
    draw.shuffle(rows)
    out = places.stay_points(spark.createDataFrame([*rows, (9, None, 1, 1.0, 1.0), (9, 1, 1, None, 1.0)], "user_id long, ts long, ping_id long, lon double, lat double")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {u: sorted((r.arrival_ts, r.duration) for r in out if r.user_id == u) for u in want} == want and sum(map(len, want.values())) > 30 and {r.user_id for r in out} <= set(want)


def test_draws_hang_on_no_partition(spark):
    df = spark.createDataFrame([(k, float(k % 4)) for k in range(300)], "id long, income double")
    spread = df.repartition(7).orderBy(F.desc("id"))
    for draw in (lambda x: stats.weighted_sample(x, "income", 500, key=["id"]), lambda x: stats.sample_rows(x, 0.3), lambda x: stats.perturb_income(x, "income", key=["id"])):
        assert sorted(map(tuple, draw(df).collect())) == sorted(map(tuple, draw(spread).collect()))
    u = [r.u for r in spark.range(4000).select(stats.uniform(3, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02 and len(set(u)) == 4000


def test_trips_are_numbered_over_all_users(spark):
    rows = [(m, u, t) for m in (2, 1) for u in (5000, 3, 9000) for t in (4, 2) for _ in range(2)]
    got = {(r.month, r.user_id, r.trip_id): r.trip_no for r in trips.number_trips(spark.createDataFrame(rows, "month long, user_id long, trip_id long")).collect()}
    assert got == {key: n for n, key in enumerate(sorted(set(rows)))}


def test_partitions_are_in_order_of_user_and_time(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(20), draw.randrange(1000), k, 0.0, 0.0) for k in range(500)]
    out = trips.sorted_by_user(spark.createDataFrame(rows, "user_id long, ts long, ping_id long, lon double, lat double").repartition(5)).withColumn("part", F.spark_partition_id()).collect()
    parts: dict[int, list] = {}
    for r in out:
        parts.setdefault(r.part, []).append((r.user_id, r.ts, r.ping_id))
    assert all(p == sorted(p) for p in parts.values()) and sum(map(len, parts.values())) == 500
    users = [{u for u, *_ in p} for p in parts.values()]
    assert sum(map(len, users)) == len(set.union(*users))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_of_paths_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = [n for n, f in registry.QUERIES.items() if f.__module__.endswith("paths") and n in registry.ORACLES]
    assert len(names) > 12
    for name in [*names, "weighted_sample", "perturb_income"]:
        want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns), name
        rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
        assert rows(got) == rows(want), name
