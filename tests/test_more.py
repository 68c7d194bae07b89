"""Readers on small files, routes against plain loops, draws by their properties, and the further queries against DuckDB."""

import gzip
import json
import math
import os
import random

import pytest

from pingmill.operators import routes, stats
from pingmill.plans import more, registry  # noqa: F401: ``more`` adds to the registry
from pingmill.sources import tables

SF = "/root/testdata/sf0.001"


def test_readers_and_writers(spark, tmp_path):
    with gzip.open(tmp_path / "pings.csv.gz", "wt") as f:
        f.write("1,100,-97.1,32.5,20,76001\nbad,row\n2,x,-97.2,32.6,30,76002\n3,300,-97.3,32.7,200,76003\n")
    assert sorted(r.user_id for r in tables.read_pings(spark, str(tmp_path / "pings.csv.gz")).collect()) == [1, 3]
    assert tables.month_days(spark, "2017-02").count() == 28
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    geo = {"features": [
        {"properties": {"ID": "7"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[5, 5], [6, 5], [6, 6]]]]}},
    ]}
    (tmp_path / "z.json").write_text(json.dumps(geo))
    zones = tables.read_zones(spark, str(tmp_path / "z.json"), "ID").orderBy("ring_id").collect()
    assert [(z.zone_id, z.ring_id, z.min_lon, z.max_lat) for z in zones] == [(7, 0, 0.0, 2.0), (7, 1, 5.0, 6.0)]
    (tmp_path / "t.json").write_text(json.dumps({"features": [{"properties": {"GEOID": "48", "B00001_001E": 10.0, "B06011_001E": 25000.0}}]}))
    assert tables.read_tracts(spark, str(tmp_path / "t.json")).first().asDict() == {"tract": 48, "population": 10.0, "income": 25.0}
    (tmp_path / "p.csv").write_text("a,zip,b,pop\nx,76001,y,12\n")
    assert [tuple(r) for r in tables.read_zip_population(spark, str(tmp_path / "p.csv")).collect()] == [(76001, 12.0)]
    (tmp_path / "s.csv").write_text("o,d,c2,c3,alone,shared\n1,2,x,y,3,4\n")
    assert [tuple(r) for r in tables.read_survey_od(spark, str(tmp_path / "s.csv")).collect()] == [(1, 2, 11.0)]
    flows = spark.createDataFrame([(1, 2, 3.0)], "o_zone long, d_zone long, flow double")
    for fmt in ("parquet", "csv"):
        tables.write_table(flows, str(tmp_path / f"out_{fmt}"), fmt)
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "out_csv"), "o_zone long, d_zone long, flow double").collect()] == [(1, 2, 3.0)]
    tables.write_zones(tables.read_zones(spark, str(tmp_path / "z.json"), "ID"), spark.createDataFrame([(7, 1.5)], "zone_id long, value double"), str(tmp_path / "zones"))
    assert {r.value for r in spark.read.json(str(tmp_path / "zones")).collect()} == {1.5}


def plain_distance(a, b, window=2.0, rank=0.88):
    def placed(xy):
        along = [0.0]
        for (x1, y1), (x2, y2) in zip(xy[:-1], xy[1:], strict=True):
            along.append(along[-1] + math.hypot(x2 - x1, y2 - y1) / 3.33)
        return [(x, y, s, s / along[-1] if along[-1] else 0.0) for (x, y), s in zip(xy, along, strict=True)]

    a, b = placed(a), placed(b)
    found = []
    for x, y, _, position in a:
        partner = min(b, key=lambda p: abs(p[3] - position))
        found.append(min(math.hypot(p[0] - x, p[1] - y) / 3.33 for p in b if abs(p[2] - partner[2]) <= window / 2))
    return sorted(found)[min(int(len(a) * rank), len(a) - 1)]


def test_route_distances_against_plain_loops(spark):
    rnd = random.Random(1)
    trips = {}
    for t in range(6):
        x, y = rnd.random() / 100, rnd.random() / 100
        trips[t] = [(x + k / 500 + rnd.random() / 900, y + k / 700 * (t % 2)) for k in range(12)]
    rows = [(1, t, k, x, y) for t, xy in trips.items() for k, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "user_id long, trip_id long, k long, lon double, lat double")
    want = {(i, j): plain_distance(trips[i], trips[j]) for i in trips for j in trips if i < j}
    got = {(r.trip_i, r.trip_j): r.dist for r in routes.route_distances(points).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    eps = sorted(want.values())[len(want) // 2]
    near = {(r.trip_i, r.trip_j): r.dist for r in routes.route_distances(points, within=eps).collect()}
    assert {p for p in want if want[p] <= eps} <= near.keys() and all(near[p] == got[p] for p in near)
    labels = {r.trip_id: r.label for r in routes.route_clusters(points, eps).collect()}
    assert all(labels[i] == labels[j] for (i, j), d in want.items() if d <= eps)


def test_routes_are_found_and_sparse_trips_join_them(spark):
    rows = []
    for t, north in ((1, 0.0), (2, 0.0), (3, 0.05)):
        rows += [(1, t, 100 * t + k, t * 10_000 + k * 60, -97.0 + k * 0.004, 32.0 + north + (t == 2) * 1e-4) for k in range(20)]
    rows += [(1, 4, 400 + k, 40_000 + k * 600, -97.0 + k * 0.02, 32.0005) for k in range(4)]
    rows += [(1, 5, 500 + k, 50_000 + k * 600, -97.0 + k * 0.02, 33.0) for k in range(4)]
    points = spark.createDataFrame(rows, "user_id long, trip_id long, ping_id long, ts long, lon double, lat double")
    out = {r.trip_id: r.route_id for r in routes.detect_routes(points).collect()}
    assert out == {1: 0, 2: 0, 3: 1, 4: 0, 5: -1}


def test_merging_goes_by_greatest_similarity(spark):
    dist = {(1, 2): 1.0, (1, 3): 9.0, (1, 4): 9.0, (2, 3): 9.0, (2, 4): 9.0, (3, 4): 2.0}
    pairs = spark.createDataFrame([(5, i, j, d) for (i, j), d in dist.items()], "user_id long, trip_i long, trip_j long, dist double")
    assert {r.trip_id: r.label for r in routes.agglomerate(pairs, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    scales = {r.trip_id: r.scale for r in routes.local_scale(pairs).collect()}
    assert scales == {1: 9.0, 2: 9.0, 3: 9.0, 4: 9.0}
    assert abs({(r.trip_i, r.trip_j): r.affinity for r in routes.affinity(pairs, routes.local_scale(pairs)).collect()}[1, 2] - math.exp(-1 / 162)) < 1e-12


def test_draws(spark):
    df = spark.createDataFrame([(k, float(k % 4)) for k in range(400)], "id long, income double")
    drawn = stats.weighted_sample(df, "income", 20_000)
    share = {r.income: r["n"] / 20_000 for r in drawn.groupBy("income").count().withColumnRenamed("count", "n").collect()}
    assert drawn.count() == 20_000 and 0.0 not in share and all(abs(share[w] - w / 6) < 0.02 for w in (1.0, 2.0, 3.0))
    many = stats.perturb_income(spark.range(2000).selectExpr("id", "80.0 as income"), "income").collect()
    x = [r.income_draw for r in many]
    assert min(x) == 60 and max(x) == 100 and abs(sum(x) / len(x) - 79.5) < 1.5
    assert 0 < stats.sample_rows(df, 0.25).count() < 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_further_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = [n for n, f in registry.QUERIES.items() if f.__module__.endswith("more")]
    for name in [*names, "home_work", "significant_places", "trips_of_od_rank", "stay_points", "home_from_stays"]:
        want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns), name
        rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
        assert rows(got) == rows(want), name
