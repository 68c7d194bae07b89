"""Operators on hand-made cases, and registered queries against DuckDB on the smallest tables."""

import os

import pytest

from pyspark.sql import functions as F

from pingmill.functions import geo
from pingmill.operators import behavior, od, places, routes, spatial, trips
from pingmill.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
POINT = "user_id long, ts long, ping_id long, lon double, lat double"


def points(spark, rows, user=1):
    return spark.createDataFrame([(user, ts, k, lon, lat) for k, (ts, lon, lat) in enumerate(rows)], POINT)


def test_segmentation_keeps_exact_limits_and_drops_short_pieces(spark):
    six = [(k * 1080, -97.0, 32.0) for k in range(6)]  # legs of exactly 0.3 h don't break
    assert trips.segment_trips(points(spark, six)).count() == 6
    five = [(k * 60, -97.0, 32.0) for k in range(5)]
    late = [(10_000 + k * 60, -97.0, 32.0) for k in range(6)]
    out = trips.segment_trips(points(spark, five + late)).collect()
    assert {r.trip_id for r in out} == {1} and len(out) == 6


def test_chain_is_one_cluster_and_groups_stay_apart(spark):
    rows = [(g, k, k * 0.004, 0.0) for g in (1, 2) for k in range(6)] + [(1, 9, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, idx long, lon double, lat double")
    for least, alone in ((1, 9), (2, None)):
        out = {(r.user_id, r.idx): r.label for r in places.cluster_points(df, ["user_id"], 0.005, least).collect()}
        assert all(out[g, k] == 0 for g in (1, 2) for k in range(6)) and out[1, 9] == alone


def test_stays_last_until_the_point_before_the_leave_and_open_stays_are_not_given(spark):
    rows = [(0, 0.0, 0.0), (300, 0.0, 0.0), (601, 0.0, 0.0), (700, 1.0, 0.0), (1300, 1.0, 0.0), (1301, 2.0, 0.0), (9000, 2.0, 0.0)]
    out = places.stay_points(points(spark, rows)).collect()
    assert [(r.arrival_ts, r.duration) for r in out] == [(0, 601)]  # the second lasts exactly 600 s


def test_visits_merge_at_a_gap_of_exactly_an_hour(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 3700, 3800), (1, 7401, 7500)], "user_id long, start_ts long, end_ts long")
    assert sorted((r.start_ts, r.end_ts) for r in places.merge_visits(df, ["user_id"]).collect()) == [(0, 3800), (7401, 7500)]


def test_gaps_are_filled_from_the_first_fine_trip_that_passes_both_ends(spark):
    def cells(trips_):
        rows = [(1, t, k, k, g) for t, grids in trips_.items() for k, g in enumerate(grids)]
        return spark.createDataFrame(rows, "user_id long, trip_id long, ts long, ping_id long, grid int")

    at = lambda column, row: column * 699 + row
    line = [at(100 + k, 100) for k in range(9)]
    fine = cells({1: line[:2], 2: line, 3: [at(100 + k, 300) for k in range(9)]})
    coarse = cells({
        10: [line[0], line[2], line[7]],  # a step of two is no gap
        11: [at(100, 101), at(108, 99)],  # beside the line: last passage of either end
        12: [line[7], line[1]],  # against the line: nothing is left of the gap
        13: [at(500, 500), at(510, 500)],  # no trip passes
    })
    out = {}
    for r in trips.fill_grid_gaps(coarse, fine).orderBy("trip_id", "seq").collect():
        out.setdefault(r.trip_id, []).append(r.grid)
    assert out == {10: [line[0], line[2], *line[2:7]], 11: [at(100, 101), *line[1:8]], 12: [line[7]], 13: [at(500, 500), at(510, 500)]}


def test_grid_bounds_cut_after_the_third_digit(spark):
    row = spark.createDataFrame([(-97.0309, 32.7589)], "lon double, lat double").select(*(c.alias(n) for n, c in geo.grid_bounds(F.col("lon"), F.col("lat")).items())).first()
    assert row.asDict() == {"min_lon": -97.03, "max_lon": -97.028, "min_lat": 32.758, "max_lat": 32.76}


def test_spline_keeps_a_straight_line_straight(spark):
    df = spark.createDataFrame([(1, 1, k, k * 1.0, k * 2.0) for k in range(6)], "user_id long, trip_id long, k long, lon double, lat double")
    out = routes.smooth_traces(df, 11).orderBy("k").collect()
    assert [(round(r.lon, 9), round(r.lat, 9)) for r in out] == [(k / 2, float(k)) for k in range(11)]


def test_zones_are_exact_and_half_open(spark):
    df = spark.createDataFrame([(1, -97.9, 32.05), (2, -97.85, 32.05), (3, -50.0, 32.05)], "id long, lon double, lat double")
    out = {r.id: r.zone_id for r in spatial.assign_zones(df, fixtures.zones(spark), keys=["id"]).collect()}
    assert out[1] in (0, 5000) and out[2] == 100 and out[3] is None


def test_full_outer_matrix_keeps_one_sided_keys(spark):
    a = spark.createDataFrame([(1, 2, 3.0)], "o_zone long, d_zone long, flow double")
    b = spark.createDataFrame([(2, 1, 4.0)], "o_zone long, d_zone long, flow double")
    assert sorted(map(tuple, od.merge_od(a, b).collect())) == [(1, 2, 3.0, 0.0), (2, 1, 0.0, 4.0)]


def test_eighty_trips_are_in_no_class(spark):
    df = spark.createDataFrame([(40, 1.0), (80, 2.0), (81, 3.0)], "n_trips long, dispersion double")
    assert {r.trip_class for r in behavior.dispersion_trip_class(df).collect()} == {"40-59", ">80"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["segment_trips", "vehicular_od", "od_matrix", "reliability", "compare_od", "dispersion_by_routes", "dominant_route", "split_grid_runs", "expand_od", "grid_bounds", "resample_linear", "similarity_aligned", "fill_grid_gaps"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
