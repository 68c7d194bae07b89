"""Clusters of places against plain loops, dense cells, and stays of long tracks."""

import math
import random
import time

import pytest

from pyspark.sql import functions as F

from pingmill.operators import places

FIELDS = "user_id long, idx long, lon double, lat double"


def plain(rows, eps, min_pts):
    out = {}
    for user in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == user]
        label = {r[1]: r[1] for r in own}
        near = {r[1]: [s[1] for s in own if math.sqrt((s[2] - r[2]) ** 2 + (s[3] - r[3]) ** 2) <= eps] for r in own}
        moved = True
        while moved:
            moved = False
            for k, others in near.items():
                least = min(label[o] for o in others)
                if least < label[k]:
                    label[k], moved = least, True
        out |= {(user, k): label[k] if len(near[k]) >= min_pts else None for k in label}
    return out


def cases():
    draw = random.Random(6)
    rows = [(1, k, round(-97 + draw.gauss(0, 0.02), 6), round(32 + draw.gauss(0, 0.02), 6)) for k in range(250)]  # chains and single places
    rows += [(2, k, -97 + 0.005 * (k % 5), 32 + 0.0075 * (k // 5)) for k in range(40)]  # steps of eps, rows apart
    rows += [(3, 1000 + k, 0.01 * (k // 150) * 0.93 + draw.random() * 0.003, draw.random() * 0.003) for k in range(300)]  # two dense cells
    rows += [(4, 7, 1.0, 1.0), (4, 3, 1.0, 1.0), (4, 9, 5.0, 5.0), (4, 11, -5.0, -5.0)]  # equal places, single ones
    return rows


@pytest.mark.parametrize("min_pts", [1, 2])
@pytest.mark.parametrize("direct", [places.DIRECT, 0])
def test_clusters_equal_plain_loops(spark, monkeypatch, min_pts, direct):
    monkeypatch.setattr(places, "DIRECT", direct)  # 0: boxes are quartered to the end
    rows = cases()
    df = spark.createDataFrame(rows, FIELDS)
    got = {(r.user_id, r.idx): r.label for r in places.cluster_points(df, ["user_id"], 0.005, min_pts).collect()}
    assert got == plain(rows, 0.005, min_pts)


def test_a_hundred_thousand_places_of_one_cell(spark):
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("idx"), (F.lit(0.0001) + F.col("id") % 317 * 1e-5).alias("lon"), (F.lit(0.0001) + F.floor(F.col("id") / 317) * 1e-5).alias("lat"))
    near = df.union(df.select("user_id", F.col("idx") + 200_000, F.col("lon") + 0.0071, "lat"))  # a dense cell two steps away
    began = time.time()
    out = places.cluster_points(near, ["user_id"], 0.005, 2).groupBy("label").count().collect()
    assert [(r.label, r["count"]) for r in out] == [(0, 200_000)]
    assert time.time() - began < 60
