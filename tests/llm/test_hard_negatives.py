"""Hard negatives against brute force on made vectors and against SQL on a table."""

import os
import random

import numpy as np
import pytest

from pingmill.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"
FIELDS = "vec_id long, embedding array<float>, label int, uid string, part int, score double"


def brute(rows):
    """Rows of (anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    known = []
    for at, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * np.float64(np.float32(x)))) for x in vector]
        known.append((at, vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for at, anchor, label, v in known:
        if anchor % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), other, k, other_label) for k, other, other_label, w in known if k != at)
        for minus, positive, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [(other, -s) for s, other, _, other_label in scored if other_label != label and 50 * -minus <= 100 * -s <= 95 * -minus]
            out += [(anchor, positive, rank, other, -minus, s) for rank, (other, s) in enumerate(fits[:3], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], FIELDS)


def found(spark, rows):
    return sorted(map(tuple, hn.hard_negatives(frame(spark, rows)).collect()))


def made(n, dim, seed, spread=0.4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    return [(k * 5, [float(np.float32(x)) for x in centres[k % 12] + draw.normal(scale=spread, size=dim)], int(draw.integers(0, 10))) for k in range(n)]


@pytest.mark.parametrize("part,block", [(hn.PART, hn.BLOCK), (7, 20)])
def test_rows_equal_brute_force_for_any_split(spark, monkeypatch, part, block):
    monkeypatch.setattr(hn, "PART", part)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "BLOCKS", 3)
    rows = made(400, 6, 1)
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 300


def test_ties_repeats_nulls_and_odd_vectors(spark):
    same = [1.0, 0.5, -0.25]
    rows = [(k, same, k % 3) for k in range(0, 300, 10)] + [(k, [0.7, 0.45, -0.2], k % 4) for k in range(1, 200, 7)]
    rows += [(50, same, 0), (50, same, 0), (100, [0.0, 0.0, 0.0], 1), (150, [], 2), (200, [1.0, 2.0], 0), (250, [1.0, 2.0, 3.0, 4.0], 1)]
    rows += [(None, same, 1), (300, None, 1), (350, same, None), (400, [1.0, None, 2.0], 1), (450, [1.0, float("nan"), 2.0], 1), (500, [float("inf"), 1.0, 1.0], 1)]
    rows += [(550, [-1.0, -2.0, -3.0], 4), (551, [-1.0, -2.0, -2.9], 4), (600, [3e18, 1.0, 1.0], 5)]
    random.Random(3).shuffle(rows)
    small = [r for r in rows if r[0] != 600]
    assert found(spark, small) == brute(small)
    assert hn.hard_negatives(frame(spark, rows)).count() >= len(brute(small))  # huge components are cut, nothing breaks
    assert found(spark, [r for r in rows if r[0] is None]) == [] and hn.hard_negatives(frame(spark, rows).limit(0)).count() == 0


def test_large_scores_are_exact(spark):
    draw = random.Random(5)
    rows = [(k * 10, [draw.uniform(1, 2) * 4e5 for _ in range(4)], k % 2) for k in range(60)]
    got = found(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > 2**53


def test_lists_of_close_clusters_are_left_early():
    draw = np.random.default_rng(2)
    centres = np.eye(16) * 200
    v = np.rint(centres[np.arange(4000) % 16] + draw.normal(scale=4, size=(4000, 16))).astype(np.int64)
    items = {"v": v, "uid": np.arange(4000), "vec_id": np.arange(4000), "label": np.zeros(4000, np.int64)}
    rows = np.arange(0, 4000, 160)  # of the first centre
    members = {c: x[rows] for c, x in items.items()}
    slot, place, score, done = hn.walk(members, items, np.full((25, 1), -(1 << 62)), np.full((25, 1), 1 << 62), True, 5)
    exact = v[rows] @ v.T
    exact[np.arange(25), rows] = -1
    assert np.array_equal(np.sort(score.reshape(25, 5)), np.sort(exact)[:, -5:])
    assert done < 0.3 * 25 * 4000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pingmill.llm import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_anchor_lists"]).df()
    got = queries.op12_anchor_lists(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want)
