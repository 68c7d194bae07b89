"""Trip shapes, candidate joins, merging and corridors against plain and dense versions."""

import math
import random
import time

import numpy as np
import pytest

from pingmill.operators import routes

SHAPE = "user_id long, trip_id long, k long, lon double, lat double"
POINT = "user_id long, trip_id long, ping_id long, ts long, lon double, lat double"


def dense_spline(y, at):
    n = len(y)
    a, r = np.zeros((n, n)), np.zeros((n, y.shape[1]))
    k = np.arange(1, n - 1)
    a[k, k - 1], a[k, k], a[k, k + 1] = 1, 4, 1
    r[1:-1] = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(a, r)
    i = np.minimum(at.astype(int), n - 2)
    t = (at - i)[:, None]
    return y[i] * (1 - t) + y[i + 1] * t + ((1 - t) ** 3 - (1 - t)) * m[i] / 6 + (t**3 - t) * m[i + 1] / 6


def dense_collapsed(xy, eps):
    near = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]) <= eps
    for _ in range(len(xy)):
        near = near | (near.astype(int) @ near.astype(int) > 0)
    root = near.argmax(axis=1)
    centre = np.array([xy[root == r].mean(axis=0) for r in root])
    return centre[np.append(True, root[1:] != root[:-1])]


@pytest.mark.parametrize("n", [4, 5, 6, 7, 40, 300])
def test_spline_equals_the_dense_solve(n):
    y = np.random.default_rng(n).normal(size=(n, 2)).cumsum(axis=0)
    at = np.linspace(0, n - 1, 100)
    assert np.abs(routes._spline(y, at) - dense_spline(y, at)).max() < 1e-9


@pytest.mark.parametrize("step", [0.0002, 0.0005, 0.002])
def test_collapse_equals_the_dense_one(step):
    for seed in range(4):
        draw = np.random.default_rng(seed)
        xy = np.round(draw.normal(scale=step, size=(150, 2)).cumsum(axis=0) + [-97, 32], 6)
        xy[70:80] = xy[70]
        got, want = routes._collapsed(xy, 0.001), dense_collapsed(xy, 0.001)
        assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


def test_points_exactly_at_the_distance_are_linked():
    assert len(routes._collapsed(np.array([[0.0, 0.0], [0.75, 0.0], [1.5, 0.0], [3.0, 0.0]]), 0.75)) == 2


def test_a_trip_of_a_hundred_thousand_points():
    draw = np.random.default_rng(1)
    xy = np.column_stack([np.linspace(0, 5, 100_000), draw.normal(scale=0.002, size=100_000)])
    began = time.time()
    routes._spline(xy, np.linspace(0, len(xy) - 1, 100))
    routes._collapsed(np.concatenate([xy, draw.normal(scale=1e-4, size=(50_000, 2))]), 0.001)
    assert time.time() - began < 30


def plain_distance(a, b, rank=0.88):
    def placed(xy):
        along = [0.0]
        for (x1, y1), (x2, y2) in zip(xy[:-1], xy[1:], strict=True):
            along.append(along[-1] + math.hypot(x2 - x1, y2 - y1) / 3.33)
        return [(x, y, s, s / along[-1] if along[-1] else 0.0) for (x, y), s in zip(xy, along, strict=True)]

    a, b = placed(a), placed(b)
    found = []
    for x, y, _, position in a:
        partner = min(b, key=lambda p: abs(p[3] - position))
        found.append(min(math.hypot(p[0] - x, p[1] - y) / 3.33 for p in b if abs(p[2] - partner[2]) <= 1))
    return sorted(found)[min(int(len(a) * rank), len(a) - 1)]


def fan(trips, seed=3, points=20, spread=0.0004):
    """Trips that leave one home in some directions; every other turns back."""
    draw = random.Random(seed)
    out = {}
    for t in range(trips):
        angle = (t % 9) * 0.7
        line = [(-97 + k * 0.004 * math.cos(angle) + draw.gauss(0, spread), 32 + k * 0.004 * math.sin(angle) + draw.gauss(0, spread)) for k in range(points)]
        out[t] = line if t % 2 else line[::-1]
    return out


def test_few_pairs_are_formed_and_none_is_lost(spark):
    lines = fan(54)
    df = spark.createDataFrame([(1, t, k, *p) for t, line in lines.items() for k, p in enumerate(line)], SHAPE)
    want = {(i, j): d for i in lines for j in lines if i < j and (d := plain_distance(lines[i], lines[j])) <= 0.002}
    found = {(r.trip_i, r.trip_j): r.dist for r in routes.route_distances(df, within=0.002).where("dist <= 0.002").collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-12 for p in want)
    formed = routes.candidate_pairs(routes._celled(routes._shaped(df, ["user_id"], ["trip_id"]), 0.002)).count()
    assert len(want) <= formed <= 1.2 * len(want) < 54 * 53 / 4


def brute_merge(dist, names, clusters):
    groups = [[n] for n in names]
    weight = lambda i, j: 1 / (dist[min(i, j), max(i, j)] ** 2 + 1e-6)
    while len(groups) > clusters:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                mean = sum(weight(i, j) for i in groups[a] for j in groups[b]) / len(groups[a]) / len(groups[b])
                if best is None or mean > best[0] * (1 + 1e-12):
                    best = mean, a, b
        groups[best[1]] += groups.pop(best[2])
    return {n: min(g) for g in groups for n in g}


@pytest.mark.parametrize("clusters", [1, 3, 7, 40])
def test_merging_equals_plain_average_linkage(spark, clusters):
    rows, want = [], {}
    for user in (1, 2):
        draw = random.Random(user)
        at = {t: (draw.random(), draw.random()) for t in range(10, 30)}
        dist = {(i, j): math.dist(at[i], at[j]) for i in at for j in at if i < j}
        rows += [(user, i, j, d) for (i, j), d in dist.items()]
        want |= {(user, t): label for t, label in brute_merge(dist, sorted(at), clusters).items()}
    pairs = spark.createDataFrame(rows, "user_id long, trip_i long, trip_j long, dist double")
    assert {(r.user_id, r.trip_id): r.label for r in routes.agglomerate(pairs, clusters).collect()} == want


def test_equal_affinities_merge_the_first_pair(spark):
    pairs = spark.createDataFrame([(1, i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], "user_id long, trip_i long, trip_j long, dist double")
    assert {r.trip_id: r.label for r in routes.agglomerate(pairs, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def corridor_case():
    """Two corridors; trips of several users, with trip ids that repeat between users."""
    lines = {}
    for zones, users, seed in (((1, 2), (1, 2, 3), 5), ((2, 1), (2, 4), 6)):
        own = list(fan(3 * len(users) * 2, seed).values())
        for n, line in enumerate(own):
            lines[zones, (users[n % len(users)], n // len(users))] = line
    lines[(7, 8), (9, 1)] = own[0]
    return lines


@pytest.mark.parametrize("within", [None, 0.004])
def test_corridors_hold_the_trips_of_all_users(spark, within):
    lines, clusters = corridor_case(), 4
    df = spark.createDataFrame([(*z, *t, k, *p) for (z, t), line in lines.items() for k, p in enumerate(line)], "o_zone long, d_zone long, " + SHAPE)
    want = {}
    for zones in {z for z, _ in lines}:
        own = {t: line for (z, t), line in lines.items() if z == zones}
        names = sorted(own)
        dist = {(i, j): plain_distance(own[i], own[j]) for i in names for j in names if i < j}
        dist = {p: d if within is None or d <= within else math.inf for p, d in dist.items()}
        want |= {(zones, t): label for t, label in (brute_merge(dist, names, clusters) if within is None else bounded_merge(dist, names, clusters)).items()}
    got = {((r.o_zone, r.d_zone), (r.user_id, r.trip_id)): tuple(r.label) for r in routes.corridor_clusters(df, clusters, within).collect()}
    assert got == want
    labels = spark.createDataFrame([(*z, *t, 1000 * label[0] + label[1]) for (z, t), label in want.items()], "o_zone long, d_zone long, user_id long, trip_id long, label long")
    summary = {(r.o_zone, r.d_zone, r.label): (r.n_trips, r.n_users) for r in routes.cluster_summary(labels, routes.CORRIDOR).collect()}
    for (o, d, label), counts in summary.items():
        own = [t for (z, t), x in want.items() if z == (o, d) and 1000 * x[0] + x[1] == label]
        assert counts == (len(own), len({u for u, _ in own}))


def bounded_merge(dist, names, clusters):
    """Plain merging that ends where no pair between two groups has an affinity."""
    groups = [[n] for n in names]
    weight = lambda i, j: 0.0 if dist[min(i, j), max(i, j)] == math.inf else 1 / (dist[min(i, j), max(i, j)] ** 2 + 1e-6)
    while len(groups) > clusters:
        scored = [(sum(weight(i, j) for i in groups[a] for j in groups[b]) / len(groups[a]) / len(groups[b]), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups))]
        mean, a, b = max(scored)
        if mean == 0:
            break
        groups[-a] += groups.pop(-b)
    return {n: min(g) for g in groups for n in g}


def test_labels_of_two_users_are_two_clusters(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 3)], "user_id long, trip_id long, label long")
    assert sorted(map(tuple, routes.cluster_summary(labels).collect())) == [(1, 1, 2, 1), (2, 1, 1, 1), (2, 3, 1, 1)]


def km(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * 6372.8 * math.asin(math.sqrt(a))


@pytest.mark.parametrize("latitude", [0.0, 32.0, -78.0])
def test_sparse_trips_go_to_the_nearest_route_and_the_last_of_equal_ones(spark, latitude):
    draw, wide = random.Random(8), 1 / math.cos(math.radians(latitude))
    line = lambda north: [(-97 + k * 0.003 * wide, latitude + north) for k in range(12)]
    high = {1: line(0.0), 2: line(0.0), 3: line(0.01), 4: line(0.03), 5: line(0.1)}
    low = {20 + n: [(x + draw.gauss(0, 0.001), y + draw.gauss(0, 0.001)) for x, y in line(north)[::4]] for n, north in enumerate((0.0, 0.004, 0.006, 0.0134, 0.0136, 0.02, 0.0434, 0.0436, 0.06, 0.3))}
    low[40] = line(0.0)[::4]
    low[41] = [*line(0.0)[::4], (-97.0, latitude + 0.5)]
    points = [(1, t, 100 * t + k, 60 * k, *p) for t, xy in {**high, **low}.items() for k, p in enumerate(xy)]
    routed = spark.createDataFrame([(1, t, n) for n, t in enumerate(high)], "user_id long, trip_id long, route_id int")
    shaped = spark.createDataFrame([(1, t, k, *p) for t, xy in high.items() for k, p in enumerate(xy)], SHAPE)
    got = {r.trip_id: r.route_id for r in routes.assign_low_res(spark.createDataFrame(points, POINT), routed, shaped=shaped).collect()}
    want = {}
    for t, xy in low.items():
        far = {h: max(min(km(p, q) for q in line) for p in xy) for h, line in high.items()}
        best = max(h for h in far if far[h] == min(far.values()))
        want[t] = list(high).index(best) if far[best] <= 1.5 else -1
    assert got == want and want[40] == 1 and want[41] == -1 and len(set(want.values())) > 2


def test_whole_route_detection_against_plain_loops(spark):
    lines = fan(18, seed=11, points=24, spread=0.0002)
    rows = [(u, t, 1000 * t + k, 60 * k, x + u, y) for u in (1, 2) for t, line in lines.items() for k, (x, y) in enumerate(line)]
    sparse = {100 + t: line[::8] for t, line in fan(12, seed=12, points=24, spread=0.0008).items()}
    rows += [(1, t, 1000 * t + k, 600 * k, x + 1, y) for t, line in sparse.items() for k, (x, y) in enumerate(line)]
    got = {(r.user_id, r.trip_id): r.route_id for r in routes.detect_routes(spark.createDataFrame(rows, POINT), samples=40).collect()}
    want = {}
    for u in (1, 2):
        smooth = {}
        for t, line in lines.items():
            xy = dense_collapsed(np.array(line) + [u, 0], 0.001)
            smooth[t] = dense_spline(xy, np.linspace(0, len(xy) - 1, 40)).tolist()
        label = {t: t for t in smooth}
        for _ in smooth:
            for i in smooth:
                for j in smooth:
                    if i < j and plain_distance(smooth[i], smooth[j]) <= 0.002:
                        label[i] = label[j] = min(label[i], label[j])
        order = sorted(set(label.values()))
        want |= {(u, t): order.index(x) for t, x in label.items()}
        for t, line in sparse.items() if u == 1 else ():
            far = {h: max(min(km((x + 1, y), q) for q in xy) for x, y in line) for h, xy in smooth.items()}
            best = min(far, key=lambda h: (far[h], -h))
            want[u, t] = order.index(label[best]) if far[best] <= 1.5 else -1
    assert got == want and len(set(want.values())) > 4


def wide_corridor(seed, trips, points=12):
    """Trips side by side without a space between routes, some of them bent, some across the others or the other way."""
    draw, lines = random.Random(seed), {}
    for t in range(trips):
        north, bend = draw.choice([draw.random() * 0.03, 0.05 + draw.random() * 0.004]), draw.choice([0, 0, 0, 0.012])
        line = [(-97 + k * 0.006 + draw.gauss(0, 0.0006), 32 + north + bend * math.sin(k / 3) + draw.gauss(0, 0.0006)) for k in range(points)]
        if t % 11 == 5:
            line = [(-97 + draw.random() * 0.07, 32 + k * 0.005) for k in range(points)]
        lines[(t % 4, t)] = line[::-1] if t % 7 == 3 else line
    return lines


@pytest.mark.parametrize("rounds, trips", [(0, 40), (3, 40), (3, 90)])
def test_parts_without_pairs_are_those_of_all_pairs(spark, monkeypatch, rounds, trips):
    monkeypatch.setattr(routes, "ROUNDS", rounds)
    rows, want = [], {}
    for zones, seed in (((1, 2), 21), ((2, 1), 22)):
        lines = wide_corridor(seed + trips, trips)
        rows += [(*zones, *t, k, *p) for t, line in lines.items() for k, p in enumerate(line)]
        label = {t: t for t in lines}
        pairs = [(i, j) for i in lines for j in lines if i < j and plain_distance(lines[i], lines[j]) <= 0.002]
        assert len(pairs) > trips
        for _ in lines:
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        want |= {(zones, t): x for t, x in label.items()}
    df = spark.createDataFrame(rows, "o_zone long, d_zone long, " + SHAPE)
    got = {((r.o_zone, r.d_zone), tuple(r.trip)): tuple(r.part) for r in routes.near_parts(df, 0.002, routes.CORRIDOR, routes.TRIP).collect()}
    assert got == want and 2 < len(set(want.values())) < trips


def test_alike_trips_of_a_corridor_are_not_paired(spark, monkeypatch):
    """Three routes of 60 trips: 5,310 pairs within the limit before."""
    draw, formed, measured = random.Random(4), [], routes._measured
    monkeypatch.setattr(routes, "_measured", lambda pairs, *a: formed.append(pairs.count()) or measured(pairs, *a))
    line = lambda north: [(-97 + k * 0.006 + draw.gauss(0, 0.0003), 32 + north * math.sin(k / 11 * math.pi) + draw.gauss(0, 0.0003)) for k in range(12)]
    rows = [(1, 2, u, 0, k, *p) for u in range(180) for k, p in enumerate(line((u % 3 - 1) * 0.04))]
    found = routes.corridor_clusters(spark.createDataFrame(rows, "o_zone long, d_zone long, " + SHAPE), 3, 0.004)
    assert {(r.user_id, tuple(r.label)) for r in found.collect()} == {(u, (u % 3, 0)) for u in range(180)}
    assert 0 < sum(formed) < 4 * 180
