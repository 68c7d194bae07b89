"""Registered queries on trip shapes (distances, routes, corridors of all users) with SQL by brute force, and variants of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.functions import geo
from pingmill.functions.storage import materialise
from pingmill.operators import behavior, places, routes, spatial, stats, trips
from pingmill.plans import fixtures as fx
from pingmill.plans.more import FINE, HOMES, VISITS
from pingmill.plans.registry import LOW, MATCHED, ORACLES, RESAMPLED, SAMPLES, ZONED, _d_uniform, query, r6, r10, segmented


def _distances(source: str, group: str) -> str:
    """CTE mh (group, i, j, dist) of the modified Hausdorff distances of ``source`` (group, t, k, lon, lat), i < j."""
    columns = group.split(", ")
    a, b = (", ".join(f"{x}.{c}" for c in columns) for x in ("a", "p"))
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in columns)
    return f"""ld AS (SELECT *, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) / 333e-2, 0) AS leg FROM {source} WINDOW w AS (PARTITION BY {group}, t ORDER BY k)),
    lg AS (SELECT *, sum(leg) OVER (PARTITION BY {group}, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS along FROM ld),
    ps AS (SELECT *, CASE WHEN max(along) OVER w > 0 THEN along / max(along) OVER w ELSE 0 END AS position FROM lg WINDOW w AS (PARTITION BY {group}, t)),
    pr AS (SELECT {a}, a.t AS i, b.t AS j, a.k, arg_min(b.along, (abs(a.position - b.position), b.k)) AS mid, any_value(a.lon) AS x, any_value(a.lat) AS y FROM ps a JOIN ps b ON {same('a', 'b')} AND a.t < b.t GROUP BY ALL),
    nr AS (SELECT {b}, p.i, p.j, p.k, min(sqrt(pow(b.lon - x, 2) + pow(b.lat - y, 2))) / 333e-2 AS d FROM pr p JOIN ps b ON {same('p', 'b')} AND b.t = p.j AND abs(b.along - mid) <= 1 GROUP BY ALL),
    mh AS (SELECT {group}, i, j, list_sort(list(d))[CAST(least(floor(count(*) * 88e-2), count(*) - 1) AS INT) + 1] AS dist FROM nr GROUP BY ALL)"""


def _parts(group: str, eps: str) -> str:
    """CTE lab (group, t, label) of the components of mh's pairs within ``eps``."""
    columns = group.split(", ")
    a = ", ".join(f"r.{c}" for c in columns)
    same = " AND ".join(f"r.{c} = e.{c}" for c in columns)
    return f"""eg AS (SELECT {group}, i, j FROM mh WHERE dist <= {eps} UNION SELECT {group}, j, i FROM mh WHERE dist <= {eps}),
    rc AS (SELECT {group}, i, j FROM eg UNION SELECT {a}, r.i, e.j FROM rc r JOIN eg e ON {same} AND r.j = e.i), lab AS (SELECT {group}, i AS t, least(i, min(j)) AS label FROM rc GROUP BY {group}, i)"""


LINES = f"{RESAMPLED}, line AS (SELECT user_id, trip_id AS t, k, lon, lat FROM res)"
USER_PAIRS = f"{LINES}, {_distances('line', 'user_id')}"


def _lines(s, d) -> DataFrame:
    return routes.resample_linear(segmented(s, d), SAMPLES)


@query(f"WITH {USER_PAIRS} SELECT user_id, i AS trip_i, j AS trip_j, round(dist, 6) AS dist FROM mh WHERE dist <= 2e-3")
def route_distances(s, d):
    """Pairs of each user's trips within the distance of a route; only candidates by cells are formed."""
    return routes.route_distances(_lines(s, d), within=0.002).where("dist <= 0.002").withColumn("dist", F.round("dist", 6))


@query(f"WITH {USER_PAIRS} SELECT user_id, i AS trip_i, j AS trip_j, round(dist, 6) AS dist FROM mh")
def distance_matrix(s, d):
    return routes.route_distances(_lines(s, d)).withColumn("dist", F.round("dist", 6))


@query(f"WITH RECURSIVE {USER_PAIRS}, {_parts('user_id', '3e-3')} SELECT user_id, t AS trip_id, label FROM lab")
def route_clusters(s, d):
    return routes.line_clusters(routes.trip_lines(segmented(s, d, dealt=True)), trace=routes.linear(SAMPLES))


ROUTED = f"""{LINES}, {FINE}, fl AS (SELECT l.* FROM line l JOIN fine f ON f.user_id = l.user_id AND f.trip_id = l.t), {_distances('fl', 'user_id')}, {_parts('user_id', '2e-3')},
    mr AS (SELECT f.user_id, f.trip_id, CAST(dense_rank() OVER (PARTITION BY f.user_id ORDER BY coalesce(label, f.trip_id)) AS INT) - 1 AS route_id FROM fine f LEFT JOIN lab ON lab.user_id = f.user_id AND lab.t = f.trip_id)"""


@query(f"WITH RECURSIVE {ROUTED} SELECT user_id, trip_id, route_id FROM mr")
def main_routes(s, d):
    return routes.main_routes(segmented(s, d, dealt=True), trace=routes.linear(SAMPLES))


@query(f"""WITH RECURSIVE {ROUTED}, low AS (SELECT * FROM trips ANTI JOIN fine USING (user_id, trip_id) WHERE user_id IN (SELECT user_id FROM fine)),
    near AS (SELECT l.user_id, l.trip_id, l.ping_id, h.t AS high, min({fx.haversine('l.lat', 'l.lon', 'h.lat', 'h.lon')}) AS km FROM low l JOIN fl h ON h.user_id = l.user_id GROUP BY ALL),
    far AS (SELECT user_id, trip_id, high, max(km) AS km FROM near GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, trip_id ORDER BY km, high DESC) AS r FROM far)
    SELECT rk.user_id, rk.trip_id, CASE WHEN km <= 15e-1 THEN route_id ELSE -1 END AS route_id FROM rk JOIN mr ON mr.user_id = rk.user_id AND mr.trip_id = high WHERE r = 1""")
def assign_low_res(s, d):
    """Main routes are found in the same pass."""
    return routes.assign_low_res(segmented(s, d, dealt=True), trace=routes.linear(SAMPLES))


SCALES = f"""{USER_PAIRS}, bo AS (SELECT user_id, i AS t, dist FROM mh UNION ALL SELECT user_id, j, dist FROM mh), sr AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id, t) AS n FROM bo WINDOW w AS (PARTITION BY user_id, t ORDER BY dist)),
    sc AS (SELECT user_id, t, greatest(least(dist, 5e-2), 5e-4) AS scale FROM sr WHERE r = least(n, 2))"""


def _scales(s, d) -> tuple[DataFrame, DataFrame]:
    pairs = materialise(routes.route_distances(_lines(s, d)), "pairs")
    return pairs, routes.local_scale(pairs, low=0.0005, high=0.05)


@query(f"WITH {SCALES} SELECT user_id, t AS trip_id, round(scale, 6) AS scale FROM sc")
def local_scale(s, d):
    """Clipped where the small tables' distances, in degrees, lie; the default is for kilometres."""
    return _scales(s, d)[1].withColumn("scale", F.round("scale", 6))


@query(f"WITH {SCALES} SELECT mh.user_id, i AS trip_i, j AS trip_j, round(exp(-dist * dist / (2 * a.scale * b.scale)), 5) AS affinity FROM mh JOIN sc a ON a.user_id = mh.user_id AND a.t = i JOIN sc b ON b.user_id = mh.user_id AND b.t = j")
def affinity(s, d):
    return routes.affinity(*_scales(s, d)).withColumn("affinity", F.round("affinity", 5))


# --- corridors: the trips of all users between two zones -------------------------------------------

CORRIDORS = f"""{ZONED}, {LINES.removeprefix(f'{fx.D_TRIPS}, ')}, {FINE},
    cl AS (SELECT z.o_zone, z.d_zone, l.user_id * 1000000 + l.t AS t, l.k, l.lon, l.lat FROM line l JOIN fine f ON f.user_id = l.user_id AND f.trip_id = l.t JOIN zoned z ON z.user_id = l.user_id AND z.trip_id = l.t WHERE o_zone IS NOT NULL AND d_zone IS NOT NULL),
    {_distances('cl', 'o_zone, d_zone')}, {_parts('o_zone, d_zone', '2e-3')}"""


def _corridors(s, d) -> DataFrame:
    points = segmented(s, d)
    lines = trips.keep(routes.resample_linear(points, SAMPLES), routes.high_res_trips(points), routes.TRIP)
    zoned = spatial.assign_trip_zones(trips.trip_ends(points), fx.zones(s), routes.TRIP)
    return routes.corridor_shapes(lines, zoned)


@query(f"WITH RECURSIVE {CORRIDORS} SELECT o_zone, d_zone, label // 1000000 AS user_id, label % 1000000 AS trip_id, count(*) AS n_trips, count(DISTINCT t // 1000000) AS n_users FROM lab GROUP BY ALL")
def corridor_summary(s, d):
    """Trips and users of each density cluster of a corridor's trips; clusters are named by their first trip."""
    parts = routes.near_parts(_corridors(s, d), 0.002, routes.CORRIDOR, routes.TRIP)
    labels = parts.select(*routes.CORRIDOR, "trip.*", F.col("part").alias("label"))
    found = routes.cluster_summary(labels, routes.CORRIDOR).where("n_trips > 1")
    return found.select(*routes.CORRIDOR, "label.*", "n_trips", "n_users")


@query()
def corridor_clusters(s, d):
    """Each corridor's trips merged down to three routes, as far as trips within 0.004 of each other lead."""
    found = routes.corridor_clusters(_corridors(s, d), 3, 0.004)
    return found.select(*routes.CORRIDOR, *routes.TRIP, F.col("label.user_id").alias("label_user"), F.col("label.trip_id").alias("label_trip"))


# --- variants: other forms and the parameters that the operators have by default --------------------


@query(f"WITH {MATCHED}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, dep_hour) AS n FROM w) SELECT trip_id, round((tt - ff * 2) / (ff * 2), 6) AS gap FROM c WHERE n >= 1")
def relative_gap_unclipped(s, d):
    """Against a free-flow time that is given, here twice the least, so gaps may be below 0."""
    rows = behavior.relative_gap(fx.trip_routes(s, d), 1).select("user_id", F.col("free_flow").alias("least")).distinct()
    given = fx.trip_routes(s, d).join(rows, "user_id").withColumn("free_flow", 2 * F.col("least"))
    return r6(behavior.relative_gap(given, 1, clip=False).select("trip_id", "gap"), "gap")


@query(f"""WITH {fx.D_PINGS}, m AS (SELECT user_id, ts // 2592000 AS month, ts // 86400 AS trip_id, ping_id FROM pings)
    SELECT user_id, ping_id, dense_rank() OVER (ORDER BY month, user_id, trip_id) - 1 AS trip_no FROM m""")
def number_trips(s, d):
    monthly = fx.pings(s, d).select("user_id", "ping_id", F.floor(F.col("ts") / 2592000).alias("month"), F.floor(F.col("ts") / 86400).alias("trip_id"))
    return trips.number_trips(monthly, users=64).select("user_id", "ping_id", "trip_no")


@query(f"""WITH {fx.D_TRIPS}, c AS (SELECT *, {LOW.format(x='lon')} AS x, {LOW.format(x='lat')} AS y FROM trips), b AS (SELECT *, CAST(x * 100000 + y AS BIGINT) AS block_id FROM c WHERE CAST(x + y AS BIGINT) % 3 <> 0),
    l AS (SELECT *, lag(block_id) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS was FROM b) SELECT user_id, trip_id, ping_id, block_id FROM l WHERE was IS NULL OR was <> block_id""")
def block_sequence(s, d):
    """Blocks by their borders; a third of the blocks is not in the table."""
    points = segmented(s, d)
    x, y = (F.round(F.col(c) * 1000) for c in ("min_lon", "min_lat"))
    borders = points.select(*(c.alias(n) for n, c in geo.grid_bounds(F.col("lon"), F.col("lat")).items())).distinct()
    blocks = borders.where((x + y) % 3 != 0).withColumn("block_id", (x * 100000 + y).cast("long"))
    return trips.block_sequence(points, blocks).select("user_id", "trip_id", "ping_id", "block_id")


@query(f"WITH e AS (SELECT CAST(event_id AS BIGINT) AS event_id FROM events) SELECT event_id FROM e WHERE {_d_uniform(7, 'event_id')} < 7 / 30e0")
def sample_rows(s, d):
    return stats.sample_rows(fx.table(s, d, "events").select(F.col("event_id").cast("long").alias("event_id")))


@query(f"WITH RECURSIVE {HOMES.replace('5e-3', '1e-3')} SELECT user_id, round(home_lon, 10) AS home_lon, round(home_lat, 10) AS home_lat, round(work_lon, 10) AS work_lon, round(work_lat, 10) AS work_lat FROM hw")
def home_work_fine(s, d):
    """At the default distance of 0.001 degrees."""
    found = places.home_work(trips.trip_summary(segmented(s, d)).withColumn("idx", F.col("trip_id")))
    return r10(found, "home_lon", "home_lat", "work_lon", "work_lat")


@query(ORACLES["home_from_stays"].replace(VISITS, VISITS.replace("5e-3", "5e-4")))
def home_from_stays_fine(s, d):
    """At the default distance of 0.0005 degrees."""
    found = places.home_from_stays(places.stay_points(fx.pings(s, d)))
    return found.withColumns({c: F.round(c, 8) for c in ("c_lon", "c_lat")})
