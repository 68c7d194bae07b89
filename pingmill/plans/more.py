"""Further registered queries: small operators, zones of several sizes, places and stays, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pingmill.functions import classes, geo
from pingmill.functions.storage import materialise
from pingmill.operators import behavior, od, places, routes, spatial, stats, trips
from pingmill.plans import fixtures as fx
from pingmill.plans.registry import GRID, MATCHED, OD_CELLS, ORACLES, PERIOD, USERS, ZONED, _users, query, r6, r10, segmented

# --- trips and points ----------------------------------------------------------------------------


@query(f"WITH {fx.D_PINGS} SELECT user_id, ping_id, ts FROM pings WHERE NOT (ping_id % 400 > 150)")
def filter_accuracy(s, d):
    return trips.filter_accuracy(fx.pings(s, d).withColumn("accuracy", (F.col("ping_id") % 400).cast("double"))).select("user_id", "ping_id", "ts")


@query(f"WITH {fx.D_PINGS} SELECT user_id, ping_id FROM pings WHERE user_id % 7 IN (1, 3)")
def filter_zips(s, d):
    zips = s.createDataFrame([(1,), (3,)], "zipcode int")
    return trips.keep(fx.pings(s, d).withColumn("zipcode", (F.col("user_id") % 7).cast("int")), F.broadcast(zips), ["zipcode"]).select("user_id", "ping_id")


def _some(s, d, n):
    return fx.profile(s, d).where(F.col("user_id") % n == 0).select("user_id")


@query(f"WITH {fx.D_TRIPS} SELECT user_id, trip_id, ping_id FROM trips WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def drop_users(s, d):
    return trips.drop(segmented(s, d), _some(s, d, 3), ["user_id"]).select("user_id", "trip_id", "ping_id")


@query(f"WITH {fx.D_TRIPS} SELECT user_id, trip_id, ping_id, lat, lon FROM trips WHERE lon BETWEEN -975e-1 AND -97")
def points_in_box(s, d):
    return trips.lat_lon(trips.in_box(segmented(s, d), -97.5, -97.0))


@query(f"WITH {fx.D_TRIPS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT (user_id, trip_id)) AS n_trips FROM trips")
def count_entities(s, d):
    return trips.count_entities(segmented(s, d))


KM = fx.haversine("s_lat", "s_lon", "t_lat", "t_lon")


@query(f"WITH {fx.D_ENDS} SELECT user_id, round(avg({KM}), 6) AS distance FROM ends GROUP BY user_id")
def avg_distance(s, d):
    return r6(trips.avg_distance(trips.trip_ends(segmented(s, d))), "distance")


@query(f"""WITH {fx.D_TRIPS}, b AS (SELECT *, CAST(trunc((lon - -98e0) / 5e-2) AS INT) AS slot FROM trips WHERE lon BETWEEN -98 AND -96),
    l AS (SELECT *, lag(slot) OVER w AS was FROM b WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    r AS (SELECT *, CAST(sum(CASE WHEN was IS NULL OR was <> slot THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS BIGINT) - 1 AS seq FROM l)
    SELECT user_id, trip_id, seq, slot, round(avg(lat), 10) AS lat FROM r GROUP BY ALL""")
def lon_series(s, d):
    return r10(trips.lon_series(segmented(s, d), -98.0, -96.0, 0.05), "lat")


@query(f"WITH {fx.D_TRIPS} SELECT user_id, trip_id, ping_id FROM trips WHERE user_id IN (SELECT DISTINCT user_id FROM trips ORDER BY user_id LIMIT 50)")
def first_users(s, d):
    return trips.first_users(segmented(s, d)).select("user_id", "trip_id", "ping_id")


@query("SELECT CAST(c_custkey AS BIGINT) AS user_id FROM customer WHERE c_custkey % 4 = 0 UNION SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 6 = 0")
def all_users(s, d):
    return trips.all_users(_some(s, d, 4), _some(s, d, 6))


@query("SELECT CAST(c_custkey AS BIGINT) AS user_id FROM customer WHERE c_custkey % 4 = 0 INTERSECT SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 6 = 0")
def common_users(s, d):
    return trips.common_users(_some(s, d, 4), _some(s, d, 6))


@query(f"WITH {fx.D_PINGS} SELECT user_id, ping_id, ts FROM pings WHERE ts // 2592000 % 2 = 0 UNION ALL SELECT user_id, ping_id, ts FROM pings WHERE ts // 2592000 % 3 = 0")
def concatenate(s, d):
    months = fx.pings(s, d).select("user_id", "ping_id", "ts")
    month = F.floor(F.col("ts") / 2592000)
    return trips.concatenate(months.where(month % 2 == 0), months.where(month % 3 == 0).select("ts", "ping_id", "user_id"))


@query(f"WITH {fx.D_TRIPS} SELECT user_id, ping_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, ping_id) AS seq FROM trips")
def sorted_by_user(s, d):
    from pyspark.sql import Window

    return trips.sorted_by_user(segmented(s, d)).select("user_id", "ping_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "ping_id")).cast("long").alias("seq"))


@query(f"""WITH {OD_CELLS}, g AS (SELECT user_id, o_grid, d_grid, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o_grid, d_grid) AS k FROM g)
    SELECT t.user_id, t.trip_id, t.ping_id FROM trips t JOIN c USING (user_id, trip_id) JOIN k ON k.user_id = c.user_id AND k.o_grid = c.o_grid AND k.d_grid = c.d_grid WHERE k = 1 AND n >= 2""")
def trips_top_od_grid(s, d):
    return trips.trips_top_od_grid(segmented(s, d), 2).select("user_id", "trip_id", "ping_id")


@query(f"WITH {fx.D_TRIPS}, g AS (SELECT DISTINCT {GRID.format(lon='lon', lat='lat')} AS grid FROM trips) SELECT grid, round(-98e0 + (grid // 699 + 5e-1) * 2e-3, 6) AS lon, round(32e0 + (grid % 699 + 5e-1) * 2e-3, 6) AS lat FROM g")
def grid_centres(s, d):
    lon, lat = geo.grid_centre(F.col("grid"))
    return r6(segmented(s, d).select(geo.grid_id(F.col("lon"), F.col("lat")).alias("grid")).distinct().select("grid", lon.alias("lon"), lat.alias("lat")), "lon", "lat")


@query(f"WITH {fx.D_ENDS} SELECT user_id, trip_id, round(sqrt(pow(t_lon - s_lon, 2) + pow(t_lat - s_lat, 2)) / 3.33e0, 6) AS length FROM ends")
def trip_euclid(s, d):
    length = geo.euclid(F.col("s_lon"), F.col("s_lat"), F.col("t_lon"), F.col("t_lat"))
    return trips.trip_ends(segmented(s, d)).select("user_id", "trip_id", F.round(length, 6).alias("length"))


FINE = f"""leg AS (SELECT user_id, trip_id, {fx.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM trips WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    fine AS (SELECT user_id, trip_id FROM leg GROUP BY ALL HAVING max(km) <= 1)"""


@query(f"""WITH {fx.D_TRIPS}, {FINE}, c AS (SELECT user_id, count(f.trip_id) AS n FROM (SELECT DISTINCT user_id FROM trips) LEFT JOIN fine f USING (user_id) GROUP BY user_id)
    SELECT count(*) AS n_users, round(avg(CASE WHEN n >= 1 THEN 1 ELSE 0 END), 6) AS with_one, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) AS with_more FROM c""")
def main_route_coverage(s, d):
    points = segmented(s, d)
    return r6(behavior.main_route_coverage(points, routes.high_res_trips(points)), "with_one", "with_more")


# --- classes and profiles ------------------------------------------------------------------------

SCHEMES = {"weekday": (7, 9, 10, 15, 16, 18), "gap": (7, 9, 10, 15, 16, 18), "weekend": (7, 9, 12, 13, 16, 18), "region": (7, 10, 11, 15, 16, 19), "od": (7, 10, 11, 15, 16, 19)}
PERIODS = ", ".join(
    f"CASE WHEN h BETWEEN {a} AND {b} THEN 'AM' WHEN h BETWEEN {c} AND {e} THEN 'MD' WHEN h BETWEEN {f} AND {g} THEN 'PM' ELSE 'RD' END AS {n}" for n, (a, b, c, e, f, g) in SCHEMES.items()
)


@query(f"WITH h AS (SELECT DISTINCT CAST((o_orderkey * 7) % 24 AS INT) AS h FROM orders) SELECT h, {PERIODS} FROM h")
def period_schemes(s, d):
    h = fx.trip_routes(s, d).select(F.col("dep_hour").alias("h")).distinct()
    return h.select("h", *(classes.period_of_day(F.col("h"), n).alias(n) for n in classes.PERIODS))


@query(f"WITH {fx.D_OD}, f AS (SELECT o_zone, d_zone, flow / sum(flow) OVER () AS x FROM lbs) SELECT o_zone, d_zone, CASE WHEN x < 5e-4 THEN 0 WHEN x < 1e-3 THEN 1 WHEN x < 25e-4 THEN 2 WHEN x < 5e-3 THEN 3 WHEN x < 1e-2 THEN 4 ELSE 5 END AS share_class FROM f")
def flow_share_classes(s, d):
    flows = fx.od_tables(s, d)[0]
    total = flows.agg(F.sum("flow").alias("total"))
    return flows.crossJoin(F.broadcast(total)).select("o_zone", "d_zone", classes.flow_share_class(F.col("flow") / F.col("total")).alias("share_class"))


@query(f"""WITH {fx.D_PROFILE} SELECT user_id, round(exp(-pow(ln(income) - 35e-1, 2) / (2 * 64e-2)) / (income * 8e-1 * sqrt(2 * pi())), 8) AS lognormal,
    round(15e-1 / 40e0 * pow(income / 40e0, 5e-1) * exp(-pow(income / 40e0, 15e-1)), 8) AS weibull FROM profile WHERE income > 0""")
def income_densities(s, d):
    x = F.col("income")
    return fx.profile(s, d).where("income > 0").select("user_id", F.round(classes.lognormal_pdf(x, 3.5, 0.8), 8).alias("lognormal"), F.round(classes.weibull_pdf(x, 40.0, 1.5), 8).alias("weibull"))


@query(f"WITH {fx.D_ENDS}, {USERS}, a AS (SELECT user_id, avg({KM}) AS distance FROM ends GROUP BY user_id) SELECT CAST(floor(distance / 5) AS BIGINT) AS bin, round(avg(n_routes), 6) AS mean, count(*) AS n FROM users JOIN a USING (user_id) WHERE distance < 65 GROUP BY 1".replace(f"{fx.D_ORDERS}, tr AS", "tr AS"))
def mean_routes_by_distance(s, d):
    rows = _users(s, d).join(trips.avg_distance(trips.trip_ends(segmented(s, d))), "user_id")
    return r6(stats.mean_by_bin(rows, "distance", 5, 13, "n_routes", False), "mean")


@query(f"WITH {USERS} SELECT CAST(least(floor(n_trips / 10), 12) AS BIGINT) AS bin, round(avg(n_routes), 6) AS mean, count(*) AS n FROM users GROUP BY 1")
def mean_routes_by_trips(s, d):
    return r6(stats.mean_by_bin(_users(s, d), "n_trips", 10, 13, "n_routes", True), "mean")


@query(f"""WITH {USERS}, b AS (SELECT least(n_routes, 4) AS route_class, CAST(least(floor(income / 5), 19) AS INT) AS bin FROM users WHERE income BETWEEN 0 AND 100)
    SELECT route_class, bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY route_class) AS DOUBLE) / 5, 6) AS density FROM b GROUP BY route_class, bin""")
def ridge_density(s, d):
    return r6(stats.ridge_density(_users(s, d), "income", 0, 100, 20), "density")


@query(f"WITH {USERS}, c AS (SELECT CASE WHEN n_trips BETWEEN 40 AND 59 THEN '40-59' WHEN n_trips BETWEEN 60 AND 79 THEN '60-79' WHEN n_trips > 80 THEN '>80' END AS trip_class, dispersion FROM (SELECT * REPLACE (n_trips * 4 AS n_trips) FROM users)) SELECT trip_class, round(avg(dispersion), 6) AS mean, count(*) AS n FROM c WHERE trip_class IS NOT NULL GROUP BY 1")
def dispersion_trip_class(s, d):
    """Users of the small tables have a quarter of the trips that the classes are made for."""
    return r6(behavior.dispersion_trip_class(_users(s, d).withColumn("n_trips", F.col("n_trips") * 4)), "mean")


@query(f"""WITH {MATCHED}, u AS (SELECT user_id, dep_hour, count(DISTINCT route_id) AS n_routes, count(*) AS n_trips FROM m WHERE weekday >= 5 GROUP BY ALL)
    SELECT user_id, dep_hour, n_routes, n_trips, CASE WHEN dep_hour BETWEEN 7 AND 9 THEN 'AM' WHEN dep_hour BETWEEN 12 AND 13 THEN 'MD' WHEN dep_hour BETWEEN 16 AND 18 THEN 'PM' ELSE 'RD' END AS period FROM u""")
def weekend_routes_by_period(s, d):
    return behavior.routes_by_period(fx.trip_routes(s, d).where("weekday >= 5"), "weekend")


@query(f"WITH {fx.D_ROUTES} SELECT dep_hour, count(*) AS n FROM tr GROUP BY dep_hour")
def hourly_trips(s, d):
    return behavior.hourly_trips(fx.trip_routes(s, d))


@query(f"WITH {fx.D_ROUTES} SELECT round(avg(CASE WHEN (route_id = 0) = (tt < 60) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN route_id = 0 THEN 1 ELSE 0 END), 6) AS positive_share FROM tr")
def classification_accuracy(s, d):
    rows = fx.trip_routes(s, d).select((F.col("route_id") == 0).cast("int").alias("truth"), (F.col("tt") < 60).cast("int").alias("predicted"))
    return r6(stats.classification_accuracy(rows, "truth", "predicted"), "accuracy", "positive_share")


@query(f"WITH {fx.D_TRIPS}, {fx.D_ROUTES} SELECT t.user_id, t.ping_id, tr.trip_id, tr.route_id FROM pings t JOIN tr ON tr.user_id = t.user_id AND tr.trip_id = t.ping_id // 100".replace(f"{fx.D_ORDERS}, tr AS", "tr AS"))
def complete_trips(s, d):
    points = fx.pings(s, d).select("user_id", "ping_id", F.floor(F.col("ping_id") / 100).alias("trip_id"))
    return routes.complete_trips(points, fx.trip_routes(s, d).select("user_id", "trip_id", "route_id")).select("user_id", "ping_id", "trip_id", "route_id")


# --- zones ---------------------------------------------------------------------------------------

#: Large zones are squares of three zones' width; a small zone is in that which holds the mean of its corners.
RINGS = """cells AS (SELECT i % 19 AS ix, i // 19 AS iy FROM range(247) AS t(i)),
    rings AS (SELECT ix * 100 + iy AS zone_id, ix, iy, CASE WHEN (ix + iy) % 5 = 0 THEN [0e0, 1e0, 1e0] ELSE [0e0, 1e0, 1e0, 0e0] END AS xs, CASE WHEN (ix + iy) % 5 = 0 THEN [0e0, 0e0, 1e0] ELSE [0e0, 0e0, 1e0, 1e0] END AS ys FROM cells
        UNION ALL SELECT ix * 100 + iy + 5000, ix, iy, [0e0, 1e0, 0e0], [0e0, 1e0, 1e0] FROM cells WHERE (ix + iy) % 5 = 0),
    cen AS (SELECT zone_id, ix, iy, -9795e-2 + 1e-1 * (ix + list_avg(xs)) AS c_lon, 3202e-2 + 1e-1 * (iy + list_avg(ys)) AS c_lat FROM rings),
    zmap AS (SELECT zone_id AS small_zone, (ix // 3) * 100 + iy // 3 AS large_zone FROM cen WHERE ix < 18 AND iy < 12)"""

#: The same for the zones in whose cells there are pings.
TABLE_RINGS = f"{fx.D_PINGS}, " + RINGS.replace("SELECT i % 19 AS ix, i // 19 AS iy FROM range(247) AS t(i)", "SELECT DISTINCT CAST(floor((lon + 9795e-2) / 1e-1) AS BIGINT) AS ix, CAST(floor((lat - 3202e-2) / 1e-1) AS BIGINT) AS iy FROM pings")


def _large(s, base=None):
    from pingmill.sources.tables import with_boxes

    base = s.range(6 * 4).select((F.col("id") % 6).alias("ix"), F.floor(F.col("id") / 6).alias("iy")) if base is None else base
    west, south = F.lit(-97.95) + F.col("ix") * 0.3, F.lit(32.02) + F.col("iy") * 0.3
    corner = lambda x, y: F.struct((west + 0.3 * x).alias("lon"), (south + 0.3 * y).alias("lat"))
    return with_boxes(base.select((F.col("ix") * 100 + F.col("iy")).cast("long").alias("zone_id"), F.lit(0).alias("ring_id"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring")))


@query(f"WITH {TABLE_RINGS} SELECT zone_id, round(c_lon, 6) AS c_lon, round(c_lat, 6) AS c_lat FROM cen")
def zone_centroids(s, d):
    return r6(spatial.zone_centroids(fx.table_zones(s, d)), "c_lon", "c_lat")


@query(f"WITH {TABLE_RINGS} SELECT small_zone, large_zone FROM zmap")
def zone_map(s, d):
    large = fx.ping_cells(s, d).where("ix < 18 and iy < 12").select(F.floor(F.col("ix") / 3).alias("ix"), F.floor(F.col("iy") / 3).alias("iy")).distinct()
    return spatial.zone_map(fx.table_zones(s, d), _large(s, large)).where("large_zone is not null")


def _d_square(sides: tuple[float, float]) -> str:
    low, high = (f"CAST({0.1 * x!r} AS DOUBLE)" for x in sides)
    west, south = "(-9795e-2 + ix * 1e-1)", "(3202e-2 + iy * 1e-1)"
    return f"(lon >= {west} + {low} AND lon < {west} + {high} AND lat >= {south} + {low} AND lat < {south} + {high})"


@query(f"""WITH {fx.D_PINGS}, c AS (SELECT *, CAST(floor((lon + 9795e-2) / 1e-1) AS BIGINT) AS ix, CAST(floor((lat - 3202e-2) / 1e-1) AS BIGINT) AS iy FROM pings)
    SELECT user_id, ping_id, CASE WHEN (ix + iy) % 2 = 0 AND {_d_square(fx.HOLE)} AND NOT ((ix + iy) % 4 = 0 AND {_d_square(fx.ISLAND)}) THEN -1 ELSE ix * 100 + iy END AS zone_id FROM c""")
def holed_zones(s, d):
    """Pings by zones with holes and islands in holes; -1 in a hole."""
    found = spatial.assign_zones(fx.pings(s, d), fx.holed_zones(s, d), keys=["user_id", "ping_id"])
    return found.select("user_id", "ping_id", F.coalesce("zone_id", F.lit(-1).cast("long")).alias("zone_id"))


@query(f"""WITH {ZONED}, {RINGS} SELECT z.user_id, z.trip_id, o.large_zone AS o_large, e.large_zone AS d_large FROM zoned z JOIN zmap o ON o.small_zone = o_zone JOIN zmap e ON e.small_zone = d_zone""")
def map_od(s, d):
    zoned = spatial.assign_trip_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), ["user_id", "trip_id"])
    return spatial.map_od(zoned, spatial.zone_map(fx.zones(s), _large(s))).select("user_id", "trip_id", "o_large", "d_large")


@query(f"""WITH {ZONED}, {RINGS}, survey AS (SELECT o_zone, d_zone, CAST(count(*) AS DOUBLE) + 2 * sum(trip_id % 2) AS flow FROM zoned GROUP BY ALL)
    SELECT o.large_zone AS o_zone, e.large_zone AS d_zone, sum(flow) AS flow FROM survey JOIN zmap o ON o.small_zone = o_zone JOIN zmap e ON e.small_zone = d_zone WHERE o.large_zone <> e.large_zone GROUP BY 1, 2""")
def survey_od_to_zip(s, d):
    zoned = spatial.assign_trip_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), ["user_id", "trip_id"])
    rides = zoned.groupBy("o_zone", "d_zone").agg(F.count(F.lit(1)).cast("double").alias("drive_alone"), F.sum(F.col("trip_id") % 2).cast("double").alias("shared_ride"))
    return od.mapped_survey(od.survey_demand(rides), spatial.zone_map(fx.zones(s), _large(s)))


@query(f"WITH {TABLE_RINGS} SELECT a.zone_id AS o_zone, b.zone_id AS d_zone, round({fx.haversine('a.c_lat', 'a.c_lon', 'b.c_lat', 'b.c_lon')}, 5) AS km FROM cen a JOIN cen b ON a.zone_id <> b.zone_id")
def zone_distances(s, d):
    return spatial.zone_distances(spatial.zone_centroids(fx.table_zones(s, d))).withColumn("km", F.round("km", 5))


@query(f"WITH {ZONED} SELECT user_id, trip_id, CASE WHEN o_zone = 305 THEN 1 ELSE 0 END AS inside FROM zoned")
def in_named_zone(s, d):
    ends = trips.trip_ends(segmented(s, d)).select("user_id", "trip_id", F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat"))
    return spatial.in_named_zone(ends, fx.zones(s), 305, ["user_id", "trip_id"]).select("user_id", "trip_id", "inside")


@query(f"""WITH {ZONED}, {RINGS}, v AS (SELECT o_zone AS zone_id, CAST(count(*) AS DOUBLE) AS flow FROM zoned WHERE o_zone IS NOT NULL GROUP BY 1), x AS (SELECT zone_id, coalesce(flow, 0) AS flow FROM rings LEFT JOIN v USING (zone_id))
    SELECT zone_id, flow, CASE WHEN flow > 100 THEN 4 WHEN flow <= 0 THEN -1 ELSE CAST(least(4, ceil(flow / 20) - 1) AS INT) END AS class_bin FROM x""")
def zone_values(s, d):
    zoned = spatial.assign_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), "s_lon", "s_lat", "zone_id", ["user_id", "trip_id"]).where("zone_id is not null")
    flows = zoned.groupBy("zone_id").agg(F.count(F.lit(1)).cast("double").alias("flow"))
    return spatial.zone_values(fx.zones(s), flows, "flow").withColumn("class_bin", classes.class_bin(F.col("flow"), 0, 100, 5))


@query(f"WITH {ZONED}, p AS (SELECT o_zone, d_zone, {PERIOD.format(h='dep_ts // 3600 % 24')} AS period FROM zoned JOIN ends USING (user_id, trip_id)) SELECT o_zone, d_zone, period, CAST(count(*) AS DOUBLE) AS flow FROM p WHERE o_zone IS NOT NULL AND d_zone IS NOT NULL AND o_zone <> d_zone GROUP BY ALL")
def od_matrix_by_period(s, d):
    zoned = spatial.assign_trip_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), ["user_id", "trip_id"])
    return od.od_matrix(zoned.withColumn("period", classes.period_of_day((F.floor(F.col("dep_ts") / 3600) % 24).cast("int"))), ["period"])


@query(f"WITH {fx.D_OD} SELECT o_zone, d_zone, flow FROM survey WHERE flow > 1000")
def large_flows(s, d):
    return od.large_flows(fx.od_tables(s, d)[1])


def _d_large(lon: str, lat: str) -> str:
    x, y = f"CAST(floor(({lon} + 9795e-2) / 3e-1) AS BIGINT)", f"CAST(floor(({lat} - 3202e-2) / 3e-1) AS BIGINT)"
    return f"(CASE WHEN {x} BETWEEN 0 AND 5 AND {y} BETWEEN 0 AND 3 THEN {x} * 100 + {y} END)"


REGIONS = f"""{fx.D_TRIPS}, zp AS (SELECT user_id, trip_id, ts, ping_id, {_d_large('lon', 'lat')} AS zone_id FROM trips),
    zl AS (SELECT *, lag(zone_id) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS was FROM zp WHERE zone_id IS NOT NULL), zs AS (SELECT * FROM zl WHERE was IS NULL OR was <> zone_id),
    zr AS (SELECT user_id, trip_id, list_sort(list(DISTINCT zone_id)) AS r FROM zs GROUP BY ALL), rp AS (SELECT user_id, trip_id, r[1] AS region_a, r[2] AS region_b FROM zr WHERE len(r) BETWEEN 2 AND 3)"""


def _in_regions(s, d):
    return spatial.assign_zones(segmented(s, d), _large(s), keys=["user_id", "trip_id", "ping_id"])


@query(f"WITH {REGIONS} SELECT user_id, trip_id, ping_id, zone_id FROM zs")
def region_sequence(s, d):
    return routes.region_sequence(_in_regions(s, d)).select("user_id", "trip_id", "ping_id", "zone_id")


@query(f"WITH {REGIONS} SELECT user_id, trip_id, region_a, region_b FROM rp WHERE (region_a + region_b) % 3 <> 0")
def region_routes(s, d):
    ids = _large(s).select("zone_id")
    pairs = ids.withColumnRenamed("zone_id", "region_a").join(ids.withColumnRenamed("zone_id", "region_b"), F.expr("region_a < region_b and (region_a + region_b) % 3 <> 0"))
    return routes.region_routes(_in_regions(s, d), pairs).select("user_id", "trip_id", "region_a", "region_b")


@query(f"""WITH {REGIONS}, e AS (SELECT user_id, trip_id, min(ts) // 3600 % 24 AS h FROM trips GROUP BY ALL), q AS (SELECT region_a, region_b, CASE WHEN h BETWEEN 7 AND 10 THEN 'AM' WHEN h BETWEEN 11 AND 15 THEN 'MD' WHEN h BETWEEN 16 AND 19 THEN 'PM' ELSE 'RD' END AS period FROM rp JOIN e USING (user_id, trip_id))
    SELECT period, region_a, region_b, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY period) AS DOUBLE), 6) AS share FROM q GROUP BY period, region_a, region_b""")
def region_period_matrix(s, d):
    hours = segmented(s, d).groupBy("user_id", "trip_id").agg((F.floor(F.min("ts") / 3600) % 24).cast("int").alias("dep_hour"))
    return r6(behavior.region_period_matrix(routes.region_pair(routes.region_sequence(_in_regions(s, d))).join(hours, ["user_id", "trip_id"])), "share")


# --- clusters, places, stays ---------------------------------------------------------------------


def _clusters(points: str, group: str, eps: str) -> str:
    """CTEs near, reach and labels (group, idx, label) of the components of points within ``eps``."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in group.split(", "))
    return f"""near AS (SELECT {', '.join('a.' + c for c in group.split(', '))}, a.idx AS i, b.idx AS j FROM {points} a JOIN {points} b ON {same} AND sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= {eps}),
    reach AS (SELECT {group}, i, j FROM near UNION SELECT {', '.join('a.' + c for c in group.split(', '))}, a.i, b.j FROM reach a JOIN near b ON {same} AND a.j = b.i),
    labels AS (SELECT {group}, i AS idx, min(j) AS label FROM reach GROUP BY ALL)"""


LOCAL = "timezone('US/Central', to_timestamp({}))"
POOLS = f"""{fx.D_ENDS}, t AS (SELECT *, trip_id * 4 AS k, {LOCAL.format('dep_ts')} AS dep, {LOCAL.format('arr_ts')} AS arr FROM ends WHERE n_points > 5 AND round((arr_ts - dep_ts) / 60e0, 2) > 0 AND round((arr_ts - dep_ts) / 60e0, 2) < 120),
    pool AS (SELECT user_id, 'home' AS pool, k AS idx, s_lon AS lon, s_lat AS lat FROM t WHERE hour(dep) < 10 UNION ALL SELECT user_id, 'home', k + 1, t_lon, t_lat FROM t WHERE hour(arr) > 16
        UNION ALL SELECT user_id, 'work', k + 2, t_lon, t_lat FROM t WHERE isodow(dep) < 6 AND hour(arr) < 11 UNION ALL SELECT user_id, 'work', k + 3, s_lon, s_lat FROM t WHERE isodow(dep) < 6 AND hour(dep) > 15)"""
HOMES = f"""{POOLS}, {_clusters('pool', 'user_id, pool', '5e-3')},
    cl AS (SELECT user_id, pool, label, count(*) AS n, avg(lon) AS lon, avg(lat) AS lat FROM pool JOIN labels USING (user_id, pool, idx) GROUP BY ALL), al AS (SELECT user_id, pool, count(*) AS total FROM pool GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool ORDER BY n DESC, label) AS k FROM cl WHERE n >= 2), mp AS (SELECT * FROM rk JOIN al USING (user_id, pool) WHERE k = 1 AND n >= 4e-1 * total),
    hw AS (SELECT u.user_id, h.lon AS home_lon, h.lat AS home_lat, w.lon AS work_lon, w.lat AS work_lat FROM (SELECT DISTINCT user_id FROM t) u LEFT JOIN mp h ON h.user_id = u.user_id AND h.pool = 'home' LEFT JOIN mp w ON w.user_id = u.user_id AND w.pool = 'work')"""
ORACLES["home_work"] = f"WITH RECURSIVE {HOMES} SELECT user_id, round(home_lon, 10) AS home_lon, round(home_lat, 10) AS home_lat, round(work_lon, 10) AS work_lon, round(work_lat, 10) AS work_lat FROM hw"


def _homes(s, d):
    return places.home_work(trips.trip_summary(segmented(s, d)).withColumn("idx", F.col("trip_id")), eps=0.005)


@query(f"WITH RECURSIVE {HOMES} SELECT count(*) AS n, count(home_lon) AS with_home, count(CASE WHEN home_lon IS NOT NULL AND work_lon IS NOT NULL THEN 1 END) AS with_both FROM hw")
def place_coverage(s, d):
    return behavior.place_coverage(_homes(s, d))


@query(f"WITH RECURSIVE {HOMES} SELECT user_id, work_lon IS NOT NULL AS commuter FROM hw")
def commuters(s, d):
    return behavior.commuters(_homes(s, d))


@query(f"WITH RECURSIVE {HOMES}, tr AS (SELECT user_id, {_d_large('home_lon', 'home_lat')} AS tract FROM hw WHERE home_lon IS NOT NULL) SELECT user_id, tract FROM tr WHERE tract IS NOT NULL")
def home_tracts(s, d):
    return spatial.home_tracts(_homes(s, d), _large(s))


@query(f"WITH RECURSIVE {HOMES}, tr AS (SELECT user_id, {_d_large('home_lon', 'home_lat')} AS tract FROM hw WHERE home_lon IS NOT NULL) SELECT user_id, tract, CAST(20 + tract % 7 AS DOUBLE) AS income FROM tr WHERE tract % 5 <> 0")
def tract_income(s, d):
    incomes = _large(s).where("zone_id % 5 <> 0").select(F.col("zone_id").alias("tract"), (20 + F.col("zone_id") % 7).cast("double").alias("income"))
    return spatial.tract_income(spatial.home_tracts(_homes(s, d), _large(s)), incomes)


OD_PAIRS = f"""{fx.D_ENDS}, pt AS (SELECT user_id, trip_id, 0 AS side, trip_id * 2 AS idx, s_lon AS lon, s_lat AS lat FROM ends UNION ALL SELECT user_id, trip_id, 1, trip_id * 2 + 1, t_lon, t_lat FROM ends), {_clusters('pt', 'user_id', '5e-3')},
    lb AS (SELECT * FROM pt JOIN labels USING (user_id, idx)), ce AS (SELECT user_id, label, avg(lon) AS lon, avg(lat) AS lat FROM lb GROUP BY ALL),
    pr AS (SELECT user_id, trip_id, max(CASE WHEN side = 0 THEN label END) AS o, max(CASE WHEN side = 1 THEN label END) AS d FROM lb GROUP BY ALL), ct AS (SELECT user_id, o, d, count(*) AS n_trips, min(trip_id) AS first, list_sort(list(trip_id)) AS ids FROM pr GROUP BY ALL),
    rk AS (SELECT *, CAST(sum(n_trips) OVER (PARTITION BY user_id) AS BIGINT) AS n_user_trips, row_number() OVER (PARTITION BY user_id ORDER BY n_trips DESC, first DESC) AS k FROM ct),
    sp AS (SELECT rk.*, a.lon AS o_lon, a.lat AS o_lat, b.lon AS d_lon, b.lat AS d_lat FROM rk JOIN ce a ON a.user_id = rk.user_id AND a.label = o JOIN ce b ON b.user_id = rk.user_id AND b.label = d)"""
PLACES = "SELECT user_id, o, d, n_trips, array_to_string(ids, ',') AS trips, n_user_trips, round(o_lon, 10) AS o_lon, round(o_lat, 10) AS o_lat, round(d_lon, 10) AS d_lon, round(d_lat, 10) AS d_lat FROM sp WHERE k = {}"
ORACLES["significant_places"] = f"WITH RECURSIVE {OD_PAIRS} {PLACES.format(1)}"


@query(f"WITH RECURSIVE {OD_PAIRS} {PLACES.format(2)}")
def second_places(s, d):
    found = places.significant_places(segmented(s, d), 2).withColumn("trips", F.array_join(F.sort_array("trips"), ","))
    return r10(found, "o_lon", "o_lat", "d_lon", "d_lat")


@query(f"WITH RECURSIVE {OD_PAIRS} SELECT (SELECT count(*) FROM ends) AS n_trips, CAST(sum(n_trips) AS BIGINT) AS n_kept, round(sum(n_trips) / CAST((SELECT count(*) FROM ends) AS DOUBLE), 6) AS share FROM sp WHERE k = 1 AND n_trips >= 3")
def kept_share(s, d):
    ends = materialise(trips.trip_ends(segmented(s, d)), "ends")
    return r6(behavior.kept_share(places.significant_places(ends, ends=ends).where("n_trips >= 3"), ends), "share")


ORACLES["trips_of_od_rank"] = f"""WITH RECURSIVE {OD_PAIRS}, ch AS (SELECT user_id, unnest(ids) AS trip_id, o_lon, o_lat, d_lon, d_lat FROM sp WHERE k = 1 AND n_trips >= 3), fr AS (SELECT * FROM ends JOIN ch USING (user_id, trip_id))
    SELECT user_id, trip_id, ts, round(lon, 10) AS lon, round(lat, 10) AS lat, ping_id, 0 AS pos FROM trips SEMI JOIN ch USING (user_id, trip_id)
    UNION ALL SELECT user_id, trip_id, dep_ts, round(o_lon, 10), round(o_lat, 10), -1, -1 FROM fr WHERE abs(s_lon - o_lon) > 1e-9 OR abs(s_lat - o_lat) > 1e-9
    UNION ALL SELECT user_id, trip_id, arr_ts, round(d_lon, 10), round(d_lat, 10), -1, 1 FROM fr WHERE abs(t_lon - d_lon) > 1e-9 OR abs(t_lat - d_lat) > 1e-9"""

STAYS = f"""{fx.D_PINGS}, q AS (SELECT user_id, ts, lon, lat, row_number() OVER (PARTITION BY user_id ORDER BY ts, ping_id, lon, lat) AS k FROM pings),
    fold AS (SELECT user_id, k, ts AS begin, lon, lat, 1 AS n, ts, lon AS plon, lat AS plat, NULL::BIGINT AS a, NULL::BIGINT AS dur, NULL::DOUBLE AS slon, NULL::DOUBLE AS slat FROM q WHERE k = 1
        UNION ALL SELECT f.user_id, q.k, CASE WHEN same THEN f.begin WHEN far THEN q.ts ELSE f.begin END, CASE WHEN same THEN f.lon WHEN far THEN q.lon ELSE (f.lon * f.n + q.lon) / (f.n + 1) END, CASE WHEN same THEN f.lat WHEN far THEN q.lat ELSE (f.lat * f.n + q.lat) / (f.n + 1) END,
            CASE WHEN same THEN f.n WHEN far THEN 1 ELSE f.n + 1 END, CASE WHEN same THEN f.ts ELSE q.ts END, CASE WHEN same THEN f.plon ELSE q.lon END, CASE WHEN same THEN f.plat ELSE q.lat END,
            CASE WHEN NOT same AND far AND f.ts - f.begin > 600 THEN f.begin END, f.ts - f.begin, f.lon, f.lat
        FROM (SELECT fold.*, q.ts = fold.ts AND q.lon = plon AND q.lat = plat AS same, {fx.haversine('fold.lat', 'fold.lon', 'q.lat', 'q.lon')} > 3e-1 AS far FROM fold JOIN q ON q.user_id = fold.user_id AND q.k = fold.k + 1) f JOIN q ON q.user_id = f.user_id AND q.k = f.k + 1),
    stays AS (SELECT user_id, a AS arrival_ts, dur AS duration, slon AS lon, slat AS lat FROM fold WHERE a IS NOT NULL)"""
ORACLES["stay_points"] = f"WITH RECURSIVE {STAYS} SELECT user_id, arrival_ts, duration, round(lon, 10) AS lon, round(lat, 10) AS lat FROM stays"
VISITS = f"""{STAYS}, sx AS (SELECT *, arrival_ts AS idx FROM stays), {_clusters('sx', 'user_id', '5e-3')}, ls AS (SELECT *, count(*) OVER (PARTITION BY user_id, label) AS size FROM sx JOIN labels USING (user_id, idx)),
    vi AS (SELECT user_id, label, arrival_ts AS start_ts, arrival_ts + duration AS end_ts FROM ls WHERE size > 1),
    vf AS (SELECT *, max(end_ts) OVER (PARTITION BY user_id, label ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM vi),
    vg AS (SELECT *, CAST(sum(CASE WHEN start_ts - until <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, label ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM vf), vm AS (SELECT user_id, label, visit, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM vg GROUP BY ALL)"""
ORACLES["home_from_stays"] = f"""WITH RECURSIVE {VISITS}, nt AS (SELECT user_id, label, count(*) FILTER (isodow({LOCAL.format('start_ts')}) > 5 OR hour({LOCAL.format('start_ts')}) <= 8 OR hour({LOCAL.format('start_ts')}) >= 20) AS nights FROM vm GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nights DESC, label) AS k FROM nt) SELECT user_id, round(avg(lon), 8) AS c_lon, round(avg(lat), 8) AS c_lat, nights FROM rk JOIN ls USING (user_id, label) WHERE k = 1 GROUP BY user_id, label, nights"""


@query(f"WITH RECURSIVE {VISITS} SELECT user_id, label, visit, start_ts, end_ts FROM vm")
def merge_visits(s, d):
    stays = places.stay_points(fx.pings(s, d)).withColumn("idx", F.col("arrival_ts"))
    labelled = places.cluster_points(stays, ["user_id"], 0.005, 2).where("label is not null")
    return places.merge_visits(labelled.select("user_id", "label", F.col("arrival_ts").alias("start_ts"), (F.col("arrival_ts") + F.col("duration")).alias("end_ts")), ["user_id", "label"])
