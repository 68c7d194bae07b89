"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions import classes, geo
from pingmill.functions.storage import materialise
from pingmill.operators import behavior, od, places, routes, spatial, stats, trips
from pingmill.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PERIOD = "CASE WHEN {h} BETWEEN 7 AND 9 THEN 'AM' WHEN {h} BETWEEN 10 AND 15 THEN 'MD' WHEN {h} BETWEEN 16 AND 18 THEN 'PM' ELSE 'RD' END"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def many_r6(df: DataFrame, *cols: str) -> DataFrame:
    """``r6`` for many rows: decimals, which Spark rounds by, are made only for values that lie within a thousandth of half of the last digit."""
    out = {}
    for c in cols:
        x = F.col(c) * 1e6
        out[c] = F.when((F.abs(x) < 1e12) & (F.abs(x - F.floor(x) - 0.5) > 1e-3), F.floor(x + 0.5) / 1e6).otherwise(F.round(F.col(c), 6))
    return df.withColumns(out)


def r10(df: DataFrame, *cols: str) -> DataFrame:
    """Means of places of six digits: ten keep them off the edge between two roundings."""
    return df.withColumns({c: F.round(F.col(c), 10) for c in cols})


def segmented(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return trips.segment_trips(fx.pings(spark, sf_dir, dealt))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicular trips by grid cell of origin and destination."""
    return vehicular_od(spark, sf_dir)


# --- pings and trips -----------------------------------------------------------------------------


@query(f"WITH {fx.D_PINGS} SELECT user_id, count(*) AS n_records, min(ts) AS first_ts, max(ts) AS last_ts FROM pings GROUP BY user_id")
def user_inventory(s, d):
    return trips.user_inventory(fx.pings(s, d))


@query(f"""WITH {fx.D_PINGS}, i AS (SELECT user_id, count(*) AS n_records, min(ts) AS first_ts, max(ts) AS last_ts FROM pings GROUP BY user_id)
    SELECT *, (last_ts - first_ts) // 86400 + 1 AS span_days FROM i WHERE (last_ts - first_ts) // 86400 + 1 > 60 AND log10(n_records) > 1.5 AND log10(n_records) <= 7""")
def select_users(s, d):
    return trips.select_users(trips.user_inventory(fx.pings(s, d)), log_records=1.5, most_span=None)


@query(f"""WITH {fx.D_PINGS}, i AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM pings GROUP BY user_id), f AS (SELECT *, (b - a) // 86400 + 1 > 60 AND log10(n) > 1.5 AS kept FROM i)
    SELECT count(*) AS n_users, count(*) FILTER (kept) AS kept_users, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(CASE WHEN kept THEN n ELSE 0 END) AS BIGINT) AS kept_records FROM f""")
def selection_summary(s, d):
    inventory = trips.user_inventory(fx.pings(s, d))
    return trips.selection_summary(inventory, trips.select_users(inventory, log_records=1.5, most_span=None))


@query(f"""WITH {fx.D_PINGS}, m AS (SELECT user_id, ts // 2592000 AS month, count(*) AS n, min(ts) AS a, max(ts) AS b FROM pings GROUP BY ALL)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n_records, min(a) AS first_ts, max(b) AS last_ts FROM m GROUP BY user_id""")
def merge_inventory(s, d):
    months = fx.pings(s, d).withColumn("month", F.floor(F.col("ts") / 2592000)).groupBy("user_id", "month")
    return trips.merge_inventory(months.agg(F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query(f"""WITH e AS (SELECT user_id, {fx.DUCK['epoch'].format('ts')} AS ts, event_id FROM events), g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS interval_s FROM e)
    SELECT user_id, ts, interval_s FROM g WHERE interval_s > 0""")
def sample_intervals(s, d):
    e = fx.table(s, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return trips.sample_intervals(e, "event_id")


@query(f"WITH {fx.D_TRIPS} SELECT user_id, trip_id, ping_id, ts, lon, lat FROM trips")
def segment_trips(s, d):
    return segmented(s, d).select("user_id", "trip_id", "ping_id", "ts", "lon", "lat")


@query(f"""WITH {fx.D_PINGS}, g AS (SELECT *, ts - lag(ts) OVER w AS s, sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS x FROM pings WINDOW w AS (PARTITION BY user_id ORDER BY ts, ping_id)),
    r AS (SELECT *, sum(CASE WHEN s > 60 OR x > 1e-2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, ping_id) AS run FROM g), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM r)
    SELECT user_id, ping_id, dense_rank() OVER (PARTITION BY user_id ORDER BY run) AS trip_id FROM n WHERE n > 5""")
def segment_trips_fine(s, d):
    return trips.segment_trips_fine(fx.pings(s, d)).select("user_id", "ping_id", "trip_id")


@query(f"""WITH {fx.D_ENDS} SELECT user_id, trip_id, dep_ts, arr_ts, n_points, s_lon, s_lat, t_lon, t_lat, round((arr_ts - dep_ts) / 60e0, 2) AS minutes FROM ends
    WHERE n_points > 5 AND (arr_ts - dep_ts) / 60e0 > 0 AND (arr_ts - dep_ts) / 60e0 < 120""")
def trip_summary(s, d):
    return trips.trip_summary(segmented(s, d))


VEHICULAR = f"""{fx.D_ENDS}, v AS (SELECT *, {fx.haversine('s_lat', 's_lon', 't_lat', 't_lon')} AS km, (arr_ts - dep_ts) / 3600e0 AS hours FROM ends),
    vehicular AS (SELECT * FROM v WHERE n_points >= 5 AND km >= 2 AND hours > 0 AND km >= 10 * hours)"""


@query(f"WITH {VEHICULAR} SELECT user_id, trip_id, n_points, round(km, 6) AS km, round(hours, 6) AS hours FROM vehicular")
def vehicular_trips(s, d):
    return r6(trips.vehicular_trips(segmented(s, d)), "km", "hours").select("user_id", "trip_id", "n_points", "km", "hours")


@query(f"""WITH {VEHICULAR} SELECT CAST(floor(s_lon * 10) AS BIGINT) AS o_x, CAST(floor(s_lat * 10) AS BIGINT) AS o_y, CAST(floor(t_lon * 10) AS BIGINT) AS d_x, CAST(floor(t_lat * 10) AS BIGINT) AS d_y, count(*) AS n
    FROM vehicular GROUP BY ALL""")
def vehicular_od(s, d):
    box = {n: F.floor(F.col(c) * 10) for n, c in (("o_x", "s_lon"), ("o_y", "s_lat"), ("d_x", "t_lon"), ("d_y", "t_lat"))}
    return trips.vehicular_trips(segmented(s, d)).withColumns(box).groupBy("o_x", "o_y", "d_x", "d_y").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.D_TRIPS}, c AS (SELECT user_id, count(DISTINCT trip_id) AS n_trips FROM trips GROUP BY user_id)
    SELECT t.user_id, t.trip_id, t.ping_id FROM trips t JOIN c USING (user_id) WHERE n_trips >= 5""")
def active_users(s, d):
    return trips.filter_active_users(segmented(s, d), 5).select("user_id", "trip_id", "ping_id")


@query(f"""WITH {fx.D_TRIPS}, c AS (SELECT user_id, count(DISTINCT trip_id) AS n_trips FROM trips GROUP BY user_id)
    SELECT n_trips AS value, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM c GROUP BY n_trips""")
def trips_frequency(s, d):
    return stats.frequency(trips.trips_per_user(segmented(s, d)), "n_trips")


@query(f"""WITH {fx.D_TRIPS}, c AS (SELECT user_id, count(DISTINCT trip_id) AS n_trips FROM trips GROUP BY user_id), f AS (SELECT n_trips AS value, count(*) AS n FROM c GROUP BY n_trips)
    SELECT value, n, CAST(coalesce(sum(n) OVER (ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS users_above FROM f""")
def survival(s, d):
    return trips.survival_counts(trips.trips_per_user(segmented(s, d)))


@query(f"""WITH {fx.D_TRIPS}, g AS (SELECT *, coalesce({fx.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS leg FROM trips WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    a AS (SELECT *, sum(leg) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS along FROM g), m AS (SELECT *, max(along) OVER (PARTITION BY user_id, trip_id) AS total FROM a)
    SELECT ping_id, round(along, 6) AS along_km, round(total, 6) AS total_km, round(CASE WHEN total > 0 THEN along / total ELSE 0 END, 6) AS position FROM m""")
def arc_length(s, d):
    return r6(trips.arc_length(segmented(s, d)).select("ping_id", "along_km", "total_km", "position"), "along_km", "total_km", "position")


@query(f"""WITH {fx.D_TRIPS}, g AS (SELECT *, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM trips WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id))
    SELECT user_id, trip_id, ts, round(dx, 6) AS dx, round(dy, 6) AS dy FROM g WHERE sqrt(dx * dx + dy * dy) <= 1e-1""")
def trip_vectors(s, d):
    return r6(trips.trip_vectors(segmented(s, d)), "dx", "dy")


GRID = "(699 * CAST(trunc(({lon} - -98e0) / 2e-3) AS INT) + CAST(trunc(({lat} - 32e0) / 2e-3) AS INT))"
CELLS = f"""{fx.D_TRIPS}, g AS (SELECT *, {GRID.format(lon='lon', lat='lat')} AS grid FROM trips),
    l AS (SELECT *, lag(grid) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS before FROM g), cells AS (SELECT user_id, trip_id, ping_id, ts, grid FROM l WHERE before IS NULL OR grid <> before)"""


@query(f"WITH {CELLS} SELECT user_id, trip_id, ping_id, grid FROM cells")
def trip_to_grids(s, d):
    return trips.trip_to_grids(segmented(s, d)).select("user_id", "trip_id", "ping_id", "grid")


@query(f"""WITH {CELLS}, f AS (SELECT *, lag(grid) OVER w AS b FROM cells WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    x AS (SELECT *, coalesce(NOT list_contains(list_transform(range(225), lambda i: b + (i // 15 - 7) * 699 + i % 15 - 7), grid), false) AS far FROM f),
    r AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, trip_id ORDER BY ts, ping_id) AS run FROM x), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, trip_id, run) AS n FROM r)
    SELECT user_id, trip_id AS source_trip, ping_id, dense_rank() OVER (PARTITION BY user_id, trip_id ORDER BY run) AS trip_id FROM n WHERE n > 5""")
def split_grid_runs(s, d):
    return trips.split_grid_runs(trips.trip_to_grids(segmented(s, d)), w=7).select("user_id", "source_trip", "ping_id", "trip_id")


OD_CELLS = f"""{fx.D_ENDS}, c AS (SELECT user_id, trip_id, {GRID.format(lon='s_lon', lat='s_lat')} AS o_grid, {GRID.format(lon='t_lon', lat='t_lat')} AS d_grid FROM ends)"""


@query(f"""WITH {OD_CELLS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id, o_grid, d_grid) AS n FROM c)
    SELECT user_id, trip_id, o_grid, d_grid FROM n WHERE n >= 2 AND abs(o_grid // 699 - d_grid // 699) + abs(o_grid % 699 - d_grid % 699) >= 10""")
def frequent_od_trips(s, d):
    return trips.trips_frequent_od(segmented(s, d), 2)


@query(f"""WITH {OD_CELLS}, g AS (SELECT user_id, o_grid, d_grid, count(*) AS n FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o_grid, d_grid) AS k FROM g)
    SELECT user_id, o_grid, d_grid, n FROM n WHERE k = 1 AND n >= 2""")
def top_od_grid(s, d):
    from pyspark.sql import Window

    counts = trips.od_grid_trips(segmented(s, d)).groupBy("user_id", "o_grid", "d_grid").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "o_grid", "d_grid"))
    return counts.withColumn("k", rank).where("k = 1 and n >= 2").drop("k")


@query(f"""WITH {fx.D_PINGS}, b AS (SELECT CAST(least(floor((lon - -98e0) / (2e0 / 512)), 511) AS INT) AS x_bin, CAST(least(floor((lat - 32e0) / (14e-1 / 512)), 511) AS INT) AS y_bin
    FROM pings WHERE lon BETWEEN -98 AND -96 AND lat BETWEEN 32 AND 334e-1) SELECT x_bin, y_bin, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM b GROUP BY ALL""")
def presence_grid(s, d):
    return r6(stats.presence_grid(fx.pings(s, d), (-98.0, -96.0, 32.0, 33.4)), "log_n")


@query(f"""WITH {fx.D_PINGS}, m AS (SELECT user_id, ts // 2592000 AS month, ts // 86400 AS trip_id, ping_id FROM pings)
    SELECT user_id, ping_id, dense_rank() OVER (PARTITION BY user_id ORDER BY month, trip_id) AS trip_id FROM m""")
def combine_trips(s, d):
    monthly = fx.pings(s, d).select("user_id", "ping_id", F.floor(F.col("ts") / 2592000).alias("month"), F.floor(F.col("ts") / 86400).alias("trip_id"))
    return trips.combine_trips(monthly)


@query(f"""WITH e AS (SELECT event_id, {fx.DUCK['epoch'].format('ts')} AS ts FROM events), l AS (SELECT event_id, timezone('US/Central', to_timestamp(ts)) AS t FROM e)
    SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS local_dt, CAST((isodow(t) - 1) * 24 + hour(t) AS INT) AS hour_of_week, {PERIOD.format(h='hour(t)')} AS period FROM l""")
def local_times(s, d):
    local = classes.local_time(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return fx.table(s, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_dt"), classes.hour_of_week(local).cast("int").alias("hour_of_week"), classes.period_of_day(F.hour(local)).alias("period"))


@query(f"""WITH e AS (SELECT timezone('US/Central', to_timestamp({fx.DUCK['epoch'].format('ts')})) AS t FROM events), c AS (SELECT CAST((isodow(t) - 1) * 24 + hour(t) AS INT) AS h, count(*) AS n FROM e GROUP BY 1)
    SELECT CAST(i AS INT) AS hour_of_week, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE), 6) AS share FROM range(168) AS r(i) LEFT JOIN c ON h = i""")
def weekly_profile(s, d):
    local = classes.local_time(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return r6(od.weekly_profile(fx.table(s, d, "events").select(classes.hour_of_week(local).alias("hour_of_week"))), "share")


# --- profiles and statistics ---------------------------------------------------------------------


@query(f"""WITH {fx.D_PROFILE} SELECT user_id, CASE WHEN income < 26 THEN 'Low' WHEN income < 78 THEN 'Middle' ELSE 'High' END AS level, CAST(least(floor(income / 25), 2) AS INT) AS bucket,
    CASE WHEN income > 100 THEN 4 WHEN income <= 0 THEN -1 ELSE CAST(least(4, ceil(income / 20) - 1) AS INT) END AS class_bin, round(CASE WHEN income > 1 THEN log10(income) ELSE 0 END, 6) AS log_income FROM profile""")
def income_classes(s, d):
    x = F.col("income")
    return fx.profile(s, d).select("user_id", classes.income_level(x).alias("level"), classes.income_bucket(x).alias("bucket"), classes.class_bin(x, 0, 100, 5).alias("class_bin"), F.round(classes.log_flow(x), 6).alias("log_income"))


@query(f"""WITH {fx.D_PROFILE}, q AS (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.5) AS q2, quantile_cont(income, 0.75) AS q3 FROM profile) SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM q""")
def income_quartiles(s, d):
    return r6(stats.quartiles(fx.profile(s, d), "income"), "q1", "q2", "q3")


@query(f"""WITH {fx.D_PROFILE}, b AS (SELECT CAST(least(floor(income / 10), 9) AS INT) AS bin FROM profile WHERE income BETWEEN 0 AND 100), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
    SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE), 6) AS share FROM range(10) AS r(i) LEFT JOIN c ON bin = i""")
def income_histogram(s, d):
    return r6(stats.histogram(fx.profile(s, d), "income", 0, 100, 10), "share")


@query(f"""WITH {fx.D_PROFILE} SELECT round(exp(avg(ln(income))), 6) AS scale, round(stddev_pop(ln(income)), 6) AS shape, count(*) AS n FROM profile WHERE income > 0""")
def lognormal_fit(s, d):
    return r6(stats.lognormal_fit(fx.profile(s, d), "income"), "scale", "shape")


USERS = f"""{fx.D_ROUTES}, {fx.D_PROFILE}, x AS (SELECT *, tt / min(tt) OVER (PARTITION BY user_id) - 1 AS excess FROM tr),
    du AS (SELECT user_id, stddev_pop(excess) AS dispersion, count(*) AS n_trips, count(DISTINCT route_id) AS n_routes FROM x GROUP BY user_id), users AS (SELECT * FROM du JOIN profile USING (user_id))"""


def _users(s, d):
    return behavior.user_dispersion(fx.trip_routes(s, d)).join(fx.profile(s, d), "user_id")


@query(f"WITH {USERS} SELECT user_id, round(dispersion, 6) AS dispersion, n_trips, n_routes FROM du")
def user_dispersion(s, d):
    return r6(behavior.user_dispersion(fx.trip_routes(s, d)), "dispersion")


@query(f"""WITH {USERS} SELECT n_routes, commuter, count(*) AS n, round(quantile_cont(dispersion, 0.25), 6) AS p25, round(quantile_cont(dispersion, 0.5), 6) AS p50, round(quantile_cont(dispersion, 0.75), 6) AS p75
    FROM users WHERE n_trips >= 5 AND n_routes BETWEEN 1 AND 6 GROUP BY GROUPING SETS ((n_routes), (n_routes, commuter))""")
def dispersion_by_routes(s, d):
    return r6(behavior.dispersion_by_routes(_users(s, d), 5), "p25", "p50", "p75")


@query(f"""WITH {USERS}, b AS (SELECT *, CAST(n_trips // 5 - 1 AS INT) AS trip_bin FROM users WHERE n_trips BETWEEN 5 AND 99)
    SELECT trip_bin, commuter, count(*) AS n, round(quantile_cont(dispersion, 0.25), 6) AS p25, round(quantile_cont(dispersion, 0.5), 6) AS p50, round(quantile_cont(dispersion, 0.75), 6) AS p75
    FROM b GROUP BY GROUPING SETS ((trip_bin), (trip_bin, commuter))""")
def dispersion_by_trips(s, d):
    return r6(behavior.dispersion_by_trips(_users(s, d), 5), "p25", "p50", "p75")


QUARTILED = f"""{USERS}, cut AS (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.5) AS q2, quantile_cont(income, 0.75) AS q3 FROM users),
    quart AS (SELECT users.*, CASE WHEN income < q1 THEN 'Q1' WHEN income < q2 THEN 'Q2' WHEN income < q3 THEN 'Q3' ELSE 'Q4' END AS quartile FROM users, cut)"""


@query(f"WITH {QUARTILED} SELECT quartile, n_routes, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY quartile) AS DOUBLE), 6) AS share FROM quart GROUP BY quartile, n_routes")
def routes_by_quartile(s, d):
    return r6(stats.distribution_by(stats.with_quartile(_users(s, d), "income"), "quartile", "n_routes"), "share")


@query(f"""WITH {USERS}, c AS (SELECT CASE WHEN income < 26 THEN 'Low' WHEN income < 78 THEN 'Middle' ELSE 'High' END AS level, n_routes FROM users)
    SELECT level, n_routes, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY level) AS DOUBLE), 6) AS share FROM c GROUP BY level, n_routes""")
def routes_by_income_class(s, d):
    return r6(stats.distribution_by(_users(s, d).withColumn("level", classes.income_level(F.col("income"))), "level", "n_routes"), "share")


@query(f"WITH {USERS} SELECT CAST(least(floor(income / 10), 9) AS BIGINT) AS bin, round(avg(n_routes), 6) AS mean, count(*) AS n FROM users GROUP BY 1")
def mean_routes_by_income(s, d):
    return r6(stats.mean_by_bin(_users(s, d), "income", 10, 10, "n_routes", True), "mean")


@query(f"""WITH {USERS} SELECT n_routes, round(quantile_cont(income, 0.05), 6) AS p05, round(quantile_cont(income, 0.25), 6) AS p25, round(quantile_cont(income, 0.5), 6) AS p50, round(quantile_cont(income, 0.75), 6) AS p75,
    round(quantile_cont(income, 0.8), 6) AS p80 FROM users GROUP BY n_routes""")
def income_boxes(s, d):
    return r6(stats.box_summary(_users(s, d), "n_routes", "income"), "p05", "p25", "p50", "p75", "p80")


@query(f"WITH {USERS} SELECT least(n_routes, 4) AS route_class, round(quantile_cont(income, 0.5), 6) AS median, count(*) AS n FROM users GROUP BY 1")
def ridge_income(s, d):
    return r6(stats.ridge_summary(_users(s, d), "income"), "median")


@query(f"""WITH {USERS}, b AS (SELECT least(n_routes, 4) AS route_class, CAST(least(floor(income / 25), 2) AS INT) AS k FROM users)
    SELECT route_class, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, round(count(*) FILTER (k = 0) / CAST(count(*) AS DOUBLE), 6) AS share0,
    round(count(*) FILTER (k = 1) / CAST(count(*) AS DOUBLE), 6) AS share1, round(count(*) FILTER (k = 2) / CAST(count(*) AS DOUBLE), 6) AS share2 FROM b GROUP BY route_class""")
def routes_income_crosstab(s, d):
    return r6(behavior.routes_income_crosstab(_users(s, d)), "share0", "share1", "share2")


# --- routing behaviour ---------------------------------------------------------------------------

MATCHED = f"{fx.D_ROUTES}, {fx.D_PROFILE}, m AS (SELECT * FROM tr WHERE route_id <> -1), w AS (SELECT *, min(tt) OVER (PARTITION BY user_id) AS ff FROM m WHERE weekday < 5)"


@query(f"WITH {fx.D_ROUTES} SELECT count(*) AS n, round(avg(CASE WHEN route_id = -1 THEN 1 ELSE 0 END), 6) AS unmatched FROM tr")
def unmatched_share(s, d):
    return r6(behavior.unmatched_share(fx.trip_routes(s, d)), "unmatched")


@query(f"WITH {MATCHED} SELECT user_id, dep_hour, round(avg(tt) / min(ff), 6) AS tti, count(*) AS n FROM w GROUP BY user_id, dep_hour HAVING count(*) >= 1")
def travel_time_index(s, d):
    return r6(behavior.travel_time_index(fx.trip_routes(s, d), 1), "tti")


@query(f"WITH {MATCHED}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, dep_hour) AS n FROM w) SELECT trip_id, round(greatest((tt - ff) / ff, 0), 6) AS gap FROM c WHERE n >= 1")
def relative_gap(s, d):
    return r6(behavior.relative_gap(fx.trip_routes(s, d), 1).select("trip_id", "gap"), "gap")


REL = f"""{MATCHED}, pk AS (SELECT *, {PERIOD.format(h='dep_hour')} AS period FROM w), g AS (SELECT user_id, period, count(*) AS n, least(count(DISTINCT route_id), 5) AS n_routes, quantile_cont(tt, 0.85) AS p85, avg(tt) AS mean, min(tt) AS lo
    FROM pk WHERE period IN ('AM', 'PM') GROUP BY user_id, period HAVING count(*) >= 2), rel AS (SELECT user_id, period, n, n_routes, (p85 - mean) / mean AS buffer_index, p85 / lo AS planning_index FROM g)"""


@query(f"WITH {REL} SELECT user_id, period, n, n_routes, round(buffer_index, 6) AS buffer_index, round(planning_index, 6) AS planning_index FROM rel")
def reliability(s, d):
    return r6(behavior.reliability(fx.trip_routes(s, d), 2), "buffer_index", "planning_index")


@query(f"""WITH {REL} SELECT period, n_routes, round(avg(planning_index), 6) AS mean, round(quantile_cont(planning_index, 0.25), 6) AS p25, round(quantile_cont(planning_index, 0.9), 6) AS p90, count(*) AS n FROM rel GROUP BY period, n_routes""")
def reliability_by_routes(s, d):
    return r6(behavior.reliability_by_routes(behavior.reliability(fx.trip_routes(s, d), 2)), "mean", "p25", "p90")


@query(f"""WITH {REL}, j AS (SELECT *, CASE WHEN income < 26 THEN 'Low' WHEN income < 78 THEN 'Middle' ELSE 'High' END AS income_class FROM rel JOIN profile USING (user_id))
    SELECT income_class, period, round(avg(planning_index), 6) AS mean, round(avg(CASE WHEN planning_index > 1 THEN 1 ELSE 0 END), 6) AS above_one, count(*) AS n FROM j GROUP BY income_class, period""")
def reliability_by_income(s, d):
    return r6(behavior.reliability_by_income(behavior.reliability(fx.trip_routes(s, d), 2), fx.profile(s, d)), "mean", "above_one")


@query(f"""WITH {MATCHED}, u AS (SELECT user_id, dep_hour, count(DISTINCT route_id) AS n_routes, {PERIOD.format(h='dep_hour')} AS period FROM m GROUP BY user_id, dep_hour)
    SELECT period, n_routes, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY period) AS DOUBLE), 6) AS share FROM u WHERE n_routes BETWEEN 1 AND 5 GROUP BY period, n_routes""")
def route_dist_by_period(s, d):
    return r6(behavior.route_dist_by_period(fx.trip_routes(s, d)), "share")


DOMINANT = f"""{MATCHED}, p AS (SELECT user_id, route_id, count(*) AS n FROM m GROUP BY user_id, route_id), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS n_trips, count(*) OVER (PARTITION BY user_id) AS n_routes,
    row_number() OVER (PARTITION BY user_id ORDER BY n DESC, route_id) AS k FROM p), dom AS (SELECT user_id, route_id, CAST(n_trips AS BIGINT) AS n_trips, n_routes, n / CAST(n_trips AS DOUBLE) AS share FROM k WHERE k = 1 AND n_trips > 4 AND n_routes >= 2)"""


@query(f"WITH {DOMINANT} SELECT user_id, route_id, n_trips, n_routes, round(share, 6) AS share FROM dom")
def dominant_route(s, d):
    return r6(behavior.dominant_route(fx.trip_routes(s, d)), "share")


@query(f"""WITH {DOMINANT} SELECT dep_hour, CAST(sum(CASE WHEN m.route_id = dom.route_id THEN 1 ELSE 0 END) AS BIGINT) AS dominant, count(*) AS n,
    round(1 - sum(CASE WHEN m.route_id = dom.route_id THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS alternative_share FROM m JOIN dom USING (user_id) GROUP BY dep_hour""")
def alternative_share_by_hour(s, d):
    return r6(behavior.alternative_share_by_hour(fx.trip_routes(s, d)), "alternative_share")


@query(f"""WITH {MATCHED}, z AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT route_id)), '-') AS route_set FROM m GROUP BY user_id)
    SELECT route_set, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM z) AS DOUBLE), 6) AS share FROM z GROUP BY route_set ORDER BY n DESC, route_set LIMIT 8""")
def top_route_sets(s, d):
    return r6(behavior.top_route_sets(fx.trip_routes(s, d)), "share")


@query(f"""WITH {MATCHED}, z AS (SELECT count(DISTINCT route_id) AS r FROM m GROUP BY user_id) SELECT round(avg(CASE WHEN r = 1 THEN 1 ELSE 0 END), 6) AS one, round(avg(CASE WHEN r = 2 THEN 1 ELSE 0 END), 6) AS two,
    round(avg(CASE WHEN r = 3 THEN 1 ELSE 0 END), 6) AS three, round(avg(CASE WHEN r > 3 THEN 1 ELSE 0 END), 6) AS more FROM z""")
def route_count_shares(s, d):
    return r6(behavior.route_count_shares(fx.trip_routes(s, d)), "one", "two", "three", "more")


@query(f"WITH {fx.D_ROUTES}, {fx.D_PROFILE} SELECT tract, count(*) AS n_users, population FROM profile LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS tract, CAST(100000 + n_nationkey * 5000 AS DOUBLE) AS population FROM nation WHERE n_nationkey % 9 <> 4) USING (tract) GROUP BY tract, population")
def tract_representativeness(s, d):
    return behavior.tract_representativeness(fx.profile(s, d), fx.od_tables(s, d)[2].withColumnRenamed("zone_id", "tract"))


@query(f"""WITH {fx.D_ROUTES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id, route_id) AS n, min(route_id) OVER (PARTITION BY user_id) AS a, max(route_id) OVER (PARTITION BY user_id) AS b FROM tr)
    SELECT user_id, trip_id, route_id FROM n WHERE n > 2 OR a = b""")
def clean_routes(s, d):
    return routes.clean_routes(fx.trip_routes(s, d)).select("user_id", "trip_id", "route_id")


@query(f"""WITH {fx.D_ROUTES}, {fx.D_PROFILE}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id, route_id) AS n, min(route_id) OVER (PARTITION BY user_id) AS a, max(route_id) OVER (PARTITION BY user_id) AS b FROM tr),
    c AS (SELECT user_id, count(*) AS n_trips, nullif(count(DISTINCT route_id) FILTER (n > 2 OR a = b), 0) AS n_routes FROM n GROUP BY user_id)
    SELECT user_id, coalesce(n_trips, -1) AS n_trips, coalesce(n_routes, -1) AS n_routes FROM profile LEFT JOIN c USING (user_id)""")
def profile_route_counts(s, d):
    return routes.profile_with_counts(fx.profile(s, d), routes.route_counts(fx.trip_routes(s, d))).select("user_id", "n_trips", "n_routes")


# --- zones and matrices --------------------------------------------------------------------------

def _d_zone(lon: str, lat: str) -> str:
    x, y = f"CAST(floor(({lon} + 9795e-2) / 1e-1) AS BIGINT)", f"CAST(floor(({lat} - 3202e-2) / 1e-1) AS BIGINT)"
    return f"""(CASE WHEN {x} NOT BETWEEN 0 AND 18 OR {y} NOT BETWEEN 0 AND 12 THEN NULL WHEN ({x} + {y}) % 5 = 0 AND ({lat} - 3202e-2) / 1e-1 - {y} > ({lon} + 9795e-2) / 1e-1 - {x} THEN {x} * 100 + {y} + 5000 ELSE {x} * 100 + {y} END)"""


ZONED = f"{fx.D_ENDS}, zoned AS (SELECT user_id, trip_id, {_d_zone('s_lon', 's_lat')} AS o_zone, {_d_zone('t_lon', 't_lat')} AS d_zone FROM ends)"


@query(f"WITH {ZONED} SELECT user_id, trip_id, o_zone, d_zone FROM zoned WHERE o_zone IS NOT NULL AND d_zone IS NOT NULL")
def assign_trip_zones(s, d):
    return spatial.assign_trip_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), ["user_id", "trip_id"]).select("user_id", "trip_id", "o_zone", "d_zone")


@query(f"WITH {ZONED} SELECT o_zone, d_zone, CAST(count(*) AS DOUBLE) AS flow FROM zoned WHERE o_zone IS NOT NULL AND d_zone IS NOT NULL AND o_zone <> d_zone GROUP BY o_zone, d_zone")
def od_matrix(s, d):
    return od.od_matrix(spatial.assign_trip_zones(trips.trip_ends(segmented(s, d)), fx.zones(s), ["user_id", "trip_id"]))


MERGED = f"{fx.D_OD}, merged AS (SELECT coalesce(l.o_zone, v.o_zone) AS o_zone, coalesce(l.d_zone, v.d_zone) AS d_zone, coalesce(l.flow, 0) AS estimate, coalesce(v.flow, 0) AS survey FROM lbs l FULL JOIN survey v ON l.o_zone = v.o_zone AND l.d_zone = v.d_zone)"


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_od(s, d):
    lbs, survey, _ = fx.od_tables(s, d)
    return od.merge_od(lbs, survey)


@query(f"WITH {MERGED} SELECT count(*) AS n, round(1 - sum((estimate - survey) * (estimate - survey)) / (var_pop(estimate) * count(*)), 6) AS r2, round(regr_slope(estimate, survey), 6) AS slope, round(regr_intercept(estimate, survey), 6) AS intercept, round(corr(estimate, survey), 6) AS corr FROM merged")
def compare_od(s, d):
    lbs, survey, _ = fx.od_tables(s, d)
    return r6(od.compare_od(od.merge_od(lbs, survey)), "r2", "slope", "intercept", "corr")


@query(f"WITH {fx.D_OD} SELECT least(o_zone, d_zone) AS zone_a, greatest(o_zone, d_zone) AS zone_b, sum(flow) AS flow FROM lbs GROUP BY 1, 2")
def undirected_od(s, d):
    return od.undirected(fx.od_tables(s, d)[0])


@query(f"WITH {fx.D_OD} SELECT o_zone, d_zone, flow FROM lbs ORDER BY flow DESC, o_zone, d_zone LIMIT 100")
def top_flows(s, d):
    return od.top_flows(fx.od_tables(s, d)[0], 100)


@query(f"WITH {fx.D_OD}, u AS (SELECT least(o_zone, d_zone) AS zone_a, greatest(o_zone, d_zone) AS zone_b, sum(flow) AS flow FROM lbs GROUP BY 1, 2) SELECT zone_a, zone_b, flow, round(flow / (SELECT sum(flow) FROM lbs), 6) AS share FROM u WHERE flow / (SELECT sum(flow) FROM lbs) >= 1e-4")
def ranked_shares(s, d):
    return r6(od.ranked_shares(fx.od_tables(s, d)[0]), "share")


@query(f"WITH {fx.D_OD} SELECT d_zone AS zone_id, sum(flow) AS flow FROM lbs WHERE o_zone = 3 GROUP BY d_zone")
def zone_flow(s, d):
    return od.zone_flow(fx.od_tables(s, d)[0], 3)


@query(f"WITH {fx.D_OD} SELECT o_zone AS zone_id, round(sum(flow) * 417349003564e-11, 6) AS flow FROM lbs GROUP BY o_zone")
def zone_totals(s, d):
    return r6(od.zone_totals(fx.od_tables(s, d)[0], True, 4.17349003564), "flow")


FACTORS = f"{fx.D_OD}, {fx.D_PROFILE}, fa AS (SELECT tract AS zone_id, count(*) AS n_users FROM profile GROUP BY tract), factors AS (SELECT zone_id, n_users, coalesce(population, 0) AS population, coalesce(population, 0) / n_users AS factor FROM fa LEFT JOIN population USING (zone_id))"


def _factors(s, d):
    return od.expansion_factors(fx.profile(s, d).select(F.col("tract").alias("zone_id")), fx.od_tables(s, d)[2])


@query(f"WITH {FACTORS} SELECT zone_id, n_users, population, round(factor, 6) AS factor FROM factors")
def expansion_factors(s, d):
    return r6(_factors(s, d), "factor")


@query(f"WITH {FACTORS} SELECT o_zone, d_zone, flow, round(flow * coalesce(factor, (SELECT sum(population) / sum(n_users) FROM factors)) / 181, 6) AS flow_expanded FROM lbs LEFT JOIN factors ON zone_id = o_zone")
def expand_od(s, d):
    return r6(od.expand_od(fx.od_tables(s, d)[0], _factors(s, d)), "flow_expanded")


# --- clusters, places, stays, routes: SQL with recursion is in ``more`` --


@query()
def home_work(s, d):
    ends = trips.trip_summary(segmented(s, d)).withColumn("idx", F.col("trip_id"))
    return r10(places.home_work(ends, eps=0.005), "home_lon", "home_lat", "work_lon", "work_lat")


@query()
def significant_places(s, d):
    found = places.significant_places(segmented(s, d)).withColumn("trips", F.array_join(F.sort_array("trips"), ","))
    return r10(found, "o_lon", "o_lat", "d_lon", "d_lat")


@query()
def trips_of_od_rank(s, d):
    return r10(places.trips_of_od_rank(segmented(s, d), 1, 3), "lon", "lat")


@query()
def stay_points(s, d):
    return r10(places.stay_points(fx.pings(s, d)), "lon", "lat")


@query()
def home_from_stays(s, d):
    found = places.home_from_stays(places.stay_points(fx.pings(s, d)), 0.005)
    return found.withColumns({c: F.round(c, 8) for c in ("c_lon", "c_lat")})


@query()
def detect_routes(s, d):
    return routes.detect_routes(segmented(s, d, dealt=True))


# --- grid bounds, resampling, trip similarity, samples -------------------------------------------

LOW = "CAST(floor(CAST(trunc({x} * 1000) AS BIGINT) / 2) * 2 AS DOUBLE)"


@query(f"""WITH {fx.D_PINGS}, c AS (SELECT {LOW.format(x='lon')} AS x, {LOW.format(x='lat')} AS y FROM pings)
    SELECT x / 1000 AS min_lon, (x + 2) / 1000 AS max_lon, y / 1000 AS min_lat, (y + 2) / 1000 AS max_lat, count(*) AS n FROM c GROUP BY x, y""")
def grid_bounds(s, d):
    bounds = geo.grid_bounds(F.col("lon"), F.col("lat"))
    return fx.pings(s, d).groupBy(*(c.alias(n) for n, c in bounds.items())).agg(F.count(F.lit(1)).alias("n"))


SAMPLES = 10
RESAMPLED = f"""{fx.D_TRIPS}, seq AS (SELECT user_id, trip_id, lon, lat, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id, trip_id) AS m FROM trips WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    want AS (SELECT DISTINCT user_id, trip_id, m, k FROM seq CROSS JOIN range({SAMPLES}) AS r(k)), pos AS (SELECT *, k * ((m - 1) / {SAMPLES - 1}e0) AS x FROM want),
    res AS (SELECT p.user_id, p.trip_id, p.k, CASE WHEN p.k = {SAMPLES - 1} THEN z.lon ELSE a.lon + (b.lon - a.lon) * (p.x - a.i) END AS lon, CASE WHEN p.k = {SAMPLES - 1} THEN z.lat ELSE a.lat + (b.lat - a.lat) * (p.x - a.i) END AS lat
        FROM pos p JOIN seq a ON a.user_id = p.user_id AND a.trip_id = p.trip_id AND a.i = floor(p.x) JOIN seq z ON z.user_id = p.user_id AND z.trip_id = p.trip_id AND z.i = p.m - 1
        LEFT JOIN seq b ON b.user_id = p.user_id AND b.trip_id = p.trip_id AND b.i = a.i + 1)"""


@query(f"WITH {RESAMPLED} SELECT user_id, trip_id, k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM res")
def resample_linear(s, d):
    return r6(routes.resample_linear(segmented(s, d), SAMPLES), "lon", "lat")


@query(f"""WITH {RESAMPLED} SELECT a.user_id, a.trip_id AS trip_i, b.trip_id AS trip_j, round(1 / (avg(sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) / 3.33e0) + 1e-6), 4) AS similarity
    FROM res a JOIN res b ON a.user_id = b.user_id AND a.k = b.k AND a.trip_id < b.trip_id GROUP BY ALL""")
def similarity_aligned(s, d):
    found = routes.similarity_aligned(routes.resample_linear(segmented(s, d), SAMPLES))
    return found.withColumn("similarity", F.round("similarity", 4))


@query()
def agglomerate(s, d):
    found = routes.similarity_aligned(routes.resample_linear(segmented(s, d), SAMPLES))
    return routes.agglomerate(found.withColumn("dist", 1 / F.col("similarity")), 3)


@query()
def smooth_traces(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "trip_id").orderBy("ts", "ping_id")
    return many_r6(routes.smooth_traces(segmented(s, d, dealt=True).withColumn("k", F.row_number().over(order)), eps=0.001), "lon", "lat")


def _d_uniform(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0)"


@query(f"""WITH {fx.D_PROFILE}, w AS (SELECT user_id, income, sum(income) OVER (ORDER BY md5('7:' || CAST(user_id AS VARCHAR)), user_id ROWS UNBOUNDED PRECEDING) AS high FROM profile),
    draws AS (SELECT {_d_uniform(7, 'k')} * (SELECT sum(income) FROM profile) AS u FROM range(50000) AS t(k)), hit AS (SELECT u, min(high) AS high FROM (SELECT u, high FROM draws ASOF JOIN (SELECT high FROM w WHERE income > 0) w ON u < high) GROUP BY u)
    SELECT user_id, income FROM draws JOIN hit USING (u) JOIN w USING (high) WHERE income > 0""")
def weighted_sample(s, d):
    return stats.weighted_sample(fx.profile(s, d).select("user_id", "income"), "income", key=["user_id"])


@query(f"""WITH {fx.D_PROFILE}, z AS (SELECT user_id, income AS m, sqrt(-2 * ln({_d_uniform(7, 'user_id')} + 2e0 ** -53)) * cos(2 * 3.141592653589793e0 * {_d_uniform(8, 'user_id')}) AS z FROM profile)
    SELECT user_id, m AS income, CAST(trunc(greatest(least(m + z * m / 4, m * 125e-2), m * 75e-2)) AS INT) AS income_draw FROM z""")
def perturb_income(s, d):
    return stats.perturb_income(fx.profile(s, d).select("user_id", "income"), "income", key=["user_id"])


STEPS_OFF = "greatest(abs((({d}) + 699349) % 699 - 349), abs((({d}) - ((({d}) + 699349) % 699 - 349)) // 699))"


@query(f"""WITH {CELLS}, leg AS (SELECT user_id, trip_id, {fx.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM trips WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    fine AS (SELECT user_id, trip_id FROM leg GROUP BY ALL HAVING max(km) <= 1),
    c AS (SELECT *, row_number() OVER w - 1 AS pos, lag(grid) OVER w AS near FROM cells WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY ts, ping_id)),
    h AS (SELECT *, min(grid) OVER (PARTITION BY user_id, trip_id) AS lo, max(grid) OVER (PARTITION BY user_id, trip_id) AS hi, count(*) OVER (PARTITION BY user_id, trip_id) AS n FROM c SEMI JOIN fine USING (user_id, trip_id)),
    s AS (SELECT *, near IS NOT NULL AND {STEPS_OFF.format(d='near - grid')} > 2 AS gap FROM c ANTI JOIN fine USING (user_id, trip_id)),
    m AS (SELECT s.user_id, s.trip_id, s.pos, h.trip_id AS t, h.pos AS at_, {STEPS_OFF.format(d='s.near - h.grid')} AS a, {STEPS_OFF.format(d='s.grid - h.grid')} AS b
        FROM s JOIN h ON s.user_id = h.user_id AND s.gap AND h.n >= 3 AND h.hi >= least(s.near, s.grid) - 701 AND h.lo <= greatest(s.near, s.grid) + 701),
    e AS (SELECT user_id, trip_id, pos, t, min(at_) FILTER (a = 0) AS a0, min(at_) FILTER (b = 0) AS b0, max(at_) FILTER (a <= 1) AS a1, max(at_) FILTER (b <= 1) AS b1, max(at_) FILTER (a <= 2) AS a2, max(at_) FILTER (b <= 2) AS b2 FROM m GROUP BY ALL),
    p AS (SELECT *, CASE WHEN a0 + b0 >= 0 THEN a0 WHEN a1 + b1 >= 0 THEN a1 ELSE a2 END AS x, CASE WHEN a0 + b0 >= 0 THEN b0 WHEN a1 + b1 >= 0 THEN b1 ELSE b2 END AS y,
        row_number() OVER (PARTITION BY user_id, trip_id, pos ORDER BY t) AS k FROM e WHERE a2 + b2 >= 0),
    f AS (SELECT * FROM p WHERE k = 1),
    u AS (SELECT user_id, trip_id, pos, 0 AS at_, grid FROM s ANTI JOIN f USING (user_id, trip_id, pos)
        UNION ALL SELECT f.user_id, f.trip_id, f.pos, h.pos, h.grid FROM f JOIN h ON f.user_id = h.user_id AND f.t = h.trip_id AND h.pos >= f.x AND h.pos < f.y)
    SELECT user_id, trip_id, row_number() OVER (PARTITION BY user_id, trip_id ORDER BY pos, at_) - 1 AS seq, grid FROM u""")
def fill_grid_gaps(s, d):
    """Pings are segmented once and not moved; what is written is the result, which is short, so plans that read it hold no segmentation."""
    cells = trips.trip_to_grids(routes.mark_high_res(segmented(s, d, dealt=True)))
    return materialise(trips.fill_trip_gaps(cells.select("user_id", "trip_id", "ts", "ping_id", "grid", F.col("high_res").alias("high"))), "filled")
