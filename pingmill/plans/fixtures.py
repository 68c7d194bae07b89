"""Tables that the registered queries derive from the given ones, by arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.operators.trips import TASK_ROWS
from pingmill.sources.tables import with_boxes

#: Expressions by dialect: integer division, seconds of a timestamp, rows 0 to 15.
SPARK = {"div": "div", "epoch": "unix_timestamp(CAST({} AS TIMESTAMP))"}
DUCK = {"div": "//", "epoch": "CAST(floor(epoch(CAST({} AS TIMESTAMP))) AS BIGINT)"}


def _orders(d: dict[str, str]) -> str:
    return f"""SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS u, o_orderdate AS day,
        {d['epoch'].format('o_orderdate')} + ((o_orderkey * 7) % 24) * 3600 AS t0, CAST((o_orderkey * 7) % 24 AS INT) AS dep_hour,
        CASE WHEN o_orderkey % 10 = 9 THEN 600 ELSE 45 + (o_orderkey % 13) * 3 + CASE WHEN (o_orderkey * 7) % 24 IN (7, 8, 9, 16, 17, 18) THEN 25 ELSE 0 END END AS dt,
        -979e-1 + (o_custkey % 17) * 1e-1 AS hx, 3205e-2 + (o_custkey % 12) * 1e-1 AS hy, (o_orderkey {d['div']} 2) % 3 AS r FROM orders"""


def _points(d: dict[str, str], rows: str) -> str:
    f = "(CASE WHEN k % 2 = 0 THEN i ELSE 15 - i END) / 15e0"
    bump = f"((r - 1) * 2e-2 * 4e0 * ({f}) * (1e0 - ({f})))"
    return f"""SELECT u AS user_id, k * 100 + i AS ping_id, CAST(t0 + i * dt AS BIGINT) AS ts,
        round(hx + (hx + 7e-2 - hx) * ({f}) + {bump} + (((k * 31 + i * 17) % 11) - 5) * 5e-5, 6) AS lon,
        round(hy + (hy + 5e-2 - hy) * ({f}) - {bump} + (((k * 13 + i * 29) % 11) - 5) * 5e-5, 6) AS lat
        FROM {rows} WHERE NOT (k % 4 = 3 AND i % 3 <> 0)"""


def _routes(d: dict[str, str], weekday: str) -> str:
    return f"""SELECT u AS user_id, k AS trip_id, dep_hour, t0 AS dep_ts, 15 * dt / 60e0 AS tt, CAST({weekday} AS INT) AS weekday,
        CAST(CASE WHEN k % 11 = 0 THEN -1 ELSE r END AS INT) AS route_id FROM o"""


#: How much larger rows are than their files: compressed ones count by this, and sixteen pings are made of an order.
#: Without it Spark takes millions of rows for small and broadcasts them through the driver.
SIZE_FACTOR = "20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.sources.fileCompressionFactor", SIZE_FACTOR)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # a row may hold all trips of a user
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_df(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    return spark.sql(_orders(SPARK).replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders") if orders is None else orders)


#: Pings that are made of an order.
PINGS = 16


def pings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: orders are dealt out by user before pings are made of them, so what follows by user moves no pings.

    Tasks have some ``TASK_ROWS`` pings however many there are: the tasks that write for them hold orders only.
    """
    orders = None
    if dealt:
        raw = table(spark, sf_dir, "orders")
        orders = raw.select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderdate")
        orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-raw.count() * PINGS // TASK_ROWS)), "o_custkey")
    rows = _orders_df(spark, sf_dir, orders).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PINGS - 1))))
    return spark.sql(_points(SPARK, "{rows}"), rows=rows)


def trip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_routes(SPARK, "weekday(day)").replace("FROM o", "FROM {o}"), o=_orders_df(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("user_id"), (F.abs(F.col("c_acctbal").cast("double")) / 100).alias("income"), (F.col("c_custkey") % 3 != 0).alias("commuter"), F.col("c_nationkey").cast("long").alias("tract"))


def zones(spark: SparkSession) -> DataFrame:
    """Rectangles; each fifth is two triangles."""
    return _triangled(spark.range(19 * 13).select((F.col("id") % 19).alias("ix"), F.floor(F.col("id") / 19).alias("iy")))


def _corner(x: float, y: float):
    west, south = F.lit(-97.95) + F.col("ix") * 0.1, F.lit(32.02) + F.col("iy") * 0.1
    return F.struct((west + 0.1 * x).alias("lon"), (south + 0.1 * y).alias("lat"))


def _triangled(base: DataFrame) -> DataFrame:
    sw, se, ne, nw = _corner(0, 0), _corner(1, 0), _corner(1, 1), _corner(0, 1)
    split = (F.col("ix") + F.col("iy")) % 5 == 0
    rings = F.when(split, F.array(F.array(sw, se, ne), F.array(sw, ne, nw))).otherwise(F.array(F.array(sw, se, ne, nw)))
    out = base.select("ix", "iy", split.alias("split"), F.posexplode(rings).alias("part", "ring"))
    zone = (F.col("ix") * 100 + F.col("iy")) + F.when(F.col("split") & (F.col("part") == 1), 5000).otherwise(0)
    return with_boxes(out.select(zone.cast("long").alias("zone_id"), F.lit(0).alias("ring_id"), "ring"))


def ping_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (ix, iy) of the zones' size that hold a ping."""
    cells = pings(spark, sf_dir).select(F.floor((F.col("lon") + 97.95) / 0.1).alias("ix"), F.floor((F.col("lat") - 32.02) / 0.1).alias("iy")).distinct()
    return materialise(cells, "ping_cells")  # few rows that queries use several times


def table_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones in whose cells there are pings."""
    return _triangled(ping_cells(spark, sf_dir))


#: Sides of a hole and of the island in it, as shares of the cell.
HOLE, ISLAND = (0.3, 0.7), (0.45, 0.55)


def holed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around pings; every other has a hole, and every fourth an island in it that is a second polygon of the zone."""
    square = lambda a, b: F.array(_corner(a, a), _corner(b, a), _corner(b, b), _corner(a, b))
    kind = F.col("ix") + F.col("iy")
    first = F.when(kind % 2 == 0, F.array(square(0, 1), square(*HOLE))).otherwise(F.array(square(0, 1)))
    polygons = F.when(kind % 4 == 0, F.array(first, F.array(square(*ISLAND)))).otherwise(F.array(first))
    rows = ping_cells(spark, sf_dir).select((F.col("ix") * 100 + F.col("iy")).cast("long").alias("zone_id"), F.posexplode(polygons).alias("ring_id", "rings"))
    return with_boxes(rows)


def od_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Estimated flows, survey flows, population by zone."""
    li, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("c_nationkey").cast("long").alias("o_zone"), F.col("s_nationkey").cast("long").alias("d_zone"), F.col("l_quantity").cast("double").alias("q"))
    lbs = rows.where((F.col("o_zone") + F.col("d_zone")) % 7 != 0).groupBy("o_zone", "d_zone").agg(F.count(F.lit(1)).cast("double").alias("flow"))
    survey = rows.where((F.col("o_zone") * F.col("d_zone")) % 5 != 0).groupBy("o_zone", "d_zone").agg(F.sum("q").alias("flow"))
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 9 <> 4")
    population = nation.select(F.col("n_nationkey").cast("long").alias("zone_id"), (100000 + F.col("n_nationkey") * 5000).cast("double").alias("population"))
    return lbs, survey, population


# --- the same tables in DuckDB -------------------------------------------------------------------


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6372.8e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


D_ORDERS = f"o AS ({_orders(DUCK)})"
D_PINGS = f"{D_ORDERS}, pings AS ({_points(DUCK, '(SELECT * FROM o CROSS JOIN range(16) AS t(i))')})"
D_ROUTES = f"{D_ORDERS}, tr AS ({_routes(DUCK, 'isodow(day) - 1')})"
D_PROFILE = "profile AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, abs(CAST(c_acctbal AS DOUBLE)) / 100 AS income, c_custkey % 3 <> 0 AS commuter, CAST(c_nationkey AS BIGINT) AS tract FROM customer)"
D_TRIPS = f"""{D_PINGS}, legs AS (SELECT *, ts - lag(ts) OVER w AS leg_s, {haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg_km
    FROM pings WINDOW w AS (PARTITION BY user_id ORDER BY ts, ping_id)),
  runs AS (SELECT *, sum(CASE WHEN leg_s > 1080 OR leg_km > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, ping_id) AS run FROM legs),
  sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM runs),
  trips AS (SELECT user_id, ping_id, ts, lon, lat, dense_rank() OVER (PARTITION BY user_id ORDER BY run) AS trip_id FROM sized WHERE n > 5)"""
D_ENDS = f"""{D_TRIPS}, ends AS (SELECT user_id, trip_id, min(ts) AS dep_ts, max(ts) AS arr_ts, count(*) AS n_points, arg_min(lon, (ts, ping_id)) AS s_lon, arg_min(lat, (ts, ping_id)) AS s_lat,
    arg_max(lon, (ts, ping_id)) AS t_lon, arg_max(lat, (ts, ping_id)) AS t_lat FROM trips GROUP BY ALL)"""
D_OD = """raw AS (SELECT CAST(c_nationkey AS BIGINT) AS o_zone, CAST(s_nationkey AS BIGINT) AS d_zone, CAST(l_quantity AS DOUBLE) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
  lbs AS (SELECT o_zone, d_zone, CAST(count(*) AS DOUBLE) AS flow FROM raw WHERE (o_zone + d_zone) % 7 <> 0 GROUP BY ALL),
  survey AS (SELECT o_zone, d_zone, sum(q) AS flow FROM raw WHERE (o_zone * d_zone) % 5 <> 0 GROUP BY ALL),
  population AS (SELECT CAST(n_nationkey AS BIGINT) AS zone_id, CAST(100000 + n_nationkey * 5000 AS DOUBLE) AS population FROM nation WHERE n_nationkey % 9 <> 4)"""
