"""Routing behaviour: travel times, reliability, route choice.

trip_routes: user_id, trip_id, dep_hour, weekday (Monday 0), tt (minutes), route_id (-1: none of the main routes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.classes import income_bucket, income_level, period_of_day

def _user():
    return Window.partitionBy("user_id")


def matched_only(routes: DataFrame) -> DataFrame:
    return routes.where("route_id <> -1")


def weekday_only(routes: DataFrame) -> DataFrame:
    return routes.where("weekday < 5")


def unmatched_share(routes: DataFrame) -> DataFrame:
    return routes.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("route_id") == -1, 1).otherwise(0)).alias("unmatched"))


def relative_excess(routes: DataFrame) -> DataFrame:
    return routes.withColumn("excess", F.col("tt") / F.min("tt").over(_user()) - 1)


def user_dispersion(routes: DataFrame) -> DataFrame:
    """Per user: deviation of the relative excess, trips, distinct routes."""
    return relative_excess(routes).groupBy("user_id").agg(
        F.stddev_pop("excess").alias("dispersion"), F.count(F.lit(1)).alias("n_trips"), F.countDistinct("route_id").alias("n_routes")
    )


def dispersion_by_routes(users: DataFrame, least: int = 40) -> DataFrame:
    """Quartiles of dispersion by routes (1 to 6), all users and by commuter; commuter is null for all."""
    q = F.percentile("dispersion", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = users.where((F.col("n_trips") >= least) & F.col("n_routes").between(1, 6))
    return rows.groupingSets([["n_routes"], ["n_routes", "commuter"]], "n_routes", "commuter").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select(
        "n_routes", "commuter", "n", *(F.col("q")[k].alias(c) for k, c in enumerate(("p25", "p50", "p75")))
    )


def dispersion_by_trips(users: DataFrame, least: int = 40, most: int = 99, width: int = 5) -> DataFrame:
    q = F.percentile("dispersion", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = users.where(F.col("n_trips").between(least, most)).withColumn("trip_bin", (F.floor(F.col("n_trips") / width) - least // width).cast("int"))
    return rows.groupingSets([["trip_bin"], ["trip_bin", "commuter"]], "trip_bin", "commuter").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select(
        "trip_bin", "commuter", "n", *(F.col("q")[k].alias(c) for k, c in enumerate(("p25", "p50", "p75")))
    )


def dispersion_trip_class(users: DataFrame) -> DataFrame:
    """Classes 40-59, 60-79 and above 80; 80 itself is in none."""
    n = F.col("n_trips")
    label = F.when(n.between(40, 59), "40-59").when(n.between(60, 79), "60-79").when(n > 80, ">80")
    return users.withColumn("trip_class", label).where("trip_class is not null").groupBy("trip_class").agg(F.avg("dispersion").alias("mean"), F.count(F.lit(1)).alias("n"))


def routes_by_period(routes: DataFrame, scheme: str = "weekday") -> DataFrame:
    """(period, hour, user): routes and trips of each user and hour, with the hour's period."""
    per = matched_only(routes).groupBy("user_id", "dep_hour").agg(F.countDistinct("route_id").alias("n_routes"), F.count(F.lit(1)).alias("n_trips"))
    return per.withColumn("period", period_of_day(F.col("dep_hour"), scheme))


def route_dist_by_period(routes: DataFrame, scheme: str = "weekday") -> DataFrame:
    counts = routes_by_period(routes, scheme).where("n_routes between 1 and 5").groupBy("period", "n_routes").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def travel_time_index(routes: DataFrame, least: int = 10) -> DataFrame:
    """Mean over free-flow time by user and hour; free flow: the user's least over all weekday matched trips."""
    free = weekday_only(matched_only(routes)).withColumn("free_flow", F.min("tt").over(_user()))
    return free.groupBy("user_id", "dep_hour").agg((F.avg("tt") / F.min("free_flow")).alias("tti"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def relative_gap(routes: DataFrame, least: int = 10, clip: bool = True) -> DataFrame:
    """Weekday matched trips with ``gap``, their time over the user's least as a share of it, not below 0 with ``clip``.

    Users' hours with fewer than ``least`` trips are left out. ``routes`` may bring a ``free_flow`` of its own, which times may be below.
    """
    free = weekday_only(matched_only(routes))
    free = free if "free_flow" in free.columns else free.withColumn("free_flow", F.min("tt").over(_user()))
    free = free.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "dep_hour")))
    gap = (F.col("tt") - F.col("free_flow")) / F.col("free_flow")
    return free.where(F.col("_n") >= least).withColumn("gap", F.greatest(gap, F.lit(0.0)) if clip else gap).drop("_n")


def reliability(routes: DataFrame, least: int = 20) -> DataFrame:
    """By user and peak period: buffer index, planning-time index, distinct routes up to 5."""
    peak = weekday_only(matched_only(routes)).withColumn("period", period_of_day(F.col("dep_hour"))).where("period in ('AM', 'PM')")
    out = peak.groupBy("user_id", "period").agg(
        F.percentile("tt", 0.85).alias("p85"), F.avg("tt").alias("mean"), F.min("tt").alias("least"), F.count(F.lit(1)).alias("n"), F.countDistinct("route_id").alias("routes")
    )
    return out.where(F.col("n") >= least).select(
        "user_id", "period", "n", F.least("routes", F.lit(5)).alias("n_routes"), ((F.col("p85") - F.col("mean")) / F.col("mean")).alias("buffer_index"), (F.col("p85") / F.col("least")).alias("planning_index")
    )


def reliability_by_routes(rel: DataFrame) -> DataFrame:
    return rel.groupBy("period", "n_routes").agg(
        F.avg("planning_index").alias("mean"), F.percentile("planning_index", 0.25).alias("p25"), F.percentile("planning_index", 0.9).alias("p90"), F.count(F.lit(1)).alias("n")
    )


def reliability_by_income(rel: DataFrame, profile: DataFrame) -> DataFrame:
    rows = rel.join(profile.select("user_id", income_level(F.col("income")).alias("income_class")), "user_id")
    return rows.groupBy("income_class", "period").agg(F.avg("planning_index").alias("mean"), F.avg(F.when(F.col("planning_index") > 1, 1).otherwise(0)).alias("above_one"), F.count(F.lit(1)).alias("n"))


def dominant_route(routes: DataFrame, more_than: int = 4) -> DataFrame:
    """Users with more trips and at least two routes: the commonest route, the least id of equal ones, and its share."""
    per = matched_only(routes).groupBy("user_id", "route_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = per.select("*", F.sum("n").over(_user()).alias("n_trips"), F.count(F.lit(1)).over(_user()).alias("n_routes"), F.row_number().over(_user().orderBy(F.desc("n"), "route_id")).alias("_rank"))
    return ranked.where((F.col("_rank") == 1) & (F.col("n_trips") > more_than) & (F.col("n_routes") >= 2)).select("user_id", "route_id", "n_trips", "n_routes", (F.col("n") / F.col("n_trips")).alias("share"))


def alternative_share_by_hour(routes: DataFrame, more_than: int = 4) -> DataFrame:
    top = dominant_route(routes, more_than).select("user_id", F.col("route_id").alias("top"))
    own = F.sum(F.when(F.col("route_id") == F.col("top"), 1).otherwise(0))
    return matched_only(routes).join(top, "user_id").groupBy("dep_hour").agg(own.alias("dominant"), F.count(F.lit(1)).alias("n")).withColumn("alternative_share", 1 - F.col("dominant") / F.col("n"))


def top_route_sets(routes: DataFrame, n: int = 8) -> DataFrame:
    sets = matched_only(routes).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("route_id")), "-").alias("route_set"))
    counts = sets.groupBy("route_set").agg(F.count(F.lit(1)).alias("n"))
    total = sets.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("route_set", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "route_set").limit(n)


def route_count_shares(routes: DataFrame) -> DataFrame:
    per = matched_only(routes).groupBy("user_id").agg(F.countDistinct("route_id").alias("r"))
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    return per.agg(share(F.col("r") == 1).alias("one"), share(F.col("r") == 2).alias("two"), share(F.col("r") == 3).alias("three"), share(F.col("r") > 3).alias("more"))


def hourly_trips(routes: DataFrame) -> DataFrame:
    return routes.groupBy("dep_hour").agg(F.count(F.lit(1)).alias("n"))


def region_period_matrix(trips: DataFrame) -> DataFrame:
    """Shares of region pairs in each period's trips; trips: region_a, region_b, dep_hour."""
    counts = trips.withColumn("period", period_of_day(F.col("dep_hour"), "region")).groupBy("period", "region_a", "region_b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def routes_income_crosstab(users: DataFrame) -> DataFrame:
    """Rows: routes up to 4; columns: users of each income bucket and its share of the row."""
    rows = users.withColumn("route_class", F.least("n_routes", F.lit(4))).withColumn("bucket", income_bucket(F.col("income")))
    wide = rows.groupBy("route_class").pivot("bucket", [0, 1, 2]).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(str(k)) for k in range(3)), F.lit(0))
    return wide.select("route_class", *(F.col(str(k)).alias(f"n{k}") for k in range(3)), *((F.col(str(k)) / total).alias(f"share{k}") for k in range(3)))


def tract_representativeness(users: DataFrame, tracts: DataFrame) -> DataFrame:
    counts = users.groupBy("tract").agg(F.count(F.lit(1)).alias("n_users"))
    return counts.join(tracts, "tract", "left")


def place_coverage(places: DataFrame) -> DataFrame:
    return places.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home_lon").isNotNull()).alias("with_home"), F.count_if(F.col("home_lon").isNotNull() & F.col("work_lon").isNotNull()).alias("with_both"))


def kept_share(selected: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips in all and trips kept; selected: user_id, n_trips (kept)."""
    total = trips.agg(F.count(F.lit(1)).alias("n_trips"))
    kept = selected.agg(F.coalesce(F.sum("n_trips"), F.lit(0)).alias("n_kept"))
    return total.crossJoin(kept).withColumn("share", F.col("n_kept") / F.col("n_trips"))  # one row each


def main_route_coverage(points: DataFrame, high: DataFrame) -> DataFrame:
    """Shares of the users of ``points`` with one high-resolution trip at least, and with more than one."""
    counts = high.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = points.select("user_id").distinct().join(counts, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    return users.agg(F.count(F.lit(1)).alias("n_users"), share(F.col("n") >= 1).alias("with_one"), share(F.col("n") > 1).alias("with_more"))


def commuters(places: DataFrame) -> DataFrame:
    """Users with a flag that tells whether they have a work place."""
    return places.select("user_id", F.col("work_lon").isNotNull().alias("commuter"))
