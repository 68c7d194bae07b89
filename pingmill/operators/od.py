"""Origin-destination matrices: counts, comparison, expansion, totals. od: o_zone, d_zone, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 181


def interzonal(od: DataFrame) -> DataFrame:
    return od.where("o_zone is not null and d_zone is not null and o_zone <> d_zone")


def od_matrix(trips: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return interzonal(trips).groupBy("o_zone", "d_zone", *(keys or [])).agg(F.count(F.lit(1)).cast("double").alias("flow"))


def survey_demand(survey: DataFrame) -> DataFrame:
    """Drive-alone trips and two for each shared ride."""
    return survey.select("o_zone", "d_zone", (F.col("drive_alone") + 2 * F.col("shared_ride")).alias("flow"))


def aggregate_od(od: DataFrame) -> DataFrame:
    return interzonal(od).groupBy("o_zone", "d_zone").agg(F.sum("flow").alias("flow"))


def merge_od(estimate: DataFrame, survey: DataFrame) -> DataFrame:
    a, b = estimate.withColumnRenamed("flow", "estimate"), survey.withColumnRenamed("flow", "survey")
    return a.join(b, ["o_zone", "d_zone"], "full").select("o_zone", "d_zone", F.coalesce("estimate", F.lit(0.0)).alias("estimate"), F.coalesce("survey", F.lit(0.0)).alias("survey"))


def compare_od(merged: DataFrame) -> DataFrame:
    """R2 with the estimate as truth and the survey as prediction, and the regression of the estimate on the survey."""
    y, x = F.col("estimate"), F.col("survey")
    sums = merged.agg(
        F.sum((y - x) ** 2).alias("rss"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"),
    )
    return sums.select("n", (1 - F.col("rss") / (F.col("v") * F.col("n"))).alias("r2"), "slope", "intercept", "corr")


def undirected(od: DataFrame) -> DataFrame:
    return od.groupBy(F.least("o_zone", "d_zone").alias("zone_a"), F.greatest("o_zone", "d_zone").alias("zone_b")).agg(F.sum("flow").alias("flow"))


def top_flows(od: DataFrame, n: int = 5000) -> DataFrame:
    return od.orderBy(F.desc("flow"), "o_zone", "d_zone").limit(n)


def ranked_shares(od: DataFrame, least: float = 0.0001) -> DataFrame:
    total = od.agg(F.sum("flow").alias("total"))
    return undirected(od).crossJoin(F.broadcast(total)).withColumn("share", F.col("flow") / F.col("total")).where(F.col("share") >= least).drop("total")


def zone_flow(od: DataFrame, zone: int, outward: bool = True) -> DataFrame:
    own, other = ("o_zone", "d_zone") if outward else ("d_zone", "o_zone")
    return od.where(F.col(own) == zone).groupBy(F.col(other).alias("zone_id")).agg(F.sum("flow").alias("flow"))


def zone_totals(od: DataFrame, outward: bool = True, scale: float = 1.0) -> DataFrame:
    return od.groupBy(F.col("o_zone" if outward else "d_zone").alias("zone_id")).agg((F.sum("flow") * scale).alias("flow"))


def expansion_factors(homes: DataFrame, population: DataFrame) -> DataFrame:
    """homes: zone_id of each user. population over users by zone; zones without population count 0."""
    users = homes.where("zone_id is not null").groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_users"))
    known = users.join(population, "zone_id", "left").withColumn("population", F.coalesce("population", F.lit(0)))
    return known.withColumn("factor", F.col("population") / F.col("n_users"))


def average_expansion(factors: DataFrame) -> DataFrame:
    return factors.agg((F.sum("population") / F.sum("n_users")).alias("average"))


def expand_od(od: DataFrame, factors: DataFrame, days: int = DAYS) -> DataFrame:
    """Daily flows times the origin's factor, or the average where it has none."""
    one = F.broadcast(average_expansion(factors))
    own = od.join(factors.select(F.col("zone_id").alias("o_zone"), "factor"), "o_zone", "left").crossJoin(one)
    return own.select("o_zone", "d_zone", "flow", (F.col("flow") * F.coalesce("factor", "average") / days).alias("flow_expanded"))


def weekly_profile(trips: DataFrame, hour_of_week: str = "hour_of_week") -> DataFrame:
    """Shares of the 168 hours of the week."""
    spark = trips.sparkSession
    counts = trips.groupBy(F.col(hour_of_week).cast("int").alias("hour_of_week")).agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(168).select(F.col("id").cast("int").alias("hour_of_week")).join(counts, "hour_of_week", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # 168 rows


def large_flows(od: DataFrame, more_than: float = 1000) -> DataFrame:
    return od.where(F.col("flow") > more_than)


def mapped_survey(survey: DataFrame, mapping: DataFrame) -> DataFrame:
    """Survey flows between large zones by the map of small to large ones; flows within one go."""
    from pingmill.operators.spatial import map_od

    large = map_od(survey, mapping).select(F.col("o_large").alias("o_zone"), F.col("d_large").alias("d_zone"), "flow")
    return aggregate_od(large)
