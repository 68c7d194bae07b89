"""Frequency tables, histograms, quartiles and group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # total: one row


def bin_of(x: Column, low: float, high: float, n: int) -> Column:
    """Left-closed even bins, the last closed; null outside."""
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / ((high - low) / n)), F.lit(n - 1))).cast("int")


def histogram(df: DataFrame, col: str, low: float, high: float, n: int) -> DataFrame:
    """(bin, n, share) of all ``n`` bins, empty ones too; shares of the rows in range."""
    spark = df.sparkSession
    counts = df.select(bin_of(F.col(col), low, high, n).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(n).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # n rows


def histogram2d(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.select(x.alias("x_bin"), y.alias("y_bin")).where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def presence_grid(pings: DataFrame, box: tuple[float, float, float, float], n: int = 512) -> DataFrame:
    west, east, south, north = box
    out = histogram2d(pings, bin_of(F.col("lon"), west, east, n), bin_of(F.col("lat"), south, north, n))
    return out.withColumn("log_n", F.log10("n"))


def quartiles(df: DataFrame, col: str) -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(q.alias("q")).select(*(F.col("q")[k].alias(f"q{k + 1}") for k in range(3)))


def with_quartile(df: DataFrame, col: str) -> DataFrame:
    """Adds the quartile group Q1 to Q4 of a column; the cut points are one row."""
    x = F.col(col)
    group = F.when(x < F.col("q1"), "Q1").when(x < F.col("q2"), "Q2").when(x < F.col("q3"), "Q3").otherwise("Q4")
    return df.crossJoin(F.broadcast(quartiles(df, col))).withColumn("quartile", group).drop("q1", "q2", "q3")


def distribution_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, share of the group)."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def mean_by_bin(df: DataFrame, col: str, width: float, bins: int, value: str, cap: bool) -> DataFrame:
    """Mean of ``value`` by bins of ``col``; what lies above goes to the last bin or, without ``cap``, is dropped."""
    k = F.floor(F.col(col) / width)
    out = df.withColumn("bin", F.least(k, F.lit(bins - 1)) if cap else k).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return out.groupBy("bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, group: str, col: str) -> DataFrame:
    at = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8}
    q = F.percentile(col, F.array(*map(F.lit, at.values())))
    return df.groupBy(group).agg(q.alias("q")).select(group, *(F.col("q")[k].alias(n) for k, n in enumerate(at)))


def ridge_summary(df: DataFrame, metric: str, routes: str = "n_routes") -> DataFrame:
    return df.groupBy(F.least(routes, F.lit(4)).alias("route_class")).agg(F.percentile(metric, 0.5).alias("median"), F.count(F.lit(1)).alias("n"))


def ridge_density(df: DataFrame, metric: str, low: float, high: float, n: int, routes: str = "n_routes") -> DataFrame:
    """(route_class, bin, n, density): the histogram of a metric within each class, as a share by unit of the metric."""
    rows = df.select(F.least(routes, F.lit(4)).alias("route_class"), bin_of(F.col(metric), low, high, n).alias("bin")).where("bin is not null")
    counts = rows.groupBy("route_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("route_class")) / ((high - low) / n))


def lognormal_fit(df: DataFrame, col: str) -> DataFrame:
    x = F.log(F.col(col))
    return df.where(F.col(col) > 0).agg(F.exp(F.avg(x)).alias("scale"), F.stddev_pop(x).alias("shape"), F.count(F.lit(1)).alias("n"))


def classification_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"), F.avg((F.col(truth) == 1).cast("int")).alias("positive_share"))


def _mark(seed: int | str, *key: Column) -> Column:
    """The MD5 of a seed and key columns as text, which other engines give too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def uniform(seed: int, *key: Column) -> Column:
    """A draw from [0, 1) with 52 bits that hangs on the seed and the key alone, on no partition or order."""
    return F.conv(F.substring(_mark(seed, *key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_sample(df: DataFrame, weight: str, n: int = 50_000, seed: int = 7, cells: int = 1024, key: list[str] | None = None, digits: int = 3) -> DataFrame:
    """``n`` rows drawn with replacement by weight: draw k is ``uniform(seed, k)`` of the running weight in the order of the keys' hashes.

    Draws meet the intervals of the running weight by cell. It is taken within ranges of hashes, by their
    first hexadecimal ``digits``, and shifted by the ranges' sums, so no window has one partition.
    ``key`` columns name a row; all do by default.
    """
    key = key or df.columns
    marked = df.withColumn("_mark", _mark(seed, *map(F.col, key)))
    part = marked.withColumn("_part", F.substring("_mark", 1, digits))
    sums = part.groupBy("_part").agg(F.sum(weight).alias("_w"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_w").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_part", "_base")
    total = sums.agg(F.sum("_w").alias("_total"))
    high = F.col("_base") + F.sum(weight).over(Window.partitionBy("_part").orderBy("_mark", *key).rowsBetween(Window.unboundedPreceding, 0))
    ranges = part.where(F.col(weight) > 0).join(base, "_part").withColumn("_high", high).withColumn("_low", F.col("_high") - F.col(weight)).crossJoin(F.broadcast(total))
    cell = lambda x: F.least(F.floor(x / F.col("_total") * cells), F.lit(cells - 1))
    spread = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(total)).select((uniform(seed, F.col("id")) * F.col("_total")).alias("_u"), "_total").select("_u", cell(F.col("_u")).alias("_cell"))
    return spread.drop("_total").join(draws, "_cell").where("_u >= _low and _u < _high").select(*df.columns)


def sample_rows(df: DataFrame, fraction: float = 7 / 30, seed: int = 7, key: list[str] | None = None) -> DataFrame:
    """The rows whose draw by their ``key`` columns (all by default) is below ``fraction``: the same ones in every run and engine."""
    return df.where(uniform(seed, *map(F.col, key or df.columns)) < fraction)


def perturb_income(df: DataFrame, mean: str, seed: int = 7, key: list[str] | None = None) -> DataFrame:
    """A draw from N(m, m / 4), clipped to m -+ m / 4 and cut to whole numbers; the same for a row's ``key`` columns in every run and engine."""
    named = [F.col(c) for c in key or df.columns]
    u, v = uniform(seed, *named) + F.lit(2.0**-53), uniform(seed + 1, *named)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    m = F.col(mean)
    return df.withColumn("income_draw", F.greatest(F.least(m + z * m / 4, m * 1.25), m * 0.75).cast("int"))
