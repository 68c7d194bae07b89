"""Periods of the day, income classes and class bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last hours of AM, MD and PM by scheme; other hours are RD. A scheme "od" has the comments' hours.
PERIODS = {
    "weekday": ((7, 9), (10, 15), (16, 18)),
    "gap": ((7, 9), (10, 15), (16, 18)),
    "weekend": ((7, 9), (12, 13), (16, 18)),
    "region": ((7, 10), (11, 15), (16, 19)),
    "od": ((7, 10), (11, 15), (16, 19)),
}


def local_time(ts: Column, zone: str = "US/Central") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(ts), zone)


def hour_of_week(local: Column) -> Column:
    return F.weekday(local) * 24 + F.hour(local)


def period_of_day(hour: Column, scheme: str = "weekday") -> Column:
    out = None
    for name, (a, b) in zip(("AM", "MD", "PM"), PERIODS[scheme], strict=True):
        out = F.when(hour.between(a, b), name) if out is None else out.when(hour.between(a, b), name)
    return out.otherwise("RD")


def income_level(income: Column) -> Column:
    return F.when(income < 26, "Low").when(income < 78, "Middle").otherwise("High")


def income_bucket(income: Column) -> Column:
    return F.least(F.floor(income / 25), F.lit(2)).cast("int")


def class_bin(value: Column, low: float, high: float, n: int) -> Column:
    """Class k for value in (b_k, b_k+1] of n + 1 even breaks; n - 1 above the last; -1 at or under the first."""
    width = (high - low) / n
    return F.when(value > high, n - 1).when(value <= low, -1).otherwise(F.least(F.lit(n - 1), F.ceil((value - low) / width) - 1)).cast("int")


def log_flow(flow: Column) -> Column:
    return F.when(flow > 1, F.log10(flow)).otherwise(F.lit(0.0))


def flow_share_class(share: Column) -> Column:
    out = F.when(share < 0.0005, 0)
    for k, most in enumerate((0.001, 0.0025, 0.005, 0.01), 1):
        out = out.when(share < most, k)
    return out.otherwise(5)


def lognormal_pdf(x: Column, mean_log: float, spread: float) -> Column:
    return F.exp(-F.pow(F.log(x) - mean_log, 2) / (2 * spread**2)) / (x * spread * F.sqrt(F.lit(2 * 3.141592653589793)))


def weibull_pdf(x: Column, scale: float, shape: float) -> Column:
    return F.lit(shape / scale) * F.pow(x / scale, shape - 1) * F.exp(-F.pow(x / scale, shape))
