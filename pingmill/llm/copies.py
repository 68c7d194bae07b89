"""Groups of equal keys without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def _salted(rows: DataFrame, row_id: str, salts: int) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))


def groups(rows: DataFrame, keys: list[str], row_id: str, keeper: Column, salts: int = SALTS) -> DataFrame:
    """One row per group: keys, ``keep_id`` (``keeper``, a min or max over ``row_id``), ``group_size`` and the salts it has.

    A group is first aggregated by (keys, salt), so a key held by a third of all rows spreads over
    ``salts`` tasks. Keys may be arrays or binary; they must not be null.
    """
    part = _salted(rows, row_id, salts).groupBy(*keys, "_salt").agg(keeper.alias(row_id), F.count(F.lit(1)).alias("_n"))
    return part.groupBy(*keys).agg(keeper.alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_salts"))


def dealt(rows: DataFrame, whole: DataFrame, keys: list[str], row_id: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the other columns of ``groups``' table, joined by (keys, salt)."""
    others = [c for c in whole.columns if c != "_salts"]
    return _salted(rows, row_id, salts).join(whole.select(*others, F.explode("_salts").alias("_salt")), [*keys, "_salt"]).drop("_salt")
