"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise


def connected_components(edges: DataFrame, keys: list[str] | None = None, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(keys, node, label) of every node that has an edge; a label is the least node of its component.

    ``keys`` keep components apart: edges join only within equal keys. Each round takes the least label
    among neighbours and then the label of the label, so chains shorten by doubling. Each round is
    written to the shared folder.
    """
    keys = keys or []
    both = edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("other"))
    both = materialise(both.union(both.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct(), "edges")
    single = edges.select(*keys, F.col(src).alias("node")).where(F.col(src) == F.col(dst)).distinct()
    labels = materialise(
        both.select(*keys, "node", F.least("node", "other").alias("label")).union(single.select(*keys, "node", F.col("node").alias("label")))
        .groupBy(*keys, "node").agg(F.min("label").alias("label")), "labels"
    )
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("label").alias("near"))
        least = labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialise(
            least.join(up, [*keys, "label"], "left").select(*keys, "node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels"
        )
        labels = after.select(*keys, "node", "label")
        if after.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
