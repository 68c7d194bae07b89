"""Hard negatives by anchor clusters with shared candidate lists.

Anchors are clustered by direction. For a cluster, candidates are sorted once by an upper bound of their
score with any member: their length times the cosine of their angle to the centroid less the cluster's
widest angle. Every member walks that list, and stops where its own length times the bound cannot reach
what it has, which certifies its result. Candidates come in blocks and anchors in parts, both of bounded
size, so each task holds one block and one part; results of the blocks are merged by rank. Two walks are
made: for the positives, and then for the negatives between their scores' bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise

#: Anchors of a sample, and clusters that are fitted to it. They steer how far lists are walked, not what is found.
SAMPLE, CLUSTERS, ROUNDS = 4096, 64, 8
#: Anchors of a part; candidates of a block, of which there are BLOCKS at least.
PART, BLOCK, BLOCKS = 2048, 32_768, 32
#: Scores that a walk works out at once.
SCORES = 1 << 20
#: Whole numbers up to here are exact in double precision.
EXACT = 2.0**53
POSITIVES, NEGATIVES = 5, 3


def vectors(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part: labels moved where vec_id is divisible by 7, components floor(256 x).

    Rows with a null vec_id, label or vector, or a component that is null or not finite, go. Components beyond a long are cut to its ends.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(whole)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256)).cast("array<bigint>").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows as whole numbers, led to equal length with zeros."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a vector of zeros keeps zeros."""
    v = v.astype(np.float64)
    length = np.sqrt((v * v).sum(axis=1))
    return v / np.maximum(length, 1e-300)[:, None], length


def fit_clusters(sample: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """Unit centroids of the sample's directions: some rounds of spherical k-means from evenly spread rows."""
    unit, _ = _directions(sample)
    centre = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)] if len(unit) else np.zeros((1, sample.shape[1]))
    for _ in range(ROUNDS):
        nearest = (unit @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, unit)
        moved, length = _directions(sums)
        centre = np.where(length[:, None] > 0, moved, centre)
    return centre


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each slot by falling score, then vec_id, then row."""
    order = np.lexsort((uid[at], vec_id[at], -score, slot))
    begin = np.flatnonzero(np.append(True, np.diff(slot[order]) > 0)[: len(order)])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def walk(members: dict[str, np.ndarray], items: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(slot, item, score) of the first ``k`` items of each of a cluster's members and windows, and the scores worked out.

    Slot: member * windows + window. An item counts for a window if its score is from ``low`` to ``high``
    (members x windows) and its label is the member's (``same``) or another; a member's own row does not count.
    """
    windows = low.shape[1]
    v, u = items["v"], members["v"]
    (unit, length), (u_unit, u_length) = _directions(v), _directions(u)
    centre, size = _directions(u_unit.sum(axis=0, keepdims=True))
    centre = centre if size[0] > 0 else u_unit[:1]
    angle = lambda x: np.arccos(np.clip(x @ centre[0], -1, 1))
    widest = float(angle(u_unit[u_length > 0]).max(initial=0)) + 1e-7
    bound = length * (np.cos(np.maximum(0, angle(unit) - widest)) + 1e-9) + 1e-9  # more than rounding takes
    order = np.argsort(-bound, kind="stable")
    bound = np.append(bound[order], -1e200)
    exact = float(length.max(initial=0)) * float(u_length.max(initial=0)) < EXACT
    kth = np.full(len(u) * windows, -np.inf)
    slots, places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else np.int64)
    active, at, step, done = np.arange(len(u)), 0, 256, 0
    while at < len(order) and len(active):
        take = order[at : at + max(1, min(step, SCORES // len(active)))]
        found = _scores(u[active], v[take], exact)
        done += found.size
        fits = (members["label"][active][:, None] == items["label"][take]) == same
        fits &= members["uid"][active][:, None] != items["uid"][take]
        more = []
        for w in range(windows):
            slot = active * windows + w
            row, col = np.nonzero(fits & (found >= low[active, w][:, None]) & (found <= high[active, w][:, None]) & (found >= kth[slot][:, None]))
            more.append((slot[row], take[col], found[row, col]))
        slots, places, scores = (np.concatenate([old, *new]) for old, new in zip((slots, places, scores), zip(*more, strict=True), strict=True))
        kept = _best(slots, scores, items["vec_id"], items["uid"], places, k)
        slots, places, scores = slots[kept], places[kept], scores[kept]
        full = np.bincount(slots, minlength=len(kth)) == k
        last = np.flatnonzero(np.append(np.diff(slots) > 0, True)[: len(slots)])
        kth[slots[last]] = np.where(full[slots[last]], scores[last], -np.inf)
        at += len(take)
        step *= 2
        reach = bound[at] * u_length + 1
        need = np.maximum(kth.reshape(len(u), windows), low)
        active = np.flatnonzero((reach[:, None] >= need).any(axis=1))
    return slots, places, scores, done


def _side(table: pa.Table, width: int = 0) -> dict[str, np.ndarray]:
    out = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("v", "low", "high")}
    return out | {"v": _matrix(table.column("v"), width)}


def _walked(items: DataFrame, anchors: DataFrame, blocks: int, parts: int, same: bool, k: int, width: int) -> DataFrame:
    """(uid, slot, item_uid, vec_id, score): each block's first ``k`` for every anchor and window; anchors have low and high."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            own, all_ = _side(left, width), _side(right, width)
            dim = max(own["v"].shape[1], all_["v"].shape[1])
            own["v"], all_["v"] = _padded(own["v"], dim), _padded(all_["v"], dim)
            low, high = (_matrix(right.column(c)) for c in ("low", "high"))
            windows = right.column("windows").to_numpy()
            low[np.arange(low.shape[1]) >= windows[:, None]] = (1 << 63) - 1  # windows that a member does not have
            for cluster in np.unique(all_["cluster"]):
                rows = np.flatnonzero(all_["cluster"] == cluster)
                slot, place, score, _ = walk({c: x[rows] for c, x in all_.items()}, own, low[rows], high[rows], same, k)
                member, window = np.divmod(slot, low.shape[1])
                out.append((all_["uid"][rows][member], window, own["uid"][place], own["vec_id"][place], score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["uid", "slot", "item_uid", "vec_id", "score"])

    dealt = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["part", "block"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "uid long, slot long, item_uid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "vec_id", "item_uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _clustered(anchors: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """Anchors with cluster and part, the number of parts, and the sample's dimension. Neighbours of a cluster share a part; a large cluster has several."""
    spark = anchors.sparkSession
    sample = _matrix(anchors.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toArrow().column("v"))
    centres = spark.sparkContext.broadcast(fit_clusters(sample))

    def name(batches):
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column(3)]), centres.value.shape[1])
            nearest = (_directions(v[:, : centres.value.shape[1]])[0] @ centres.value.T).argmax(axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int64))], names=[*batch.schema.names, "cluster"])

    named = materialise(anchors.select("uid", "vec_id", "label", "v").mapInArrow(name, "uid long, vec_id long, label long, v array<bigint>, cluster long"), "anchors")
    sizes = sorted((r["cluster"], r["n"]) for r in named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect())  # CLUSTERS rows at most
    before = np.append(0, np.cumsum([c for _, c in sizes]))
    plan = spark.createDataFrame([(k, int(b), c) for (k, c), b in zip(sizes, before, strict=False)], "cluster long, before long, n long")
    parts = max(1, -(-n // PART))
    part = F.least(((F.col("before") + F.pmod(F.xxhash64("uid"), F.col("n"))) / PART).cast("int"), F.lit(parts - 1))
    return named.join(F.broadcast(plan), "cluster").withColumn("part", part).drop("before", "n"), parts, sample.shape[1]


def _rest(score: Column) -> Column:
    return F.pmod(score, F.lit(20))


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. Their positives are the first ``positives``
    other rows of their label; for each, the first ``negatives`` rows of other labels with
    50 positive_score <= 100 negative_score <= 95 positive_score. Higher scores come first, then smaller
    vec_ids. ``vectors`` says which rows take part. Each row takes part by itself, repeated ones too, so a
    repeated anchor gives its rows again, and its copies are positives. Shorter vectors are led to the length of longer ones with zeros;
    scores beyond a long are cut to its ends; other columns are not read; an empty table gives no rows.
    """
    rows = materialise(vectors(embeddings), "vectors")
    n = rows.count()
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = anchors.count()
    blocks = max(BLOCKS, -(-n // BLOCK))
    clustered, parts, width = _clustered(anchors, asked)
    edge = lambda x: F.array(F.lit(x).cast("long"))
    whole = clustered.withColumns({"low": edge(-(1 << 63)), "high": edge((1 << 63) - 1), "windows": F.lit(1).cast("long")})
    near = materialise(_walked(rows, whole, blocks, parts, True, positives, width), "positives")
    scores = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # whole numbers from score / 2 to 19 score / 20, without leaving the range of a long
    low = F.transform("p", lambda p: p["score"] - F.shiftright(p["score"], 1))
    high = F.transform("p", lambda p: p["score"] - ((p["score"] - _rest(p["score"])) / 20).cast("long") - (_rest(p["score"]) > 0).cast("long"))
    ranged = clustered.join(scores, "uid").withColumns({"low": low, "high": high, "windows": F.size("p").cast("long")}).drop("p")
    hard = _walked(rows, ranged, blocks, parts, False, negatives, width)
    found = near.select("uid", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(found, ["uid", "slot"]).join(clustered.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
