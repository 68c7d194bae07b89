"""Jaccard self-join of word-shingle sets by chosen paths.

Each distinct set gets a signature of min-hashes, whose slots are its tokens. A run splits the sets
recursively: a set goes from a bucket to the sub-bucket of a token with chance 1 / (threshold * slots),
decided by a hash of the path and the token, so sets that share a token choose alike. Splitting starts
two levels down, which every set can work out alone, and goes on only in buckets above ``BUCKET``.
Small buckets are compared by brute force. Runs are repeated as often as the target recall asks.

The classes that this gives may be too wide, never much too narrow. Inside each, all pairs are then
compared exactly, in blocks, without writing the pairs out: a block gives each of its sets its number of
links and one link towards the least set it is linked with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.copies import dealt, groups
from pingmill.llm.words import mix, shingle_sets, slices
from pingmill.operators.components import connected_components

SHINGLE = 5
#: The least Jaccard similarity of a link, as a fraction.
THRESHOLD = (4, 5)
SLOTS = 64
RECALL = 0.99
START, DEEPEST = 2, 5
BUCKET = 100
#: Estimated similarity from which sets of a bucket go to one class: four deviations under the threshold.
LOOSE = 0.6
#: A large bucket is first compared with its centre, the commonest token of each slot over about
#: ``CENTRE`` of its sets. Those that agree with it in ``TIGHT`` of the slots are not split further. The
#: slots in which signatures differ obey the triangle inequality, so a partner that agrees with such a
#: set in ``LOOSE`` of the slots agrees with the centre in ``JOIN``; all that do go to the centre's class.
CENTRE, TIGHT = 50, 0.82
JOIN = TIGHT - (1 - LOOSE)
BLOCK = 200
#: Ids up to this number (8 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64))
_TIMES, _PLUS = _SEEDS[:SLOTS] | np.uint64(1), _SEEDS[SLOTS:]


def runs_for(recall: float = RECALL, depth: int = DEEPEST) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall``, in buckets ``depth`` levels deep.

    Such a pair chooses one shared token a level on average, so it survives a level, given s for the rest, with 1 - exp(-s).
    """
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def signature(items: np.ndarray) -> np.ndarray:
    """The upper halves of the least hashes of a set, one per slot."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 2048):
        np.minimum(least, (items[a : a + 2048] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _set_id(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, set_id (digest of the shingle set, null for no words), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                ids = [_set_id(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(ids, pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "set_id", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, set_id binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SLOTS)


def _split(path: np.ndarray, tokens: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and sub-paths; the chance is of each token of each row."""
    draw = mix(path[:, None] ^ tokens)
    row, slot = np.nonzero(draw < np.uint64(int(chance * 2**64)))
    return row, mix(path[row] + tokens[row, slot] * np.uint64(3))


def _tokens(sig: np.ndarray) -> np.ndarray:
    return mix(sig.astype(np.uint64) | (np.arange(1, SLOTS + 1, dtype=np.uint64) << np.uint64(32)))


def _rows(path: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep)], names=["path", "rep"])


def first_paths(sets: DataFrame, runs: int, chance: float, levels: int = START) -> DataFrame:
    """(path, rep) of every run, ``levels`` deep; sets: rep, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, tokens = batch.column(0).to_numpy(zero_copy_only=False), _tokens(_matrix(batch.column(1)))
            for seed in mix(np.arange(1, runs + 1, dtype=np.uint64)):
                row, path = np.arange(len(rep)), np.full(len(rep), seed, np.uint64)
                for _ in range(levels):
                    sub, path = _split(path, tokens[row], chance)
                    row = row[sub]
                yield _rows(path, rep[row])

    return sets.select("rep", "signature").mapInArrow(run, "path long, rep long")


def next_paths(big: DataFrame, chance: float) -> DataFrame:
    """(path, rep) one level deeper; big: path, rep, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row, sub = _split(path.view(np.uint64), _tokens(_matrix(batch.column(2))), chance)
            yield _rows(sub, rep[row])

    return big.select("path", "rep", "signature").mapInArrow(run, "path long, rep long")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least row number of each row's component."""
    root = np.arange(len(linked))
    while True:
        after = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked)))
        after = after[after]
        if (after == root).all():
            return root
        root = after


def bucket_links(buckets: DataFrame, loose: float = LOOSE) -> DataFrame:
    """(src, dst) of the sets of each small bucket whose signatures agree in ``loose`` of the slots; buckets: path, rep, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sigs = batch.column(0), batch.column(1)
            rep, sig = reps.flatten().to_numpy(zero_copy_only=False), _matrix(sigs.flatten())
            src, dst, a = [], [], 0
            for n in reps.value_lengths().to_pylist():
                r, s = rep[a : a + n], sig[a : a + n]
                a += n
                order = np.argsort(r)
                r, s = r[order], s[order]
                root = _roots(np.mean(s[:, None, :] == s[None, :, :], axis=2) >= loose)
                src.append(r), dst.append(r[root])
            src, dst = np.concatenate(src), np.concatenate(dst)
            yield pa.RecordBatch.from_arrays([pa.array(src[src != dst]), pa.array(dst[src != dst])], names=["src", "dst"])

    held = buckets.groupBy("path").agg(F.collect_list(F.struct("rep", "signature")).alias("m")).select(F.col("m.rep").alias("rep"), F.col("m.signature").alias("signature"))
    return held.mapInArrow(run, "src long, dst long")


def centred(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, rep, agree): the share of slots in which each set of a large bucket agrees with its centre; big: path, rep, n."""

    def modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out, a = batch.column(1), [], 0
            sig = _matrix(lists.flatten())
            for n in lists.value_lengths().to_pylist():
                s = np.sort(sig[a : a + n], axis=0)
                a += n
                count = (s[:, None, :] == s[None, :, :]).sum(axis=1)
                out.append(s[count.argmax(axis=0), np.arange(SLOTS)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "centre"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["path", "rep", "agree"])

    chosen = big.where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CENTRE)) == 0).join(sets, "rep")
    centres = chosen.groupBy("path").agg(F.collect_list("signature").alias("signatures")).mapInArrow(modes, "path long, centre binary")
    return big.join(sets, "rep").join(centres, "path").select("path", "rep", "signature", "centre").mapInArrow(agree, "path long, rep long, agree double")


def loose_links(sets: DataFrame, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) whose components hold every pair at the threshold with chance ``recall``; sets: rep, signature."""
    chance = THRESHOLD[1] / THRESHOLD[0] / SLOTS
    paths, found = first_paths(sets, runs_for(recall), chance), None
    for depth in range(START, DEEPEST + 1):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialise(paths.join(sizes, "path"), "paths")
        small = bucket_links(shared.where(F.col("n") <= bucket).join(sets, "rep"))
        found = small if found is None else found.union(small)
        big = shared.where(F.col("n") > bucket)
        if big.isEmpty():
            break
        if depth < DEEPEST:
            near = materialise(centred(big, sets), "near")
            paths = next_paths(near.where(F.col("agree") < TIGHT).join(sets, "rep"), chance)
            big = near.where(F.col("agree") >= JOIN)
        # else these share as many tokens as the depth: one class, whose pairs are compared below
        least = big.groupBy("path").agg(F.min("rep").alias("dst"))
        found = found.union(big.join(least, "path").where("rep <> dst").select(F.col("rep").alias("src"), "dst"))
    return gathered(found)


def gathered(links: DataFrame, rounds: int = 2) -> DataFrame:
    """The same components by fewer links; links: src, dst, dst < src.

    A set of many alike ones is in a bucket of each run and linked to the least set of each. It keeps its link to the
    least of these, and they are linked to that one themselves: links that many sets share become one.
    """
    links = materialise(links.distinct(), "loose")
    for _ in range(rounds):
        led = links.withColumn("least", F.min("dst").over(Window.partitionBy("src")))
        links = led.select("src", F.col("least").alias("dst")).union(led.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")))
        links = materialise(links.distinct(), "loose")
    return links


# --- exact comparison inside the loose classes ---------------------------------------------------


def _shared(sets: list[np.ndarray], n_left: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with all sets."""
    sizes = [len(s) for s in sets]
    _, item, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(counts > 1) - 1
    keep = counts[item] > 1
    owner, item = owner[keep], column[item[keep]]
    out = np.zeros((n_left, len(sets)), np.float32)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, width):
        a, b = np.searchsorted(item, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], item[a:b] - low] = 1
        out += has[:n_left] @ has.T
    return out.astype(np.int64)


def _compare(left: pd.DataFrame, right: pd.DataFrame | None) -> pd.DataFrame:
    """rep, root, links of a block's sets; right: None compares ``left`` with itself."""
    both = left if right is None else pd.concat([left, right])
    both = both.reset_index(drop=True)
    sets = [np.frombuffer(s, np.uint64) for s in both["items"]]
    n, size = len(left), np.array([len(s) for s in sets])
    up, down = THRESHOLD
    shared = _shared(sets, n)
    linked = shared * (up + down) >= up * (size[:n, None] + size[None, :])
    if right is None:
        np.fill_diagonal(linked, False)
    else:
        linked[:, :n] = False
    weight = both["copies"].to_numpy()
    whole = np.zeros((len(sets), len(sets)), bool)
    whole[:n] = linked
    whole |= whole.T
    order = np.argsort(both["rep"].to_numpy(), kind="stable")
    root = np.empty(len(sets), np.int64)
    root[order] = order[_roots(whole[np.ix_(order, order)])]
    return pd.DataFrame({"rep": both["rep"], "root": both["rep"].to_numpy()[root], "links": whole @ weight})


def exact_links(members: DataFrame, docs: DataFrame, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """rep, root, links of each block of each loose class; members: rep, label, copies, set_id, keep_id (a document that has the set)."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = members.join(sizes, "label").where("n > 1")
    ids = wanted.select(F.col("keep_id").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "items"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("d")
    texts = own.join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "set_id binary, items binary").where("set_id is not null")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = (
        wanted.join(sets.dropDuplicates(["set_id"]), "set_id")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        # classes of one block share groups; each pair of blocks of a larger class is a group
        .withColumn("part", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(4096))).otherwise(F.xxhash64("label", "low", "high")))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, low, high), tile in pdf.groupby(["label", "low", "high"], sort=False):
            left = tile[tile["own"] == low]
            if low == high:
                out.append(_compare(left, None))
            elif 0 < len(left) < len(tile):
                out.append(_compare(left, tile[tile["own"] == high]))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "root": [], "links": []})

    return placed.select("part", "label", "low", "high", "own", "rep", "copies", "items").groupBy("part").applyInPandas(compare, "rep long, root long, links long")


def jaccard_classes(docs: DataFrame, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is 0.8 or
    more; class_id is the least doc_id of the linked component, n_links the number of other rows linked
    directly. Words are split at white space; a text with fewer words has one shingle of all of them.
    Texts without words, null ones too, link to nothing. Repeated rows link to each other like copies, and
    rows of one doc_id with different texts link each by its own; a null doc_id is in no class_id but that of rows with null ids alone.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    rows = materialise(signatures(docs, size), "signatures")
    full = rows.where("set_id is not null").select("doc_id", "set_id")
    # sets are named by numbers of their own: rows of one doc_id may have several sets
    whole = materialise(groups(full, ["set_id"], "doc_id", F.min("doc_id")).withColumn("rep", F.monotonically_increasing_id()), "sets")
    reps = whole.select("set_id", "rep", "keep_id", F.col("group_size").alias("copies"))
    sets = materialise(
        rows.where("set_id is not null").join(reps, "set_id").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["rep"]).select("rep", "signature"), "reps"
    )
    labels = connected_components(loose_links(sets, recall))
    members = labels.withColumnRenamed("node", "rep").join(reps, "rep")
    found = materialise(exact_links(members, docs, size), "links")
    classes = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep").join(reps.select("rep", "keep_id"), "rep")
    least = groups(classes, ["label"], "keep_id", F.min("keep_id")).withColumnRenamed("keep_id", "class_id").drop("group_size")
    named = dealt(classes, least, ["label"], "keep_id").select("rep", "class_id")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        whole.join(named, "rep", "left").join(links, "rep", "left")
        .select("set_id", "_salts", F.coalesce("class_id", "keep_id").alias("class_id"), (F.col("group_size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return dealt(full, known, ["set_id"], "doc_id").select("doc_id", "class_id", F.col("n_links").cast("long")).union(
        rows.where("set_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )
