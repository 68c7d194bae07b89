"""Removal of passages that an earlier document holds, by sorted suffixes.

A passage is any 50-byte string. Every one has an anchor, the 24-byte string in it whose hash is least,
and equal passages have equal anchors at equal places. So a text falls into runs of passages that share
an anchor, and only runs with equal anchors need to be compared.

1. Texts are put into slices. Each slice sends a fingerprint of the anchor and a digest of the run, once
   for each distinct pair, to the shard of the anchor.
2. A shard tells which runs an earlier document holds whole, and which share only their anchor.
3. For the latter, the bytes before and after the anchor go to the shard. The suffixes from the anchor
   on, and the reversed texts before it, are put in order by deep-shallow sorting: multikey quicksort by
   eight-byte characters to a shallow depth, then blind tries for groups with longer common prefixes.
   Two passages are equal if they are in one class of both orders, at the depths that they reach to.
4. Each slice removes the bytes of the passages found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.words import mix, powers, slices

MATCH, ANCHOR = 50, 24
WINDOW = MATCH - ANCHOR + 1
SLICE = 1 << 21
#: Bytes of text for each shard, about.
SHARD = 1 << 24
#: Bytes that the multikey quicksort orders before the tries take over: the anchor.
SHALLOW = 24
LEFT, RIGHT = WINDOW - 1, MATCH
#: Stands for a null doc_id where ids are compared.
LAST = (1 << 63) - 1
ENTRY = np.dtype([("fp", "<u8"), ("digest", "<u8"), ("doc", "<i8")])
CONTEXT = np.dtype([("fp", "<u8"), ("doc", "<i8"), ("left", "u1"), ("windows", "u1"), ("before", "u1", LEFT), ("after", "u1", RIGHT)])


class Runs(NamedTuple):
    fp: np.ndarray
    digest: np.ndarray
    row: np.ndarray
    start: np.ndarray  # of the first passage
    stop: np.ndarray  # after the last passage
    anchor: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, part: int = SLICE) -> Runs:
    """The runs of all passages, none of which crosses from one row into another."""
    found = [_runs(data[a : a + part + MATCH - 1], offsets, a) for a in range(0, max(1, len(data)), part)]
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _runs(data: np.ndarray, offsets: np.ndarray, base: int) -> Runs:
    n = len(data)
    if n < MATCH:
        return Runs(*(np.zeros(0, t) for t in ("u8", "u8", "i8", "i8", "i8", "i8")))
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = np.uint64((1 << 31) - 1)
    least, size = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * size <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < WINDOW:
        least = np.minimum(least[: size - WINDOW], least[WINDOW - size :])
    anchor = (least & low).astype(np.int64)
    ends = offsets[1:] - base
    row = np.searchsorted(ends, np.arange(len(anchor)), "right")
    at = np.flatnonzero(np.arange(MATCH, MATCH + len(anchor)) <= ends[np.minimum(row, len(ends) - 1)])
    if not len(at):
        return _runs(data[:0], offsets, base)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, stop = at[first], at[np.append(first[1:], len(at)) - 1] + MATCH
    anchor, row = anchor[start], row[start]
    shape = (((anchor - start) << 16) | (stop - start)).astype(np.uint64)
    digest = mix((sums[stop] - sums[start]) * down[start] ^ mix(shape))
    return Runs(hashes[anchor], digest, row, start + base, stop + base, anchor + base)


class Sent(NamedTuple):
    entries: np.ndarray  # by shard, then fingerprint and digest: what the slice sends
    runs: np.ndarray  # a run of each entry
    shard: np.ndarray
    entry: np.ndarray  # for each run, its entry
    later: np.ndarray  # runs that a smaller document of the slice holds whole


def sent(found: Runs, doc_ids: np.ndarray, shards: int) -> Sent:
    doc = doc_ids[found.row]
    order = np.lexsort((doc, found.digest, found.fp))
    fp, digest = found.fp[order], found.digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (digest[1:] != digest[:-1])
    group, first = np.cumsum(new) - 1, order[new]
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[first][group]
    shard = (found.fp[first] % np.uint64(shards)).astype(np.int64)
    by_shard = np.argsort(shard, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_shard] = np.arange(len(first))
    entry = np.empty(len(order), np.int64)
    entry[order] = rank[group]
    first = first[by_shard]
    entries = np.empty(len(first), ENTRY)
    entries["fp"], entries["digest"], entries["doc"] = found.fp[first], found.digest[first], doc[first]
    return Sent(entries, first, shard[by_shard], entry, later)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(shard)), strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


WHOLE, MIXED = 1, 2


def judge(entries: np.ndarray) -> np.ndarray:
    """WHOLE: a smaller document has the run. MIXED: of the least document of its digest, where others share the anchor alone."""
    order = np.lexsort((entries["doc"], entries["digest"], entries["fp"]))
    e = entries[order]
    new_fp, new_run = np.ones(len(e), bool), np.ones(len(e), bool)
    new_fp[1:] = e["fp"][1:] != e["fp"][:-1]
    new_run[1:] = new_fp[1:] | (e["digest"][1:] != e["digest"][:-1])
    group, run = np.cumsum(new_fp) - 1, np.cumsum(new_run) - 1
    digests = np.bincount(group[new_run])
    docs = np.minimum.reduceat(e["doc"], np.flatnonzero(new_fp)) < np.maximum.reduceat(e["doc"], np.flatnonzero(new_fp))
    whole = e["doc"] > e["doc"][new_run][run]
    out = np.zeros(len(e), np.uint8)
    out[order] = np.where(whole, WHOLE, np.where((digests > 1)[group] & docs[group], MIXED, 0))
    return out


# --- deep-shallow sorting ------------------------------------------------------------------------


def blind_trie(strings: list[int], size: int) -> tuple[list[int], list[int]]:
    """Order of ``size``-byte strings given as integers, and the common prefix of each with the one before it.

    Inner nodes hold only the depth of their branch and the children's characters. A string descends by
    them, is compared with one leaf, and then branches off at the first difference.
    """
    top = 8 * size - 8
    leaves: list[list[int]] = [[0]]
    root: list = [size, None, 0]  # depth, children, a leaf below
    for k in range(1, len(strings)):
        x, node = strings[k], root
        while node[1] is not None:
            node = node[1].get((x >> (top - 8 * node[0])) & 255) or next(iter(node[1].values()))
        diff = x ^ strings[leaves[node[2]][0]]
        if not diff:
            leaves[node[2]].append(k)
            continue
        depth = size - (diff.bit_length() + 7) // 8
        node = root
        while node[0] < depth:
            node = node[1][(x >> (top - 8 * node[0])) & 255]
        leaf = [size, None, len(leaves)]
        leaves.append([k])
        shift = top - 8 * depth
        if node[0] == depth and node[1] is not None:
            node[1][(x >> shift) & 255] = leaf
        else:
            old = [node[0], node[1], node[2]]
            node[0], node[1] = depth, {(strings[leaves[old[2]][0]] >> shift) & 255: old, (x >> shift) & 255: leaf}
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if node[1] is None:
            same = leaves[node[2]]
            order += same
            common += [before] + [size] * (len(same) - 1)
        else:
            children = [node[1][c] for c in sorted(node[1])]
            stack += [(child, node[0]) for child in reversed(children[1:])] + [(children[0], before)]
    return order, common


def multikey_quicksort(characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an (n, depth) matrix, and for each place the place where its group of equal rows begins.

    All groups are split at once: each into the rows below, at and above its middle row's character; those at it go one deeper.
    """
    n, deepest = characters.shape
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n if deepest else 0)
    while len(active):
        rows, own = order[active], group[active]
        c = characters[rows, depth[active]]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(first, len(own)))
        pivot = np.repeat(c[first + size // 2], size)
        side = np.repeat(3 * np.arange(len(first)), size) + 1 + (c > pivot) - (c < pivot)
        by = np.argsort(side, kind="stable")
        side = side[by]
        order[active], depth[active] = rows[by], depth[active[by]] + (side % 3 == 1)
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        size = np.diff(np.append(first, len(side)))
        group[active] = np.repeat(active[first], size)
        active = active[(np.repeat(size, size) > 1) & (depth[active] < deepest)]
    return order, group


def deep_shallow(text: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an (n, width) byte matrix, and the common prefix of each with the one before it."""
    n, width = text.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = -(-width // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, :width] = text
    characters = padded.view(">u8").astype(np.uint64)[:, : min(shallow, wide) // 8]
    order, tied = multikey_quicksort(characters)
    common, same = np.full(n, wide, np.int64), np.ones(n, bool)
    common[0] = same[0] = 0
    for depth in range(characters.shape[1]):
        x = np.append(np.uint64(0), characters[order[1:], depth] ^ characters[order[:-1], depth])
        place = np.flatnonzero(same & (x > 0))
        zeros = np.zeros(len(place), np.int64)
        for k in range(7, 0, -1):
            zeros += x[place] < np.uint64(1 << (8 * k))
        common[place] = 8 * depth + zeros
        same[place] = False
    starts = np.flatnonzero(np.append(True, tied[1:] != tied[:-1]))
    rest = padded[:, min(shallow, wide) :]
    size = rest.shape[1]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        if b - a > 1 and size:
            own = order[a:b]
            sub, lcp = blind_trie([int.from_bytes(r, "big") for r in map(bytes, rest[own])], size)
            order[a:b] = own[sub]
            common[a + 1 : b] = np.array(lcp[1:]) + min(shallow, wide)
    return order, np.minimum(common, width)


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its class of rows whose first ``depth`` bytes are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


def compare(contexts: np.ndarray) -> np.ndarray:
    """For each context, the bits of its passages that a context of a smaller document holds; bit 0 is its first."""
    left = deep_shallow(contexts["before"], shallow=8)
    right = deep_shallow(contexts["after"])
    bits = np.zeros(len(contexts), np.uint32)
    for before in range(WINDOW):  # bytes of the passage before the anchor
        has = np.flatnonzero((contexts["left"] >= before) & (contexts["left"].astype(int) - before < contexts["windows"]))
        if not len(has):
            continue
        a, b = classes(*left, before)[has], classes(*right, MATCH - before)[has]
        doc = contexts["doc"][has]
        order = np.lexsort((doc, a, b))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = doc[order][new][np.cumsum(new) - 1]
        hit = has[order][doc[order] > least]
        bits[hit] |= np.uint32(1) << (contexts["left"][hit] - before).astype(np.uint32)
    return bits


def contexts(data: np.ndarray, found: Runs, doc_ids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(len(chosen), CONTEXT)
    start, stop, anchor = found.start[chosen], found.stop[chosen], found.anchor[chosen]
    out["fp"], out["doc"], out["left"], out["windows"] = found.fp[chosen], doc_ids[found.row[chosen]], anchor - start, stop - start - MATCH + 1
    for k in range(LEFT):  # reversed: the byte next to the anchor comes first
        at = anchor - 1 - k
        out["before"][:, k] = np.where(at >= start, data[np.maximum(at, 0)], 0)
    for k in range(RIGHT):
        at = anchor + k
        out["after"][:, k] = np.where(at < stop, data[np.minimum(at, len(data) - 1)], 0)
    return out


# --- Spark ---------------------------------------------------------------------------------------

SLICES = "slice long, doc_ids binary, offsets binary, text binary, size long, unnamed binary"


def sliced(docs: DataFrame) -> DataFrame:
    """Rows of about 2 MB of texts, compressed; a text is in one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                part = batch.column(0)[a:b]
                ids, unnamed = (x.to_numpy(zero_copy_only=False) for x in (part.fill_null(LAST), part.is_null()))
                text = pa.compress(data.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + k]), *(pa.array([x], pa.binary()) for x in (ids.astype(np.int64).tobytes(), offsets.tobytes(), text)), pa.array([len(data)]), pa.array([np.packbits(unnamed).tobytes()], pa.binary())],
                    names=["slice", "doc_ids", "offsets", "text", "size", "unnamed"],
                )
                k += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SLICES)


def _opened(ids: bytes, offsets: bytes, text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(pa.decompress(text, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64), data


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "lz4", asbytes=True)


def _blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["slice", "shard", "n", "data"])


BLOBS = "slice long, shard long, n long, data binary"


def _answered(blobs: DataFrame, partitions: int, kind: np.dtype, answer, packed: bool) -> DataFrame:
    """Brings each shard's blobs together and returns ``answer`` of their rows, cut up as they came; nothing for blobs of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            raw = b"".join(pa.decompress(r[3], r[2] * kind.itemsize, "lz4", asbytes=True) if packed else r[3] for r in rows)
            codes = answer(np.frombuffer(raw, kind))
            parts = np.split(codes, np.cumsum([r[2] for r in rows])[:-1])
            return _blobs([(r[0], r[1], r[2], _packed(p)) for r, p in zip(rows, parts, strict=True) if p.any()])

        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1] != row[1]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return blobs.repartition(partitions, "shard").sortWithinPartitions("shard", "slice").mapInArrow(run, BLOBS)


def _gathered(blobs: DataFrame, name: str) -> DataFrame:
    return blobs.groupBy("slice").agg(F.collect_list(F.struct("shard", "data")).alias(name))


def _codes(found: Sent, answers: list[dict] | None, kind: str, of: np.ndarray | None = None) -> np.ndarray:
    """The answers for a slice's entries (for those in ``of`` if given), 0 where there is none."""
    out, at = np.zeros(len(found.entries), kind), {s: part for s, part in _by_shard(found.shard)}
    for answer in answers or []:
        part = np.arange(at[answer["shard"]].start, at[answer["shard"]].stop)
        part = part if of is None else part[of[part]]
        out[part] = np.frombuffer(pa.decompress(answer["data"], len(part) * out.itemsize, "lz4", asbytes=True), kind)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    Each byte goes that lies in a 50-byte string which also starts in a document of smaller doc_id, as
    the texts came. A null text counts as empty. Rows repeated under one id do not remove each other's
    bytes. kept_text lacks characters that a cut broke. A null doc_id is compared
    as the greatest id, 2^63 - 1, and stays null. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    table = materialise(sliced(docs), "slices")
    total = table.agg(F.sum("size").alias("n")).first()["n"] or 0
    shards = max(8, total // SHARD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, data = _opened(*row)
                s = sent(runs(data, offsets), ids, shards)
                yield _blobs([(k, shard, part.stop - part.start, s.entries[part].tobytes()) for shard, part in _by_shard(s.shard)])

    columns = ("slice", "doc_ids", "offsets", "text", "size")
    judged = materialise(_answered(table.select(*columns).mapInArrow(send, BLOBS), shards, ENTRY, judge, False), "judged")

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, *row, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, data = _opened(*row)
                found = runs(data, offsets)
                s = sent(found, ids, shards)
                mixed = _codes(s, answers, "u1") == MIXED
                rows = []
                for shard, part in _by_shard(s.shard[mixed]):
                    c = contexts(data, found, ids, s.runs[mixed][part])
                    rows.append((k, shard, len(c), _packed(c)))
                yield _blobs(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *row, unnamed, answers, masks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, data = _opened(*row)
                found = runs(data, offsets)
                s = sent(found, ids, shards)
                code = _codes(s, answers, "u1")
                bits = _codes(s, masks, "<u4", code == MIXED)
                edge = np.zeros(len(data) + 1, np.int32)
                whole = s.later | (code[s.entry] == WHOLE)
                np.add.at(edge, found.start[whole], 1)
                np.add.at(edge, found.stop[whole], -1)
                some = np.flatnonzero(~whole & (bits[s.entry] != 0))
                for window in range(WINDOW):
                    hit = found.start[some][(bits[s.entry[some]] >> np.uint32(window)) & np.uint32(1) == 1] + window
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + MATCH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                yield _result(ids, offsets, data, gone, unnamed, with_text)

    judged_by_slice = _gathered(judged, "answers")
    asked = table.join(judged_by_slice, "slice").select(*columns, "answers").mapInArrow(send_contexts, BLOBS)
    masks = materialise(_answered(asked, shards, CONTEXT, compare, True), "masks")
    out = (
        table.join(judged_by_slice, "slice", "left").join(_gathered(masks, "masks"), "slice", "left").select(*columns, "unnamed", "answers", "masks")
        .mapInArrow(finish, RESULT)
    )
    return out if with_text else out.drop("kept_text")


def _result(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, gone: np.ndarray, unnamed: bytes, with_text: bool) -> pa.RecordBatch:
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = gone[edge]
    removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
    kept = data[~gone].tobytes()
    at = offsets - removed[offsets]
    texts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, mask=np.unpackbits(np.frombuffer(unnamed, np.uint8), count=len(ids)).astype(bool)), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            pa.array([t.decode(errors="ignore") if with_text else None for t in texts], pa.string()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
    )
