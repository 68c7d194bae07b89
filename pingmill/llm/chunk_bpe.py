"""BPE encoding and decoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, so documents that share a passage share its
chunks. Chunks are encoded, not texts: those that most documents share once for the corpus (their bytes
and ids are broadcast, a bounded number of short chunks), the others once a block of documents, where they
are, so no text is shuffled. A cut may fall inside a word, and then the tokens beside it are not those of
the whole text. The joins are repaired by encoding the stretch around the cut again. It ends at spaces
before visible characters, where no token and no word of the pattern goes on, and it is widened until
the chunks' own tokens break at both of its ends too. Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.packing import _encoding
from pingmill.llm.words import commonest, slices, span_hashes

#: Chunks hold 512 bytes on average (a power of two), LEAST and MOST at the ends.
MEAN, LEAST, MOST = 512, 64, 4096
#: Bytes that the rolling hash sees.
REACH = 16
#: Chunks that are encoded once for the whole corpus and broadcast: 20,000 of at most MOST bytes each.
SHARED = 20_000
#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 8 << 20
SPACE = 32
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, ascending: each row's start and the content-defined cuts inside rows, all before whole characters."""
    n = len(data)
    starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    if not n:
        return starts
    rolled = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(15)
    step = 1
    while step < min(REACH, n):  # the hash of twice as many bytes from two hashes
        later = rolled * np.uint32(0x85EBCA6B)
        later[step:] += rolled[:-step]
        later ^= later >> np.uint32(13)
        rolled, step = later, step * 2
    found = np.flatnonzero(rolled & np.uint32(MEAN - 1) == 0) + 1
    found = found[found < n]
    row = starts[np.searchsorted(starts, found, "right") - 1]
    found = found[(found - row >= LEAST) & (data[found] & 0xC0 != 0x80)]
    out, ends = [], np.append(starts[1:], n).tolist()
    at = 0
    found = found.tolist()
    for start, end in zip(starts.tolist(), ends, strict=True):
        out.append(start)
        last = start
        while last < end:
            while at < len(found) and found[at] < min(last + LEAST, end):
                at += 1
            following = found[at] if at < len(found) else end
            last = min(following, last + MOST, end)
            while last < end and data[last] & 0xC0 == 0x80:
                last -= 1
            if last < end:
                out.append(last)
    return np.array(out, np.int64)


def sure_breaks(data: np.ndarray) -> np.ndarray:
    """Positions of spaces before a visible character. The pattern begins a word there, whatever came before, and a token too."""
    after = data[1:]
    visible = (after > SPACE) & (after < 0x7F) | (after > 0xC2) & (after < 0xE0) | (after > 0xE3)
    return np.flatnonzero((data[:-1] == SPACE) & visible)


class Vocabulary:
    """Ids' bytes and lengths."""

    def __init__(self, encoding) -> None:
        self.pieces = [b""] * (encoding.max_token_value + 1)
        for k in range(len(self.pieces)):
            try:
                self.pieces[k] = encoding.decode_single_token_bytes(k)
            except KeyError:  # an id without a token
                pass
        self.column = pa.array(self.pieces, pa.large_binary())
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        found = self.column.take(pa.array(ids))
        return bytes(memoryview(found.buffers()[2] or b"")[: int(self.lengths[ids].sum())])


@lru_cache(maxsize=1)
def _loaded(ranks_path: str | None, json_path: str | None):
    encoding = _encoding(ranks_path, json_path)
    return encoding, Vocabulary(encoding)


def _lists(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The lists of ``rows`` one after the other; list k is flat[ends[k]:ends[k + 1]]."""
    sizes = ends[rows + 1] - ends[rows]
    shift = np.append(0, np.cumsum(sizes)[:-1]) if len(rows) else np.zeros(0, np.int64)
    return flat[np.repeat(ends[rows] - shift, sizes) + np.arange(int(sizes.sum()))]


def encode_block(data: np.ndarray, offsets: np.ndarray, encode: Callable[[str], list[int]], lengths: np.ndarray, shared: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, rows' offsets into them), as ``encode`` gives them for each whole row.

    ``shared``: (chunks, ids, ends) that are known. Other distinct chunks of the block are encoded once.
    """
    begin = cuts(data, offsets)
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    stop = np.append(begin[1:], len(data))
    chunks = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    chosen = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.full(len(chunks.dictionary), -1) if shared is None else pc.fill_null(pc.index_in(chunks.dictionary, shared[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.flatnonzero(known < 0)
    own = [np.array(encode(chunks.dictionary[k].as_py().decode()), np.uint32) for k in new.tolist()]
    flat, ends = (np.zeros(0, np.uint32), np.zeros(1, np.int64)) if shared is None else shared[1:]
    known[new] = len(ends) - 1 + np.arange(len(new))
    flat, ends = np.concatenate([flat, *own]), np.append(ends, ends[-1] + np.cumsum([len(x) for x in own], dtype=np.int64))
    ids = _lists(flat, ends, known[chosen])
    ids = _repaired(data, offsets, begin, stop, ids, encode, lengths)
    starts = np.append(0, np.cumsum(lengths[ids]))
    return ids, np.searchsorted(starts[:-1], offsets)


def _repaired(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, stop: np.ndarray, ids: np.ndarray, encode: Callable[[str], list[int]], lengths: np.ndarray) -> np.ndarray:
    """The chunks' tokens with the stretches around the joins encoded again."""
    starts = np.append(0, np.cumsum(lengths[ids]))
    row, edge, breaks = (np.zeros(len(data) + 1, bool) for _ in range(3))
    row[offsets], edge[offsets], edge[sure_breaks(data)], breaks[starts] = True, True, True, True
    joins, edges = begin[~row[begin]], np.flatnonzero(edge)
    left, right = np.searchsorted(edges, joins, "right") - 1, np.searchsorted(edges, joins, "left")  # equal where the cut is at an edge
    rows = row[edges]
    while True:  # widen until the chunks' tokens break at both ends, which they do at rows' ends
        wider_left, wider_right = ~breaks[edges[left]] & ~rows[left], ~breaks[edges[right]] & ~rows[right]
        if not (wider_left.any() or wider_right.any()):
            break
        left, right = left - wider_left, right + wider_right
    low, high = edges[left], edges[right]
    low, high = low[low < high], high[low < high]
    if not len(low):
        return ids
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.append(True, low[1:] >= reach[:-1])  # stretches that overlap are one
    high = reach[np.append(np.flatnonzero(first)[1:] - 1, len(low) - 1)]
    low = low[first]
    raw = data.tobytes()
    again = [encode(raw[a:b].decode()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    at = np.searchsorted(low, starts[:-1], "right") - 1
    kept = (at < 0) | (starts[:-1] >= high[at])
    place = np.searchsorted(starts[:-1][kept], low)
    return np.insert(ids[kept], np.repeat(place, [len(x) for x in again]), np.array([k for x in again for k in x], np.uint32))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(other columns' rows, bytes, offsets) of blocks of about ``size`` bytes; the text is the last column."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(batch.num_columns - 1), size):
            yield batch.slice(a, b - a), data, offsets


def shared_chunks(docs: DataFrame, limit: int = SHARED, ranks_path: str | None = None, json_path: str | None = None) -> pa.Table:
    """(chunk, ids) of at most ``limit`` of the commonest chunks, each encoded once.

    Fingerprints are counted over all documents; then the least document of each common one is cut again for its bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _blocks(batches, BLOCK):
            begin = cuts(data, offsets)
            doc = rows.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(offsets, begin, "right") - 1]
            prints = span_hashes(data, begin, np.append(begin[1:], len(data))).view(np.int64) if len(begin) else np.zeros(0, np.int64)
            order = np.lexsort((doc, prints))
            prints, doc = prints[order], doc[order]
            first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
            yield pa.RecordBatch.from_arrays([pa.array(prints[first]), pa.array(doc[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(prints))))], names=["print", "doc_id", "n"])

    text = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = text.mapInArrow(count, "print long, doc_id long, n long").groupBy("print").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    top = commonest(materialise(counts.where("n > 1"), "chunks"), limit).select("print", "doc_id").toArrow()
    prints = docs.sparkSession.sparkContext.broadcast(np.sort(top.column("print").to_numpy()))  # at most ``limit``
    chosen = docs.sparkSession.createDataFrame(top.select(["doc_id"])).distinct() if len(top) else text.select("doc_id").limit(0)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _loaded(ranks_path, json_path)
        for _, data, offsets in _blocks(batches, BLOCK):
            begin = cuts(data, offsets)
            stop = np.append(begin[1:], len(data))
            own = span_hashes(data, begin, stop).view(np.int64)
            found: dict[bytes, int] = {data[begin[k] : stop[k]].tobytes(): int(own[k]) for k in np.flatnonzero(np.isin(own, prints.value)).tolist()}
            ids = [np.array(encoding.encode(c.decode(), allowed_special="all"), "<u4").tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.binary()), pa.array(ids, pa.binary())], names=["print", "chunk", "ids"])

    coded = text.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(code, "print long, chunk binary, ids binary")
    return coded.groupBy("print").agg(F.min(F.struct("chunk", "ids")).alias("c")).select("c.*").toArrow()


def encode_decode(docs: DataFrame, ranks_path: str | None = None, json_path: str | None = None, shared: int = SHARED, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, little-endian, if asked for).

    The vocabulary is a rank file with the added tokens of a JSON file, those of byte_bpe_50k by default; a
    literal added token in a text is that token. Null and empty texts have no tokens; a null doc_id stays
    null; repeated rows each give a row; an empty table gives no rows; other columns are not read.
    """
    top = shared_chunks(docs, shared, ranks_path, json_path).combine_chunks()
    known = docs.sparkSession.sparkContext.broadcast(([c.as_py() for c in top.column("chunk")], [c.as_py() for c in top.column("ids")]))  # at most ``shared`` chunks of MOST bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, vocabulary = _loaded(ranks_path, json_path)
        chunks, coded = known.value
        ends = np.append(0, np.cumsum([len(c) // 4 for c in coded], dtype=np.int64))
        given = (pa.array(chunks, pa.binary()), np.frombuffer(b"".join(coded), "<u4").astype(np.uint32), ends)
        for rows, data, offsets in _blocks(batches, BLOCK):
            ids, at = encode_block(data, offsets, lambda t: encoding.encode(t, allowed_special="all"), vocabulary.lengths, given)
            decoded, raw = memoryview(vocabulary.bytes_of(ids)), memoryview(ids.astype("<u4").tobytes())
            there = np.append(0, np.cumsum(vocabulary.lengths[ids]))[at].tolist()
            at = at.tolist()
            coded_rows = [raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
            texts = [bytes(decoded[a:b]).decode("utf-8", "replace").encode() for a, b in zip(there[:-1], there[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(np.diff(at)), pa.array([hashlib.sha256(x).hexdigest() for x in coded_rows], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([bytes(x) if with_ids else None for x in coded_rows], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
    return out if with_ids else out.drop("ids")
