"""Alignment of two tokenizers' tokens on the same text.

Both tokenizers break before a space that follows another character than a space and stands before a
visible one, so a batch's distinct units between such spaces are encoded once and dealt to the documents.
With pandas ``merge_asof``, keyed by document, each token start finds the token of the other side that covers
it. The union of both directions holds all overlaps, and byte offsets where tokens of both sides end cut
them into groups. Spark counts the documents of each pair of ids. The commonest pairs' counts, of a bounded number,
and each id's highest count, as many as the vocabulary has ids, are broadcast; links of other pairs meet their counts in a join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.chunk_bpe import Vocabulary, _lists, sure_breaks
from pingmill.llm.words import commonest, slices

#: Bytes of text of a batch; a longer text is a batch of its own.
BATCH = 2 << 20
#: Pairs of ids whose counts are broadcast, 16 bytes each.
PAIRS = 1_000_000
#: Distinct units that a task remembers, and pairs that it counts before it hands them over.
UNITS, HELD = 200_000, 2_000_000
SPACE = 32
TOKENS = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary, code long, n long"


class Pieces(Vocabulary):
    """The same of a SentencePiece model: U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, model) -> None:
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.pieces = [bytes.fromhex(p[3:5]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.column = pa.array(self.pieces, pa.large_binary())
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)


class Sides:
    """Both tokenizers, and the ids of the units that they have encoded."""

    def __init__(self, ranks_path: str | None, model_path: str | None) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.vocabularies = Vocabulary(self.a), Pieces(self.b)
        self.decimal = [pa.array([f"{k}{sign}" for sign in ",|;" for k in range(len(v.pieces))], pa.large_binary()) for v in self.vocabularies]
        self.space = [self.b.piece_to_id("▁")]
        self.clear()

    def clear(self) -> None:
        self.units: dict[bytes, int] = {}
        self.flat = [np.zeros(0, np.int64)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of both sides for rows of space and text, one row after the other."""
        edge = np.zeros(len(data) + 1, bool)
        breaks = sure_breaks(data)
        edge[breaks[data[np.maximum(breaks, 1) - 1] != SPACE]] = True
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        found = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        if len(self.units) > UNITS:
            self.clear()
        distinct = found.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.units]
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
        pieces = [x or self.space for x in self.b.encode([u[1:].decode() for u in new], num_threads=1)]
        for k, (flat, sizes) in enumerate((self._first(new), (np.fromiter(chain.from_iterable(pieces), np.int64), [len(x) for x in pieces]))):
            self.flat[k] = np.concatenate([self.flat[k], flat])
            self.ends[k] = np.append(self.ends[k], self.ends[k][-1] + np.cumsum(sizes, dtype=np.int64))
        at = np.array([self.units[u] for u in distinct], np.int64)[found.indices.to_numpy(zero_copy_only=False)]
        return [_lists(self.flat[k], self.ends[k], at) for k in (0, 1)]

    def _first(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of units, encoded in one go where a unit begins with a space before a visible character, and their numbers."""
        whole, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum([len(u) for u in units], dtype=np.int64)
        if not len(whole):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.append(0, ends[:-1])
        alone = np.append(np.flatnonzero(~np.isin(begins, sure_breaks(whole))), len(units)).tolist()
        parts, at = [], 0
        for k in alone:  # each unit of these starts a part of its own
            if k:
                parts.append(self.a.encode_ordinary(whole[begins[at] : ends[k - 1]].tobytes().decode()))
            at = k
        ids = np.fromiter(chain.from_iterable(parts), np.int64)
        return ids, np.diff(np.append(0, np.searchsorted(np.cumsum(self.vocabularies[0].lengths[ids]), ends, "right")))


@lru_cache(maxsize=1)
def _sides(ranks_path: str | None, model_path: str | None) -> Sides:
    return Sides(ranks_path, model_path)


def _spaced(column: pa.Array) -> pa.Array:
    """Space and text; null and empty stay without bytes."""
    return pa.array([b" " + t.as_py().encode() if len(t.as_py() or "") else None for t in column], pa.large_binary())


def _true_rows(data: np.ndarray, offsets: np.ndarray, ids: list[np.ndarray], sides: Sides) -> np.ndarray:
    """Rows whose bytes both sides' tokens make."""
    right = np.ones(len(offsets) - 1, bool)
    for own, vocabulary in zip(ids, sides.vocabularies, strict=True):
        joined = np.frombuffer(vocabulary.bytes_of(own), np.uint8)
        if len(joined) != len(data):
            return np.zeros(len(offsets) - 1, bool) if len(right) == 1 else np.concatenate([_alone(data, offsets, k, sides) for k in range(len(right))])
        wrong = np.flatnonzero(joined != data)
        right[np.searchsorted(offsets, wrong, "right") - 1] = False
    return right


def _alone(data: np.ndarray, offsets: np.ndarray, row: int, sides: Sides) -> np.ndarray:
    own = data[offsets[row] : offsets[row + 1]]
    ends = np.array([0, len(own)])
    return _true_rows(own, ends, sides.tokens(own, ends), sides) if len(own) else np.ones(1, bool)


def overlaps(doc: list[np.ndarray], start: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of all links. Tokens of both sides: document and start, ascending; both cover the same bytes."""
    frames = [pd.DataFrame({"start": s, "doc": d, f"place_{k}": np.arange(len(s)), f"start_{k}": s}) for k, (d, s) in enumerate(zip(doc, start, strict=True))]
    over = pd.merge_asof(frames[0], frames[1], on="start", by="doc")
    under = pd.merge_asof(frames[1], frames[0], on="start", by="doc")
    under = under[under["start_0"] < under["start_1"]]  # equal starts are in both directions
    return tuple(np.concatenate([over[c].to_numpy(), under[c].to_numpy()]).astype(np.int64) for c in ("place_0", "place_1"))


def align(ids: list[np.ndarray], offsets: np.ndarray, sides: Sides) -> dict[str, np.ndarray | list]:
    """What rows' tokens give: n_a, n_b, n_groups, n_links, groups (text), and links as (row, code = A id * 2^32 + B id)."""
    rows = len(offsets) - 1
    ends = [np.cumsum(v.lengths[x]) for x, v in zip(ids, sides.vocabularies, strict=True)]
    start = [e - v.lengths[x] for e, x, v in zip(ends, ids, sides.vocabularies, strict=True)]
    doc = [np.searchsorted(offsets, s, "right") - 1 for s in start]
    a, b = overlaps(doc, start)
    both = np.zeros((2, int(offsets[-1]) + 1), bool)
    for k in (0, 1):
        both[k, ends[k]] = True
    shared = both.all(axis=0)
    cut = np.flatnonzero(shared)
    group = [np.searchsorted(cut, e) for e in ends]
    # tokens in order of group, side, place; each is followed by a comma, a bar, a semicolon or nothing
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    last = [shared[e] for e in ends]
    sign = np.concatenate([np.where(last[0], 1, 0), np.where(last[1], 2, 0)])
    n = [len(v.pieces) for v in sides.vocabularies]
    words = pa.concat_arrays([sides.decimal[0].take(pa.array(ids[0] + n[0] * sign[: len(ids[0])])), sides.decimal[1].take(pa.array(ids[1] + n[1] * sign[len(ids[0]) :]))]).take(pa.array(order))
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    whose = np.concatenate(doc)[order]
    edge = at[np.searchsorted(whose, np.arange(rows + 1))].tolist()
    text = memoryview(words.buffers()[2] or b"")
    counted = lambda x: np.bincount(x, minlength=rows)
    return {
        "n_a": counted(doc[0]), "n_b": counted(doc[1]), "n_groups": counted(doc[1][last[1]]), "n_links": counted(doc[0][a]),
        "groups": [bytes(text[x : max(x, y - 1)]) for x, y in zip(edge[:-1], edge[1:], strict=True)],  # without the last semicolon
        "row": doc[0][a], "code": ids[0][a] << 32 | ids[1][b],
    }


def _distinct(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of distinct links, by row and code."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
    return row[first], code[first], np.diff(np.append(first, len(row)))


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def aligned_tokens(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Two kinds of rows: documents with their distinct links and times, and (code, n) of a task's pairs with their numbers of documents."""
    schema = [("key", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary()), ("code", pa.int64()), ("n", pa.int64())]

    def record(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in schema], names=[c for c, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(ranks_path, model_path)
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for p, q, data, offsets in slices(batch.column(2), BATCH):
                rows, size = batch.slice(p, q - p), q - p
                spaced = _spaced(rows.column(2))
                offsets = np.frombuffer(spaced.buffers()[1], np.int64, size + 1)
                data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: offsets[-1]]
                ids = sides.tokens(data, offsets)
                right = _true_rows(data, offsets, ids, sides)
                if not right.all():  # again without the rows that a side changes
                    sizes = np.where(right, np.diff(offsets), 0)
                    data = data[np.repeat(right, np.diff(offsets))]
                    offsets = np.append(0, np.cumsum(sizes))
                    ids = sides.tokens(data, offsets)
                found = align(ids, offsets, sides)
                row, code, times = _distinct(found["row"], found["code"])
                at = np.searchsorted(row, np.arange(size + 1)).tolist()
                small = np.minimum(times, 0xFFFFFFFF).astype("<u4")
                yield record(
                    size, key=rows.column(0), doc_id=rows.column(1), **{c: pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")},
                    groups_sha256=pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]], pa.string()),
                    links=pa.array([_packed(code[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    times=pa.array([small[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                )
                pair, n = np.unique(code, return_counts=True)
                codes.append(pair)
                counts.append(n)
                if sum(map(len, codes)) > HELD:
                    pair, n = _added(codes, counts)
                    codes, counts = ([], []) if len(pair) > HELD // 2 else ([pair], [n])
                    if not codes:
                        yield record(len(pair), code=pa.array(pair), n=pa.array(n))
        if codes:
            pair, n = _added(codes, counts)
            yield record(len(pair), code=pa.array(pair), n=pa.array(n))

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, TOKENS)


def _packed(code: np.ndarray) -> bytes:
    """Ascending codes as A ids' steps and B ids."""
    return np.concatenate([np.diff(code >> 32, prepend=0).astype("<u2"), (code & 0xFFFFFFFF).astype("<u2")]).tobytes()


def _unpacked(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all rows' links."""
    row, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, own in enumerate(links):
        a, b = np.frombuffer(own.as_buffer(), "<u2").astype(np.int64).reshape(2, -1)
        row.append(np.full(len(a), k))
        code.append(np.cumsum(a) << 32 | b)
    return np.concatenate(row), np.concatenate(code)


def token_alignment(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: the byte-level rank file, on space and text, special tokens' strings being plain text; B: the
    SentencePiece model, which adds the space; both have at most 65,536 ids. Null and empty texts, and
    texts that a side's tokens don't make again (U+2581 is one), have zeros and an empty hash. Repeated
    rows are documents of their own, in counts too; a null doc_id stays null; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    found = materialise(aligned_tokens(docs, ranks_path, model_path), "aligned")
    rows = found.where("code is null").drop("code", "n")
    counts = materialise(found.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    first = F.shiftright("code", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))  # as many rows as A has ids at most
    top = commonest(counts, pairs).toArrow().sort_by("code")
    best = highest.toArrow()
    shared = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for t, c in ((top, "code"), (top, "n"), (best, "a"), (best, "best"))))

    def known(code: np.ndarray) -> np.ndarray:
        """Counts of pairs, 0 for those that are not broadcast."""
        codes, n = shared.value[:2]
        if not len(codes):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, n[at], 0)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest_of = np.zeros(1 << 16, np.int64)
        highest_of[shared.value[2]] = shared.value[3]
        for batch in batches:
            row, code = _unpacked(batch.column(0))
            times = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<u4").astype(np.int64)
            n = known(code)
            sums = [np.bincount(row, w, batch.num_rows).astype(np.int64) for w in (np.where((n > 0) & (n == highest_of[code >> 32]), times, 0), n * times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, sums)], names=[*names, "own_best", "own_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = _unpacked(batch.column(0))
            times = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<u4").astype(np.int64)
            far = known(code) == 0
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row[far])), pa.array(code[far]), pa.array(times[far])], names=["key", "code", "times"])

    names = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    near = rows.select("links", "times", *names).mapInArrow(common, "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own_best long, own_sum long")
    far = rows.select("links", "times", "key").mapInArrow(rest, "key long, code long, times long").join(counts, "code")
    far = far.join(F.broadcast(highest), first == F.col("a")).groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("far_best"), F.sum(F.col("n") * F.col("times")).alias("far_sum"))
    total = lambda c: (F.col(f"own_{c}") + F.coalesce(f"far_{c}", F.lit(0))).cast("long")
    return near.join(far, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("best").alias("n_best"), total("sum").alias("count_sum"), "groups_sha256")
