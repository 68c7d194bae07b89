"""Language-model scoring by online logistic context mixing.

A text is a sequence of binary decisions: a Huffman code walks to each word, or to an escape after which
the word is spelt bit by bit. Each decision has several predictors, counts of 0 and 1 in tables that are
addressed by a hash of a context: for words none, the word before, the two before, the one before that;
for letters one to four bytes before. Their log odds are summed with weights from the set that a gate
chooses by how often two of the contexts were seen. A last stage refines the mixture by how often such
predictions came true. Base-10 logarithms of the decisions' probabilities add up to the text's score.

Three passes over training documents: word counts; the tables' counts, over all but a share of them; and
over that share, mixing weights and refinement, learnt online from what the tables predict of texts that
they have not counted. Then the share is counted too. Counts are added up whole, and the share is dealt
to streams by a hash of its rows, each read in a fixed order, so scores do not depend on partitions.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.words import commonest, slices, span_hashes, word_bounds

#: Words with a code of their own; words whose counts are broadcast. Both lists are bounded.
CODED, LISTED = 160_000, 160_000
#: Slots of each predictor's table, as a power of two. Four tables of two counts are 32 MB.
#: The first has a slot of its own for each node of the code, in its lower half.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
PREDICTORS = 4
GATES = 32
STEPS = 33
#: Tokens whose decisions are handled at once.
WINDOW = 16_000
END = b" "
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_N1, _N2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Decisions that a task keeps before it counts them.
FLUSH = 1 << 22
#: One training document in this many teaches the weights. Rows of the share in a stream, about; tokens between two steps of the weights.
SHARE, STREAM, STEP = 16, 2_000, 1_000
#: Log odds are kept in steps of a thousandth or so: 14 bits, beside two for how often they were seen.
ODDS = ((np.arange(1 << 16) >> 2) - 8192).astype(np.float32) * np.float32(10.2 / 8192)
#: Steps of the mixture for each unit of log odds, from -12 to 12, at which probabilities are worked out.
FINE = 32
LEVELS = 24 * FINE + 1


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case, split at white space of ASCII."""
    return text.lower().split()


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol the place of its code, and all codes' node numbers and bits."""
    heap = [(n, k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    symbols = node = len(counts)
    parent, side = np.full(2 * symbols, -1, np.int64), np.zeros(2 * symbols, np.uint8)
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        side[b] = 1
        heapq.heappush(heap, (n + m, node))
        node += 1
    path, at = [], np.arange(symbols)
    while (parent[at] >= 0).any():
        path.append((np.where(at >= 0, parent[at], -1), side[at]))
        at = np.where(parent[at] >= 0, parent[at], node - 1)
    sizes = np.sum([up >= 0 for up, _ in path], axis=0, dtype=np.int64) if path else np.zeros(symbols, np.int64)
    starts = np.append(0, np.cumsum(sizes))
    nodes, bits = np.zeros(starts[-1], np.uint32), np.zeros(starts[-1], np.uint8)
    for k, (up, bit) in enumerate(path):
        has = np.flatnonzero(up >= 0)
        nodes[starts[has + 1] - 1 - k], bits[starts[has + 1] - 1 - k] = up[has], bit[has]
    return starts, nodes, bits


class Code(NamedTuple):
    """Symbols: listed words by rank below ``coded``, then the end, then the escape."""

    hashes: np.ndarray  # of the listed words, in order
    ranks: np.ndarray  # by hash
    counts: np.ndarray  # by rank
    coded: int
    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for words that are not listed."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)


def code_of(words: list[bytes], counts: list[int], ends: int, total: int, coded: int = CODED) -> Code:
    """words: the commonest first."""
    coded = min(coded, sum(n > 1 for n in counts))  # words seen once are spelt, as new ones will be
    own = counts[:coded]
    escape = max(1, total - ends - sum(own))
    sizes = np.array([len(w) for w in words], np.int64)
    stop = np.cumsum(sizes)
    hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), stop - sizes, stop) if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    return Code(hashes[order], order, np.array(counts, np.int64), coded, *huffman([*own, max(1, ends), escape]))


class Tokens(NamedTuple):
    doc: np.ndarray
    symbol: np.ndarray
    rank: np.ndarray  # -1 for the end, -2 for words that are not listed
    contexts: list[np.ndarray]
    data: np.ndarray
    starts: np.ndarray  # of the spelt words in data
    stops: np.ndarray
    spelt_doc: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray, code: Code) -> Tokens:
    """All tokens of some texts, with the hashes of their contexts; contexts don't reach into another text."""
    data = _LOWER[data]
    starts, stops, before = word_bounds(data, offsets)
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(before) + 1)
    ends = before[1:] + np.arange(rows)
    word = np.ones(len(doc), bool)
    word[ends] = False
    hashes = span_hashes(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    known = code.rank(hashes)
    rank, name = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.uint64)
    rank[word], name[word] = np.where(known < 0, -2, known), hashes
    symbol = np.where(rank == -1, code.coded, np.where((rank >= 0) & (rank < code.coded), rank, code.coded + 1))
    first = np.append(True, doc[1:] != doc[:-1])
    one = np.where(first, np.uint64(1), np.roll(name, 1))
    two = np.where(first | np.roll(first, 1), np.uint64(1), np.roll(name, 2))
    contexts = [np.zeros(len(name), np.uint64), one * _M1, (one * _M1 + two) * _M2, two * _M2]
    other = (known < 0) | (known >= code.coded)
    return Tokens(doc, symbol, rank, [_folded(c, k, 0) for k, c in enumerate(contexts)], data, starts[other], stops[other], doc[word][other])


class Decisions(NamedTuple):
    doc: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]  # for each predictor
    kind: int  # 0 words, 1 letters


def _folded(context: np.ndarray, k: int, kind: int) -> np.ndarray:
    x = context + np.uint64((4 * kind + k + 1) * int(_M2) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * _M1
    return (x >> np.uint64(32)).astype(np.uint32)


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """node: times ``_N1``."""
    x = (context ^ node) * _N2
    x ^= x >> np.uint32(15)
    return (x * _N1) >> np.uint32(32 - SLOT_BITS)


def decisions(t: Tokens, code: Code, window: int = WINDOW) -> Iterator[Decisions]:
    for a in range(0, len(t.symbol), window):
        s = t.symbol[a : a + window]
        size = code.starts[s + 1] - code.starts[s]
        place = np.repeat(code.starts[s] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        node = code.nodes[place] * _N1
        slots = [code.nodes[place], *(_slot(np.repeat(c[a : a + window], size), node) for c in t.contexts[1:])]
        yield Decisions(np.repeat(t.doc[a : a + window], size), code.bits[place], slots, 0)
    for a in range(0, len(t.starts), window):
        begin, size = t.starts[a : a + window], t.stops[a : a + window] - t.starts[a : a + window] + 1
        doc = np.repeat(t.spelt_doc[a : a + window], size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last = np.cumsum(size) - 1
        letters = t.data[np.minimum(np.repeat(begin, size) + place, len(t.data) - 1)]
        letters[last] = 32
        history, contexts = np.zeros(len(letters), np.uint64), []
        for k in range(1, PREDICTORS + 1):
            back = np.where(place >= k, np.roll(letters, k), 0).astype(np.uint64)
            history = history * np.uint64(257) + back + np.uint64(1)
            contexts.append(_folded(history * _M1, k, 1))
        for b in range(0, len(letters), 2 * window):
            x = letters[b : b + 2 * window].astype(np.uint64)
            shift = np.arange(8, dtype=np.uint64)
            node = ((np.uint64(1) << shift) | (x[:, None] >> (np.uint64(8) - shift))).ravel()
            bit = ((x[:, None] >> (np.uint64(7) - shift)) & np.uint64(1)).astype(np.uint8).ravel()
            node = node.astype(np.uint32) * _N1
            slots = [_slot(np.repeat(c[b : b + 2 * window], 8), node) for c in contexts]
            slots[0] |= np.uint32(SLOTS // 2)
            yield Decisions(np.repeat(doc[b : b + 2 * window], 8), bit, slots, 1)


_SEEN = np.searchsorted([1, 3, 12], np.arange(1024), "right").astype(np.uint8)  # how often: never, 1-2, 3-11, more


class Table(NamedTuple):
    """What the counts say, by predictor and slot: log odds and how often they were seen, packed in 16 bits."""

    packed: np.ndarray

    @property
    def odds(self) -> np.ndarray:
        return ODDS[self.packed]

    @property
    def seen(self) -> np.ndarray:
        return (self.packed & 3).astype(np.uint8)


def read(pairs: np.ndarray) -> np.ndarray:
    """Packed log odds and how often seen, of (n, 2) counts of any size."""
    zeros, ones = (pairs[:, bit].astype(np.float32) for bit in (0, 1))
    seen = _SEEN[np.minimum(zeros + ones, 1023).astype(np.int32)]
    odds = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    return ((np.clip(np.rint(odds * (8192 / 10.2)), -8191, 8191) + 8192).astype(np.uint16) << np.uint16(2)) | seen


def table_of(counts: np.ndarray) -> Table:
    """counts: (PREDICTORS, SLOTS, 2)."""
    return Table(np.stack([read(c) for c in counts]))


def evidence(d: Decisions, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, gate): each predictor's log odds and a constant."""
    x = np.empty((PREDICTORS + 1, len(d.bit)), np.float32)
    x[-1] = 0.3
    found = [np.take(own, slot, mode="clip") for own, slot in zip(table.packed, d.slots, strict=True)]
    for k, own in enumerate(found):
        np.take(ODDS, own, out=x[k], mode="clip")
    gate = (found[1] & np.uint16(3)) * np.uint16(4) + (found[2] & np.uint16(3)) + np.uint16(16 * d.kind)
    return x, gate.astype(np.intp)


def odds(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.zeros(x.shape[1], np.float32)
    own = np.ascontiguousarray(weights.T, np.float32)
    for k in range(len(x)):
        z += x[k] * np.take(own[k], gate)
    return np.clip(z, -12, 12, out=z)


def step_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


def final(refined: np.ndarray) -> np.ndarray:
    """(gates, levels, 2): base-10 logarithms of the chances of 0 and 1: half the mixture's, half what came true at its gate and step."""
    z = np.arange(LEVELS) / FINE - 12
    p = np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * refined[:, step_of(z)], 1e-5, 1 - 1e-5)
    return np.log10(np.stack([1 - p, p], axis=2))


def level(z: np.ndarray) -> np.ndarray:
    return ((z + np.float32(12)) * np.float32(FINE) + np.float32(0.5)).astype(np.intp)


class Learner:
    """Counts of one task."""

    def __init__(self) -> None:
        self.counts = np.zeros((PREDICTORS, SLOTS * 2), np.int32)
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def see(self, d: Decisions) -> None:
        self.waiting.append([slot * np.uint32(2) + d.bit for slot in d.slots])
        self.size += len(d.bit)
        if self.size >= FLUSH:
            self.count()

    def count(self) -> None:
        for k in range(PREDICTORS if self.waiting else 0):
            self.counts[k] += np.bincount(np.concatenate([w[k] for w in self.waiting]), minlength=SLOTS * 2).astype(np.int32)
        self.waiting, self.size = [], 0


class Mixer:
    """Mixing weights and refinement of one stream, learnt online."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self.weights, self.squares = np.full((GATES, PREDICTORS + 1), 0.3), np.zeros((GATES, PREDICTORS + 1))
        self.came = np.zeros((GATES, STEPS, 2), np.int64)

    def see(self, d: Decisions) -> None:
        """Predicts, then takes an adaptive gradient step with the mean error of each gate."""
        x, gate = evidence(d, self.table)
        z = odds(x, gate, self.weights)
        error = d.bit - 1 / (1 + np.exp(-z))
        many = np.maximum(np.bincount(gate, minlength=GATES), 1)
        for k in range(PREDICTORS + 1):
            g = np.bincount(gate, error * x[k], GATES) / many
            self.squares[:, k] += g * g
            self.weights[:, k] += 0.05 * g / np.sqrt(self.squares[:, k] + 1e-6)
        self.came += np.bincount((gate * STEPS + step_of(z)) * 2 + d.bit, minlength=self.came.size).reshape(self.came.shape)

    def cells(self) -> np.ndarray:
        """Whole numbers that add up over streams: weights, in millionths, times the decisions behind them; what came true."""
        many = self.came.sum(axis=(1, 2))
        return np.concatenate([np.rint(self.weights * 1e6).astype(np.int64).ravel() * np.repeat(many, PREDICTORS + 1), self.came.ravel()])


# --- Spark ---------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text counts as the word of one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(words_of(text.as_py() or b""))
            counts[END] += batch.num_rows
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


PARTS = 64


def packed(counts: np.ndarray) -> bytes:
    """32-bit counts, compressed by byte planes: nearly all are small."""
    return pa.compress(np.ascontiguousarray(counts.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def counted(docs: DataFrame, code) -> DataFrame:
    """(part, data): each task's counts of all decisions of its texts, in parts of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_ = Learner(), False
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                any_ = True
                for d in decisions(tokens(data, offsets, code.value), code.value):
                    own.see(d)
        if any_:
            own.count()
            for k, x in enumerate(map(packed, own.counts.reshape(PARTS, -1))):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x], pa.binary())], names=["part", "data"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, data binary")


def added(counts: DataFrame) -> DataFrame:
    """(part, data): the sums of whole counts over all tasks, one row a part."""
    size = PREDICTORS * SLOTS * 2 // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + unpacked(data, size)
        for k, x in sums.items():
            data = pa.compress(x.astype("<i8").tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    return counts.repartition(PARTS, "part").mapInArrow(add, "part int, data binary")


def tabled(*sums: DataFrame) -> Table:
    """The table of the sum of some ``added`` tables. What reaches the driver has a fixed size, however many texts there are."""
    size = PREDICTORS * SLOTS * 2 // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[k] = own.get(k, 0) + np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), "<i8")
        for k, x in own.items():
            data = pa.compress(read(x.reshape(-1, 2)).tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    rows = sums[0]
    for more in sums[1:]:
        rows = rows.union(more)
    found = rows.repartition(PARTS, "part").mapInArrow(run, "part int, data binary").toArrow()
    out = np.zeros((PARTS, size // 2), np.uint16)
    out[:] = read(np.zeros((1, 2)))[0]
    for k, data in zip(*found.to_pydict().values(), strict=True):
        out[k] = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint16)
    return Table(out.reshape(PREDICTORS, SLOTS))


def mixed(rows: DataFrame, code, table) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights and refinement, over all decisions of the texts; rows: text, draw (a hash of the row).

    The number of streams follows the number of rows, and each is read in a fixed order.
    """
    streams = max(1, rows.count() // STREAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = Mixer(table.value), None

        def out() -> pa.RecordBatch:
            x = own.cells()
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], names=["cell", "n"])

        for batch in batches:
            for k, stream in enumerate(batch.column(0).to_pylist()):
                if at is not None and stream != at:
                    yield out()
                    own = Mixer(table.value)
                at = stream
                for _, _, data, offsets in slices(batch.column(1)[k : k + 1]):
                    for d in decisions(tokens(data, offsets, code.value), code.value, STEP):
                        own.see(d)
        if at is not None:
            yield out()

    dealt = rows.select(F.pmod("draw", F.lit(streams)).alias("stream"), "text", "draw").repartition("stream").sortWithinPartitions("stream", "draw", "text")
    found = dealt.select("stream", "text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row per cell
    cells = np.zeros(GATES * (PREDICTORS + 1) + GATES * STEPS * 2)
    cells[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    w, came = np.split(cells, [GATES * (PREDICTORS + 1)])
    came = came.reshape(GATES, STEPS, 2)
    many = came.sum(axis=(1, 2))
    weights = np.where(many[:, None] > 0, w.reshape(GATES, -1) / 1e6 / np.maximum(many, 1)[:, None], 0.3)
    centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
    return weights, (came[:, :, 1] + 4 * centre) / (came.sum(axis=2) + 4)


def learnt(docs: DataFrame, code) -> tuple[Table, np.ndarray, np.ndarray]:
    """What the predictors' counts say, the mixing weights and the refinement; a document in SHARE teaches the weights before it is counted."""
    own = F.xxhash64(*(F.col(c) for c in ("doc_id", "text") if c in docs.columns))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), own.alias("draw"))
    apart = F.pmod("draw", F.lit(SHARE)) == 0
    most = materialise(added(counted(rows.where(~apart), code)), "counts")
    taught = rows.where(apart).withColumn("draw", F.xxhash64("draw"))
    sc = docs.sparkSession.sparkContext
    weights, refined = mixed(taught, code, sc.broadcast(tabled(most)))
    return tabled(most, added(counted(taught, code))), weights, refined


SCORED = "doc_id long, n_bytes long, n_tokens long, listed long, base double, score double, words array<binary>, counts array<int>"


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Training documents are those whose crc32(doc_id as text) mod 10 is not 0; a null id is not learnt
    from. Null and empty texts are one end token. With nothing to learn from, every word is spelt.
    Repeated rows each count and each give a row. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    taught = docs.where(training(F.col("doc_id")))
    counts = materialise(word_counts(taught), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    total, distinct, ends = sums["n"] or 0, sums["v"], sums["ends"] or 0
    # the empty output of tasks without documents counts an end zero times
    distinct -= int(distinct > 0 and ends == 0)
    found = commonest(counts.where(F.col("word") != F.lit(END)), LISTED).toArrow()  # at most LISTED rows
    listed = sorted(zip(found.column("n").to_pylist(), found.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    code = spark.sparkContext.broadcast(code_of([w for _, w in listed], [n for n, _ in listed], ends, total))
    model = spark.sparkContext.broadcast(learnt(taught, code))
    floor = math.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, refined = model.value
        chances = final(refined).ravel()
        c, logs = code.value, np.log10(code.value.counts + 0.1)
        end = math.log10(ends + 0.1)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                n, out = b - a, []
                score, t = np.zeros(n), tokens(data, offsets, c)
                for d in decisions(t, c):
                    x, gate = evidence(d, table)
                    at = (gate * LEVELS + level(odds(x, gate, weights))) * 2 + d.bit
                    score += np.bincount(d.doc, np.take(chances, at), n)
                listed = t.rank >= 0
                known = np.bincount(t.doc[listed], minlength=n)
                base = np.bincount(t.doc[listed], logs[t.rank[listed]], n) + end
                new = t.rank[t.rank != -1] == -2
                starts, stops, _ = word_bounds(t.data, offsets)
                owner, raw = t.doc[t.rank == -2], t.data.tobytes()
                rest = [raw[i:j] for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
                cut = np.searchsorted(owner, np.arange(n + 1)).tolist()
                rare = [Counter(rest[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b], *(pa.array(x) for x in (np.diff(offsets), np.bincount(t.doc, minlength=n), known, base, score)),
                        pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "listed", "base", "score", "words", "counts"],
                )

    scored = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    rest = (
        rare.join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("rare_known"))
    )
    return scored.drop("words", "counts").join(rest, "row", "left").select(
        "doc_id",
        (~training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("listed") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
