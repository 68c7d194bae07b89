"""Document quality by co-training a text view and a metadata view.

The text view sees the content alone: classes of characters, shapes of words, repetition. The metadata
view sees the language, the source and the length. Each starts from the labelled rows. In each round
each view labels the unlabelled rows that it is surest of, both ways, and the other view learns them.
At the end both are calibrated on labelled rows that neither has learnt, and a logistic fit of the two
calibrated log odds gives the score of every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.words import span_hashes, slices, word_bounds

#: Rows drawn by hash of the id, about: labelled ones, and unlabelled ones for pseudo-labels.
LABELLED, UNLABELLED = 12_000, 12_000
ROUNDS = 3
#: Share of the unlabelled rows that a view labels in a round, and how sure it must be.
PORTION, SURE = 0.1, 0.95
#: One labelled row in this many is left for calibration.
CALIBRATION = 4
REJECT = 0.5
BUCKETS = 64

# character classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 other bytes, then a class for each sign
_CLASS = np.full(256, 4, np.int64)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS[list(SIGNS)] = np.arange(5, 5 + len(SIGNS))
CLASSES = 5 + len(SIGNS)
CONTENT = CLASSES + CLASSES + CLASSES + 12


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, CONTENT) features of whole texts."""
    rows = len(offsets) - 1
    out = np.zeros((rows, CONTENT))
    if not len(data):
        return out
    cls = _CLASS[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out[:, :CLASSES] = np.sqrt(np.bincount(row * CLASSES + cls, minlength=rows * CLASSES).reshape(rows, CLASSES) / size)
    starts, ends, before = word_bounds(data, offsets)
    words = np.diff(before)
    if not len(starts):
        return out
    many = np.maximum(words, 1)
    owner = np.repeat(np.arange(rows), words)
    for at, edge in ((CLASSES, cls[starts]), (2 * CLASSES, cls[ends - 1])):
        out[:, at : at + CLASSES] = np.sqrt(np.bincount(owner * CLASSES + edge, minlength=rows * CLASSES).reshape(rows, CLASSES) / many[:, None])
    hashes = span_hashes(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.zeros(len(hashes), bool)
    pairs[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    length = (ends - starts).astype(float)
    upper = np.append(0, np.cumsum(cls == 1))
    caps = (upper[ends] - upper[starts]) >= np.maximum(2, 0.5 * length)
    by_word = np.lexsort((hashes, owner))
    h, o = hashes[by_word], owner[by_word]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, o[new], runs)
    distinct = np.bincount(o[new], minlength=rows)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, x.astype(float), rows) / many

    ln = np.bincount(row, data == 10, rows) + 1
    extra = (
        np.log1p(words), np.log1p(words) ** 2 / 10, mean(length) / 10, np.sqrt(mean(length**2)) / 10, mean(same), mean(pairs), mean(caps),
        distinct / many, most / many, np.log1p(words / ln), (words < 5).astype(float), np.log1p(many / np.maximum(distinct, 1) * mean(same)),
    )
    out[:, 3 * CLASSES :] = np.column_stack(extra)
    return out


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """(rows, 2 * BUCKETS + 8) features of the columns beside the text; null is a value like others."""
    out = np.zeros((len(lang), 2 * BUCKETS + 8))
    for k, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[k, zlib.crc32(f"l{a}".encode()) % BUCKETS] = 1
        out[k, BUCKETS + zlib.crc32(f"s{b}".encode()) % BUCKETS] = 1
        out[k, 2 * BUCKETS + min(7, int(math.log10(1 + max(0, n or 0)) * 1.5))] = 1
    return out


class Logistic:
    """Weighted ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 15):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        weight = np.ones(len(x)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        keep = ridge * np.eye(z.shape[1])
        keep[-1, -1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + keep @ self.w
            self.w -= np.linalg.solve(z.T @ (z * (weight * (p * (1 - p) + 1e-6))[:, None]) + keep, grad)

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.ones(len(x))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def cotrain(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, calibrate: np.ndarray, rounds: int = ROUNDS, portion: float = PORTION, sure: float = SURE):
    """The two fitted views, their calibrations and the fit that combines them; labels: 0, 1, or -1 for none."""
    own = (labels >= 0) & ~calibrate
    taught = [np.full(len(labels), -1.0), np.full(len(labels), -1.0)]  # pseudo-labels for each view

    def learn(v: int) -> Logistic:
        rows = own | (taught[v] >= 0)
        y = np.where(own, labels, taught[v])[rows]
        return Logistic(views[v][rows], y, np.where(own[rows], 1.0, 0.5))

    models = [learn(0), learn(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = _probability(models[v].odds(views[v]))
            free = np.flatnonzero((labels < 0) & (taught[1 - v] < 0))
            most = int(portion * (labels < 0).sum() / 2)
            for y, confidence in ((1.0, p[free]), (0.0, 1 - p[free])):
                pick = free[np.argsort(-confidence, kind="stable")[:most]]
                pick = pick[(p[pick] if y else 1 - p[pick]) >= sure]
                taught[1 - v][pick] = y
        models = [learn(0), learn(1)]
    scales = [Logistic(models[v].odds(views[v][calibrate])[:, None], labels[calibrate], ridge=0.1) for v in (0, 1)]
    both = np.column_stack([scales[v].odds(models[v].odds(views[v][calibrate])[:, None]) for v in (0, 1)])
    return models, scales, Logistic(both, labels[calibrate], ridge=1.0)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(docs: DataFrame) -> DataFrame:
    """The columns that the views read; a missing one counts as null."""
    kinds = {"doc_id": "long", "n_chars": "double"}
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED):
    """Fits on about ``labelled`` and ``unlabelled`` rows, drawn by hash of the id. None if a class has no labels.

    Repeated labels count once; an id labelled both 0 and 1 teaches nothing.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(*(f("quality").cast("int").alias(k) for f, k in ((F.min, "quality"), (F.max, "other"))))
    usable = marks.where("quality = other").drop("other")
    n, n_docs = usable.count(), docs.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = usable.where(draw < min(1.0, labelled / max(n, 1)) * 1_000_000)
    free = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("free")), F.lit(1_000_000)) < min(1.0, unlabelled / max(n_docs, 1)) * 1_000_000)
    rows = _read(docs).join(F.broadcast(chosen), "doc_id").unionByName(_read(free).withColumn("quality", F.lit(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _views(batch)
            both = np.column_stack(x).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array([r.tobytes() for r in both], pa.binary())], names=["doc_id", "quality", "x"])

    # a labelled row rather than a free one of the same id
    picked = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.max(F.struct("quality", "x")).alias("r"))
    found = picked.select("doc_id", "r.*").orderBy("doc_id").toArrow()
    y = found.column("quality").to_numpy().astype(float)
    ids = found.column("doc_id").to_pylist()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), CONTENT + 2 * BUCKETS + 8).astype(float)
    calibrate = np.array([zlib.crc32(f"c{i}".encode()) % CALIBRATION == 0 for i in ids], bool) & (y >= 0)
    for rows in (calibrate, (y >= 0) & ~calibrate):
        if len(set(y[rows].tolist())) < 2:
            return None
    return cotrain((x[:, :CONTENT], x[:, CONTENT:]), y, calibrate)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [content(data, offsets) for _, _, data, offsets in slices(batch.column(1))]
    return np.concatenate(parts) if parts else np.zeros((0, CONTENT)), metadata(*(batch.column(k).to_pylist() for k in (2, 3, 4)))


def score(docs: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """One row per document: doc_id, p_content, p_metadata, score, predicted, kept.

    score is the chance that the quality label is 1; below 0.5 a document is rejected. Null texts count
    as empty. Without labels of both classes every score is 1, so that nothing is rejected unjudged.
    Repeated rows each give a row; an empty table gives no rows; other columns are not read.
    """
    model = fit(docs, labels, **sizes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = _views(batch)
            if shared.value is None or not batch.num_rows:
                p = [np.ones(batch.num_rows)] * 3
            else:
                models, scales, both = shared.value
                odds = [s.odds(m.odds(x)[:, None]) for m, s, x in zip(models, scales, views, strict=True)]
                p = [_probability(o) for o in (*odds, both.odds(np.column_stack(odds)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in p)], names=["doc_id", "p_content", "p_metadata", "score"])

    out = _read(docs).mapInArrow(run, "doc_id long, p_content double, p_metadata double, score double")
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int")).withColumn("kept", F.col("score") >= REJECT)
