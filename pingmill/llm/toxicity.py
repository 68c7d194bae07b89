"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with evidence.

Terms are all lower-cased words of a bounded sample of labelled documents. A term's weight is its
inverse document frequency over all documents, times a floor plus the logarithm of how much commoner it
is among toxic examples: plain inverse frequencies find neighbours by topic, among which the few toxic
words of a text are lost. Labelled examples are indexed by term in blocks that keep each term's greatest
weight. For a document, a block's bound is the sum over its terms of their weights times those; the
blocks of the greatest bounds are scored first, and then, exactly, all whose bound is not below the
worst neighbour so far. Neighbours vote by similarity; votes become probabilities by a logistic fit on
examples that are left out of their own search.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise

#: Labelled documents that the examples are drawn from, by hash of the id, about.
SAMPLE = 4_000
NEIGHBOURS = 30
#: Examples of a block, blocks that are scored first, and examples with a term from which the term has bounds by block.
BLOCK, FIRST, LISTED = 64, 4, 16
#: A term in more than one example in this many has its weights in a row of all examples.
COMMON = 16
#: Weight of a term that tells nothing, and documents that a term counts to have beside those it was seen in.
FLOOR, SMOOTH = 0.05, 3.0
PREDICT = 0.3
#: Weight of the mean label beside the neighbours' similarities in a vote.
PRIOR = 0.5

#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased words, with empty ones at the ends, which are no terms."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)


def training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


class Index(NamedTuple):
    vocabulary: pa.Array
    idf: np.ndarray  # the terms' weights
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # where each term's postings begin
    docs: np.ndarray  # postings, by term, then example
    weights: np.ndarray
    rows: np.ndarray  # of each term in the tables by block, -1 for terms of few examples
    cuts: np.ndarray  # (rows, blocks + 1): where each term's postings of each block begin
    bounds: np.ndarray  # (rows, blocks): the greatest weight
    wide: np.ndarray  # of each term among the common ones, -1 for others
    dense: np.ndarray  # (common terms, blocks, BLOCK): all weights
    mean: float
    fit: np.ndarray  # of the calibration


class Packed:
    """A value that is broadcast compressed: an index is mostly small numbers and zeros."""

    def __init__(self, value: object):
        self.value = value

    def __getstate__(self) -> tuple[int, bytes]:
        data = pickle.dumps(self.value, 5)
        return len(data), pa.compress(data, "zstd", asbytes=True)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.value = pickle.loads(pa.decompress(state[1], state[0], "zstd", asbytes=True))


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(counts), np.int64)
    w = (1 + np.log([counts[t] for t in terms.tolist()])) * idf[terms] if len(terms) else np.zeros(0)
    return terms, w / max(math.sqrt(float(w @ w)), 1e-12)


def term_weights(examples: list[tuple[int, int, dict[int, int]]], n_terms: int, seen: np.ndarray | None = None, total: int | None = None) -> np.ndarray:
    """seen: documents with each term among ``total``; both are of the examples if not given."""
    df = np.bincount([t for e in examples for t in e[2]], minlength=n_terms)
    toxic = np.bincount([t for e in examples if e[1] for t in e[2]], minlength=n_terms)
    n, n_toxic = len(examples), sum(1 for e in examples if e[1])
    share = (n_toxic + 1) / (n + 2)
    lift = (toxic + SMOOTH * share) / (n_toxic + 2 * SMOOTH * share) / (df - toxic + SMOOTH * (1 - share)) * (n - n_toxic + SMOOTH * (1 - share))
    seen, total = (df, n) if seen is None else (seen, total)
    return (np.log((1 + total) / (1 + np.minimum(seen, total))) + 1) * (FLOOR + np.maximum(np.log(lift), 0))


def build(vocabulary: list[str], examples: list[tuple[int, int, dict[int, int]]], mean: float, seen: np.ndarray | None = None, total: int | None = None) -> Index:
    """examples: id, label, counts of vocabulary terms; those without any are left out."""
    examples = [e for e in examples if e[2]]
    n_terms = len(vocabulary)
    idf = term_weights(examples, n_terms, seen, total)
    vectors = [vector(e[2], idf) for e in examples]
    # like examples share blocks, so that bounds are tight: they are ordered by their heaviest terms
    order = sorted(range(len(examples)), key=lambda k: (vectors[k][0][np.argsort(-vectors[k][1], kind="stable")[:8]].tolist(), examples[k][0]))
    term = np.concatenate([vectors[k][0] for k in order]) if order else np.zeros(0, np.int64)
    weight = np.concatenate([vectors[k][1] for k in order]) if order else np.zeros(0)
    doc = np.repeat(np.arange(len(order)), [len(vectors[k][0]) for k in order])
    n_blocks = max(1, -(-len(order) // BLOCK))
    by = np.lexsort((doc, term))
    term, weight, doc = term[by], weight[by], doc[by]
    many = np.bincount(term, minlength=n_terms)
    listed = np.flatnonzero(many >= LISTED)
    rows = np.full(n_terms, -1, np.int64)
    rows[listed] = np.arange(len(listed))
    cuts = np.searchsorted(term * n_blocks + doc // BLOCK, listed[:, None] * n_blocks + np.arange(n_blocks + 1)).astype(np.int32)
    bounds, has = np.zeros((len(listed), n_blocks), np.float32), rows[term] >= 0
    # rounded up, so that a bound is never too small
    np.maximum.at(bounds, (rows[term[has]], doc[has] // BLOCK), np.nextafter(weight[has].astype(np.float32), np.float32(2)))
    common = np.flatnonzero(many > max(LISTED, len(order) // COMMON))
    wide = np.full(n_terms, -1, np.int64)
    wide[common] = np.arange(len(common))
    dense = np.zeros((len(common), n_blocks * BLOCK), np.float32)
    has = wide[term] >= 0
    dense[wide[term[has]], doc[has]] = weight[has]
    return Index(
        pa.array(vocabulary, pa.string()), idf, np.array([examples[k][0] for k in order], np.int64), np.array([examples[k][1] for k in order], float),
        np.append(0, np.cumsum(many)), doc, weight, rows, cuts, bounds, wide, dense.reshape(len(common), n_blocks, BLOCK), mean, np.zeros(3),
    )


def _ranges(low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from each ``low`` to ``high``, and the weight of each."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(weights, n)


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, without: int | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` examples of the greatest cosine, exactly; ties go to the smaller position."""
    if not len(terms) or not len(index.ids):
        return np.zeros(0, np.int64), np.zeros(0)
    row, n_blocks = index.rows[terms], index.bounds.shape[1]
    few = row < 0
    at, w = _ranges(index.starts[terms[few]], index.starts[terms[few] + 1], weights[few])
    rare, rare_score = index.docs[at], w * index.weights[at]
    # with room for the rounding of sums
    bound = (weights[~few].astype(np.float32) @ index.bounds[row[~few]] + np.bincount(rare // BLOCK, rare_score, n_blocks)) * (1 + 1e-5)
    score = np.zeros(n_blocks * BLOCK)
    score[: len(index.ids)] += np.bincount(rare, rare_score, len(index.ids))
    wide = index.wide[terms]
    common, common_weight = wide[wide >= 0], weights[wide >= 0].astype(np.float32)
    some = ~few & (wide < 0)
    row, some_weight, some = row[some], weights[some], terms[some]
    known = np.zeros(n_blocks, bool)

    def visit(blocks: np.ndarray) -> None:
        known[blocks] = True
        if len(blocks) == n_blocks:
            at, w = _ranges(index.starts[some], index.starts[some + 1], some_weight)
            more = common_weight @ index.dense.reshape(-1, n_blocks * BLOCK)[common]
        else:
            at, w = _ranges(index.cuts[row[:, None], blocks].ravel(), index.cuts[row[:, None], blocks + 1].ravel(), np.repeat(some_weight, len(blocks)))
            more = np.zeros((n_blocks, BLOCK), np.float32)
            more[blocks] = (common_weight @ index.dense[common[:, None], blocks].reshape(len(common), len(blocks) * BLOCK)).reshape(-1, BLOCK)
        np.add(score, more.ravel(), out=score)
        score[: len(index.ids)] += np.bincount(index.docs[at], w * index.weights[at], len(index.ids))

    def worst() -> float:
        own = score[np.repeat(known, BLOCK)]
        return float(np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else 0.0

    k += without is not None  # one more place, for an example that is left out
    # blocks with like bounds are all scored at once
    if n_blocks > 2 * FIRST and bound.max() > 2 * np.median(bound):
        visit(np.argpartition(-bound, FIRST)[:FIRST])
    rest = np.flatnonzero(~known & (bound > 0) & (bound >= worst()))
    if 3 * len(rest) > n_blocks:  # whole rows are faster than many blocks
        score[:] = 0
        score[: len(index.ids)] += np.bincount(rare, rare_score, len(index.ids))
        visit(np.arange(n_blocks))
    elif len(rest):
        visit(rest)
    score = np.where(np.repeat(known, BLOCK), score, 0)[: len(index.ids)]
    if without is not None:
        score[index.ids == without] = 0
        k -= 1
    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
    hit = np.flatnonzero((score >= least) & (score > 0))
    best = hit[np.lexsort((hit, -score[hit]))[:k]]
    return best, score[best]


def evidence(index: Index, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The vote as log odds, the number of known terms' logarithm, and the neighbours with their similarities."""
    best, score = nearest(index, terms, weights, without)
    vote = (float(score @ index.labels[best]) + PRIOR * index.mean) / (float(score.sum()) + PRIOR)
    vote = min(max(vote, 1e-4), 1 - 1e-4)
    return math.log(vote / (1 - vote)), math.log1p(len(terms)), best, score


def calibration(x: np.ndarray, y: np.ndarray, mean: float, steps: int = 30) -> np.ndarray:
    """Logistic weights (constant, vote, terms) by Newton's method, slightly held to the votes as they are."""
    base = np.array([0.0, 1.0, 0.0])
    fit, x = base.copy(), np.column_stack([np.ones(len(x)), x])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        fit = fit - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3), x.T @ (p - y) + (fit - base))
    return fit


def probability(index: Index, vote: float, matched: float) -> float:
    if not matched:
        return index.mean / 10  # no term of the vocabulary at all
    z = float(index.fit @ np.array([1.0, vote, matched]))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def counted(words: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each term of each row, in order."""
    coded = words.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    key, n = np.unique(row[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), n


def vectors(words: pa.ListArray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``vector`` of each row."""
    row, term, n = counted(words, index.vocabulary)
    w = (1 + np.log(n)) * index.idf[term]
    w /= np.maximum(np.sqrt(np.bincount(row, w * w, len(words))), 1e-12)[row]
    at = np.searchsorted(row, np.arange(len(words) + 1)).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield term[a:b], w[a:b]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """Fits the index on labelled documents that ``training`` allows, about ``sample`` of them by hash of the id.

    Document frequencies of the terms are of all documents.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.count()
    share = F.lit(min(1.0, sample / max(n, 1)) * 1_000_000)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    rows = picked.select(F.col("doc_id").cast("long"), "toxic", words_of(F.col("text")).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(filter(None, w)) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    found = rows.mapInArrow(count, "doc_id long, toxic int, terms array<string>, counts array<int>").toArrow().to_pylist()  # the sample
    found.sort(key=lambda r: r["doc_id"])
    mean = (sum(r["toxic"] for r in found) + 1) / (len(found) + 20)
    vocabulary = sorted({t for r in found for t in r["terms"]})
    shared = spark.sparkContext.broadcast(Packed(pa.array(vocabulary, pa.string())))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.value
        seen = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            seen[-1] += batch.num_rows
            seen[:-1] += np.bincount(counted(batch.column(0), known)[1], minlength=len(known))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    sums = texts.select(words_of(F.col("text")).alias("words")).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the sample
    seen = np.zeros(len(vocabulary) + 1, np.int64)
    seen[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    numbers = {t: k for k, t in enumerate(vocabulary)}
    index = build(vocabulary, [(r["doc_id"], r["toxic"], {numbers[t]: n for t, n in zip(r["terms"], r["counts"], strict=True)}) for r in found], mean, seen[:-1], int(seen[-1]))
    own = spark.sparkContext.broadcast(Packed(index))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = own.value.value
            out = [evidence(index, *v, without=i)[:2] for i, v in zip(batch.column(0).to_pylist(), vectors(batch.column(2), index), strict=True)]
            votes = np.array(out).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes[:, 0]), pa.array(votes[:, 1])], names=["doc_id", "toxic", "vote", "terms"])

    votes = rows.mapInArrow(vote, "doc_id long, toxic int, vote double, terms double").where("terms > 0").orderBy("doc_id").toArrow()
    own.destroy()
    x = np.column_stack([votes.column("vote").to_numpy(), votes.column("terms").to_numpy()])
    return index._replace(fit=calibration(x, votes.column("toxic").to_numpy().astype(float), mean))


RESULT = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>"


def score(docs: DataFrame, index: Index) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours, similarities.

    Only the text is an input of a score. Null and empty texts have no terms and score low, like every
    text without a word of any example. Of rows repeated under one id, an example has the greatest text
    and label; all are scored. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Packed(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, scores, ids, similar = shared.value.value, [], [], []
            for terms, weights in vectors(batch.column(2), index):
                vote, matched, best, close = evidence(index, terms, weights)
                scores.append(probability(index, vote, matched))
                ids.append(index.ids[best].tolist())
                similar.append(close.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(similar, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "neighbours", "similarities"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out"), words_of(F.col("text")).alias("words"))
    return rows.mapInArrow(run, RESULT)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``score`` by an index fitted on the labels; without labels all texts score low."""
    return score(docs, fit(docs, labels, sample))
