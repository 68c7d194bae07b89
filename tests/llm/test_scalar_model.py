"""The mixed score of a text against one bit at a time in plain Python: no tables of slots, no batches of numpy."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pingmill.llm import context_mixing


def codes(weights):
    """(node, bit) from the root for each symbol; the lighter of two, then the older, is the side of 0."""
    heap = [(n, k, k) for k, n in enumerate(weights)]
    heapq.heapify(heap)
    out, node = defaultdict(list), len(weights)
    held = {k: [k] for k in range(len(weights))}
    while len(heap) > 1:
        for bit in (0, 1):
            n, _, child = heapq.heappop(heap)
            total = n if not bit else total + n
            for symbol in held[child]:
                out[symbol].insert(0, (node, bit))
            held.setdefault(node, []).extend(held[child])
        heapq.heappush(heap, (total, node, node))
        node += 1
    return out


class Scalar:
    def __init__(self, texts):
        counts = Counter(w for t in texts for w in t.lower().split())
        coded = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1]
        self.symbol = {w: k for k, w in enumerate(coded)}
        escape = max(1, sum(counts.values()) - sum(counts[w] for w in coded))
        self.codes = codes([*(counts[w] for w in coded), max(1, len(texts)), escape])
        self.counts = defaultdict(lambda: [0, 0])
        self.weights, self.squares, self.came = {}, defaultdict(float), Counter()

    def decisions(self, text):
        """Two blocks, words and letters, of (contexts, bit, kind)."""
        words, letters = [], []
        named = text.lower().split()
        for k, w in enumerate([*named, None]):
            one = named[k - 1] if k > 0 else 1
            two = named[k - 2] if k > 1 else 1
            end = len(self.symbol)
            for node, bit in self.codes[end if w is None else self.symbol.get(w, end + 1)]:
                words.append(([(0, node), (1, node, one), (2, node, one, two), (3, node, two)], bit, 0))
            if w is not None and w not in self.symbol:
                spelt = w + b" "
                for place, letter in enumerate(spelt):
                    before = [spelt[place - k] if place >= k else 0 for k in range(1, 5)]
                    for shift in range(8):
                        node = 1 << shift | letter >> 8 - shift
                        letters.append(([("spelt", k, node, *before[: k + 1]) for k in range(4)], letter >> 7 - shift & 1, 1))
        return [x for x in (words, letters) if x]

    def count(self, text):
        for block in self.decisions(text):
            for contexts, bit, _ in block:
                for c in contexts:
                    self.counts[c][bit] += 1

    def evidence(self, contexts, kind):
        x, seen = [], []
        for c in contexts:
            zeros, ones = self.counts.get(c, (0, 0))
            x.append(round(math.log((ones + 0.4) / (zeros + 0.4)) * 8192 / 10.2) * 10.2 / 8192)
            seen.append(sum(zeros + ones >= n for n in (1, 3, 12)))
        gate = 16 * kind + 4 * seen[1] + seen[2]
        w = self.weights.get(gate, [0.3] * 5)
        x.append(0.3)
        return x, gate, max(-12, min(12, sum(a * b for a, b in zip(x, w, strict=True))))

    def learn(self, text):
        for block in self.decisions(text):
            sums, many = defaultdict(float), Counter()
            for contexts, bit, kind in block:
                x, gate, z = self.evidence(contexts, kind)
                many[gate] += 1
                self.came[gate, self.step(z), bit] += 1
                for k, value in enumerate(x):
                    sums[gate, k] += (bit - 1 / (1 + math.exp(-z))) * value
            for (gate, k), total in sums.items():
                g = total / many[gate]
                self.squares[gate, k] += g * g
                self.weights.setdefault(gate, [0.3] * 5)[k] += 0.05 * g / math.sqrt(self.squares[gate, k] + 1e-6)

    @staticmethod
    def step(z):
        return max(0, min(32, round(2 * z) + 16))

    def score(self, text):
        total = 0.0
        for block in self.decisions(text):
            for contexts, bit, kind in block:
                _, gate, z = self.evidence(contexts, kind)
                z = int((z + 12) * 32 + 0.5) / 32 - 12
                s = self.step(z)
                zeros, ones = (self.came[gate, s, b] for b in (0, 1))
                came = (ones + 4 / (1 + math.exp(-(s - 16) / 2))) / (zeros + ones + 4)
                p = max(1e-5, min(1 - 1e-5, 0.5 / (1 + math.exp(-z)) + 0.5 * came))
                total += math.log10(p if bit else 1 - p)
        return total


def test_scores_equal_one_bit_at_a_time(spark):
    rnd = random.Random(12)
    pairs = {w: [rnd.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    texts = []
    for _ in range(150):
        w = ["a"]
        while len(w) < rnd.randint(2, 30):
            w.append(rnd.choice(pairs[w[-1]]))
        texts.append(" ".join(x.upper() if rnd.random() < 0.1 else x for x in w) + rnd.choice(["", "\n", " Zoë", " new" + str(len(texts))]))
    texts += ["", None, "only new words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    read = docs.selectExpr("doc_id", "encode(coalesce(text, ''), 'UTF-8') t", "xxhash64(doc_id, text) h").selectExpr("doc_id", "t", f"pmod(h, {context_mixing.SHARE}) = 0 apart", "xxhash64(h) draw")
    rows = sorted(((r.draw, bytes(r.t), r.doc_id, r.apart) for r in read.collect()))
    taught = [r for r in rows if zlib.crc32(str(r[2]).encode()) % 10]
    model = Scalar([t for _, t, _, _ in taught])
    for _, t, _, apart in taught:
        if not apart:
            model.count(t)
    apart = [t for _, t, _, a in taught if a]
    for t in apart:
        model.learn(t)
    for t in apart:
        model.count(t)
    assert apart and len(apart) < len(taught)
    got = {r.doc_id: r.score for r in context_mixing.lm_scores(docs).collect()}
    want = {i: model.score(t) for _, t, i, _ in rows}
    assert got == pytest.approx(want, rel=2e-3, abs=1e-3)
