"""Token alignment against plain loops over the libraries' tokens of whole texts."""

import hashlib
import os
import random
from collections import Counter

import pytest

from pingmill.llm import alignment

SF = "/root/testdata/sf0.001"
PARTS = ["a", " ", "  ", "\n", "'", "'re", "é", "中文", "　", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "1", "23", "!?", "the ", "\t", "🎉", " x", "ing", "\x00", "﻿"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def characters():
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            table[chr(more)] = b
            more += 1
    return table


def brute(texts):
    """Rows in the order of ``texts``: tokens as byte ranges, links by comparing ranges, counts by dictionaries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = characters()

    def ranges(ids, pieces):
        out, at = [], 0
        for k, p in zip(ids, pieces, strict=True):
            out.append((k, at, at + len(p)))
            at += len(p)
        return out

    found = []
    for text in texts:
        rows = None
        if text:
            code = a_side.encode(" " + text, add_special_tokens=False)
            a_pieces = [bytes(of[c] for c in t) for t in code.tokens]
            b_ids = b_side.encode(text)
            b_pieces = [bytes([int(p[3:5], 16)]) if b_side.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b_side.id_to_piece(k)) for k in b_ids)]
            if b"".join(a_pieces) == b"".join(b_pieces) == (" " + text).encode():
                rows = ranges(code.ids, a_pieces), ranges(b_ids, b_pieces)
        if rows is None:
            found.append(None)
            continue
        a, b = rows
        links, j = [], 0
        for k, x, y in a:
            while b[j][2] <= x:
                j += 1
            i = j
            while i < len(b) and b[i][1] < y:
                links.append((k, b[i][0]))
                i += 1
        groups, at_a, at_b = [], 0, 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            side = []
            for tokens, at in ((a, at_a), (b, at_b)):
                side.append([k for k, _, e in tokens[at:] if e <= end])
            groups.append("|".join(",".join(map(str, s)) for s in side))
            at_a, at_b = at_a + len(side[0]), at_b + len(side[1])
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    empty = (0, 0, 0, 0, 0, 0, "")
    return [
        (*f[:3], len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) if f else empty
        for f in found
    ]


def texts():
    draw = random.Random(4)
    made = ["".join(draw.choices(PARTS, k=draw.randint(1, 400))) for _ in range(25)]
    return [None, "", " ", "  ", "a ", "▁", "has ▁ inside", "\n", " x" * 300, "x" * 5000, "word " * 800, made[0], *made]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 30, 0])
def test_rows_equal_plain_loops_whatever_is_broadcast(spark, pairs):
    own = texts()
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(own)], "doc_id long, text string, key int, code string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.token_alignment(df, pairs=pairs).collect()}
    assert got == dict(enumerate(brute(own)))


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "the same"), (1, "the same"), (1, "not the same"), (None, "no id"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in alignment.token_alignment(df).collect())
    assert got == sorted((str(d), *b) for (d, _), b in zip(rows, brute([t for _, t in rows]), strict=True))
    assert alignment.token_alignment(df.limit(0)).count() == 0


def test_tasks_that_hand_pairs_over_early_count_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    monkeypatch.setattr(alignment, "UNITS", 20)
    monkeypatch.setattr(alignment, "BATCH", 300)
    own = texts()
    seen = Counter()
    for batch in _run_here(own):
        for code, n in zip(batch.column("code").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if code is not None:
                seen[code >> 32, code & 0xFFFFFFFF] += n
    monkeypatch.undo()
    whole = Counter()
    for batch in _run_here(own):
        for code, n in zip(batch.column("code").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if code is not None:
                whole[code >> 32, code & 0xFFFFFFFF] += n
    assert seen == whole and len(whole) > 100


def _run_here(own):
    import pyarrow as pa

    alignment._sides.cache_clear()

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string())], names=["key", "doc_id", "text"])
            return list(run(iter([batch])))

    return alignment.aligned_tokens(Frame())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_on_the_smallest_table(spark):
    from pingmill.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SF).collect()}
    assert got == dict(zip(docs, brute(list(docs.values())), strict=True))
