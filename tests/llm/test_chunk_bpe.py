"""Chunked BPE against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pingmill.llm import chunk_bpe
from pingmill.llm.words import slices

PARTS = ["a", " ", "  ", "\n", "'", "'re", "'ll", "é", "中文", "　", "\xa0", "<|endoftext|>", "<|endo", "1", "23", "!?", "the ", "\t", "🎉", " ", " x"]
FIELDS = "doc_id long, text string"


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def made(seed, parts, texts=40, size=2500):
    draw = random.Random(seed)
    return ["".join(draw.choices(parts, k=draw.randint(0, size))) for _ in range(texts)]


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("parts", [PARTS, PARTS[:9], ["a"], [" ", "x"], ["'", "r", "e", "l"], [" ", "\n"]])
def test_repaired_joins_give_the_tokens_of_the_whole_text(parts):
    encoding, vocabulary = chunk_bpe._loaded(None, None)
    texts, tokenizer = made(3, parts) + [None, "", parts[0] * 30_000], library()
    for a, b, data, offsets in slices(pa.array(texts, pa.string()), 1 << 16):
        assert len(chunk_bpe.cuts(data, offsets)) >= (len(data) - 1) // chunk_bpe.MOST
        ids, at = chunk_bpe.encode_block(data, offsets, lambda t: encoding.encode(t, allowed_special="all"), vocabulary.lengths)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[a:b]]


def test_cuts_follow_content_and_keep_characters_whole():
    body = "".join(random.Random(5).choices("abcdefgh éü", k=60_000)).encode()
    for lead in (b"", b"another beginning of the text "):
        data = np.frombuffer(lead + body, np.uint8)
        found = chunk_bpe.cuts(data, np.array([0, len(data)])) - len(lead)
        if not lead:
            first = set(found.tolist())
    assert len(first & set(found.tolist())) > 0.95 * len(first) > 50
    assert all(body[k] & 0xC0 != 0x80 for k in first)


def test_query_on_whole_documents_and_defined_cases(spark):
    shared = " ".join(random.Random(7).choices(["alpha", "beta", "gamma", "delta", "l'été", "x1"], k=3000))
    texts = [shared, shared, "lead " + shared + " tail", None, "", "<|endoftext|>" + shared, *made(8, PARTS, 10)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (0, shared), (0, "other text of one id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{FIELDS}, n_tokens int, ids string").repartition(3)
    got = sorted(map(str, chunk_bpe.encode_decode(df).collect()))
    tokenizer = library()
    want = sorted(str(spark.createDataFrame([(d, *expected(tokenizer, t))], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").first()) for d, t in rows)
    assert got == want
    assert chunk_bpe.encode_decode(df.where("doc_id > 99")).count() == 0


def test_common_chunks_are_known_before_blocks(spark):
    shared = " ".join(random.Random(9).choices(["alpha", "beta", "gamma", "delta"], k=20_000))
    top = chunk_bpe.shared_chunks(spark.createDataFrame([(k, f"{k} {shared}") for k in range(6)], FIELDS))
    chunks = [c.as_py().decode() for c in top.column("chunk")]
    encoding, _ = chunk_bpe._loaded(None, None)
    assert len(chunks) > 10 and all(c in shared for c in chunks)
    assert all(np.frombuffer(i.as_py(), "<u4").tolist() == encoding.encode(c) for c, i in zip(chunks, top.column("ids"), strict=True))
