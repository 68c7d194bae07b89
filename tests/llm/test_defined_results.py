"""Results that hang on nothing but the rows: partitions, ids, repeated and null keys."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pingmill.llm import bpe, chosen_path, context_mixing, exact_dedup, html_extract, media, packing, quality, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, junk=False, toxic=False):
    words = [f"{rnd.choice('abc')}{rnd.choice('defg')}{rnd.randrange(60)}" for _ in range(n)] + ["vile", "vilest"] * toxic
    return " ".join(w.upper() + "!!" if junk else w for w in words)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        junk, toxic = i % 4 == 0, i % 5 == 0
        text = prose(rnd, 50, junk, toxic)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        marks.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_scores_do_not_depend_on_partitions(labelled):
    docs, labels = labelled
    for score in (lambda d: quality.score(d, labels), context_mixing.lm_scores, lambda d: toxicity.toxicity(d, labels).drop("neighbours", "similarities")):
        one, many = ({r.doc_id: r.score for r in score(docs.repartition(n)).collect()} for n in (1, 13))
        assert one.keys() == many.keys() and np.allclose([one[i] for i in one], [many[i] for i in one], rtol=0, atol=1e-6)


def test_ids_are_no_input_of_a_toxicity_score(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, labels)
    own = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    other = {r.doc_id - 10_000: r.score for r in toxicity.score(docs.selectExpr("doc_id + 10000 as doc_id", "text"), index).collect()}
    assert own == other


def test_toxicity_query_against_brute_force(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, labels)
    taught = {r.doc_id: r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    number = {t: k for k, t in enumerate(index.vocabulary.to_pylist())}
    assert sorted(index.ids.tolist()) == sorted(taught)

    def vector(text):
        w = {t: (1 + np.log(n)) * index.idf[number[t]] for t, n in Counter(text.lower().replace("!!", "").split()).items() if t in number}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    examples = {i: vector(t) for i, t in taught.items()}
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    for row in docs.where("doc_id % 20 = 3").collect():
        own = vector(row.text)
        brute = sorted((sum(x * e.get(t, 0) for t, x in own.items()) for e in examples.values()), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(got[row.doc_id].similarities, [x for x in brute if x > 0], atol=1e-6) and got[row.doc_id].neighbours


def test_added_tokens_are_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    whole = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = packing._encoding(None)
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "plain"):
        assert own.encode(text, allowed_special="all") == whole.encode(text, add_special_tokens=False).ids


def test_the_bound_of_packing_is_a_bound():
    rnd = random.Random(3)
    for _ in range(100):
        lengths = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(1, 40)))
        plan = packing.best_fit(dict(lengths), 100)
        packed = Counter()
        for times, items in plan:
            assert sum(x * n for x, n in items) <= 100
            for x, n in items:
                packed[x] += times * n
        assert packed == lengths and packing.lower_bound(dict(lengths), 100) <= sum(t for t, _ in packing.complete_bins(dict(lengths), 100)) <= sum(t for t, _ in plan)


def test_repeated_and_null_ids_give_a_row_each(spark):
    rnd = random.Random(5)
    long = prose(rnd, 40)
    rows = [(1, long), (1, long), (1, long + " more"), (None, long), (None, None), (None, ""), (2, "é" * 40 + long), (3, "x " + long + " y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).repartition(4)
    for f in (exact_dedup.exact_copies, bpe.encode_decode, media.media_digest, context_mixing.lm_scores, suffix_dedup.remove_repeats, chosen_path.jaccard_classes):
        found = f(docs).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows), f.__name__
    pieces = packing.pack_documents(docs).where("piece = 0").collect()
    assert Counter(r.doc_id for r in pieces) == Counter(i for i, _ in rows)
    cut = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert cut[None, len(long)].n_removed == len(long) and cut[1, len(long)].n_removed == 0
    assert "�" not in "".join(r.kept_text for r in cut.values())


def test_words_of_all_lengths_are_encoded_as_the_library_does(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import hashlib

    import public_tokenizers as P

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefgé") for _ in range(n)) for n in (1, 50, 255, 256, 257, 3000)] + ["\U0001fae8 \U00011f04x y", " a" * 5000, "字" * 400]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(docs).collect():
        data = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_multikey_quicksort_orders_and_groups():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, 3)).astype(np.uint64)
    order, group = suffix_dedup.multikey_quicksort(x)
    rows = [tuple(x[k]) for k in order]
    assert rows == sorted(rows)
    assert all((group[k] == group[k - 1]) == (rows[k] == rows[k - 1]) for k in range(1, 300))


def test_lists_of_an_article_go_if_both_neighbours_have_them(spark):
    page = "<article><h1>H{0}</h1><p>quoted</p><p>own {0} a</p><p>own {0} b</p><p>own {0} c</p><ul><li>Share this</li><li>item {0}</li></ul></article>"
    rows = [(k, f"http://a.b/{k}", page.format(k)) for k in range(3)] + [(k, f"http://c.d/{k}", page.format(9)) for k in (7, 8, 9)]
    out = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "H1\nquoted\nown 1 a\nown 1 b\nown 1 c\nitem 1" and "Share this" in out[0] and "Share this" in out[8]


def test_exact_stage_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    rows = [(1, "a a"), (1, "b b"), (2, "a a"), (1, "b b"), (None, "c"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    kept = corpus_pipeline.exact_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter([(1, "b b"), (2, "a a"), (None, "c"), (3, "")])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0
