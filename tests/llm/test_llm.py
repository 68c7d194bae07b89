"""Each operator against a brute-force version, an exact round trip or held-out labels, and on awkward tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pingmill.llm import bpe, chosen_path, context_mixing, exact_dedup, html_extract, media, packing, quality, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, group_size long, recipe string, rep long"


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß字") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, shared = prose(120), prose(25)
    texts = [base, base, base.replace(words[0], words[1]), base + " end", base[:-9], "", None, " \n\t ", "one two", "one two", "a" * 700, "x" * 300 + base]
    texts += [prose(40) + "\n" + shared + "\n" + prose(rnd.randint(1, 60)) for _ in range(12)] + ["don't  stop now   12½ Ⅷ\x1c!!", prose(3000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", 0) for i, t in corpus()], DOC).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i, _ in corpus()] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_exact_copies(docs):
    groups = defaultdict(list)
    for i, t in corpus():
        groups[t or ""].append(i)
    out = {r.doc_id: r for r in exact_dedup.exact_copies(docs).collect()}
    assert len(out) == len(corpus())
    for text, ids in groups.items():
        for i in ids:
            r = out[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("listed", [1, 0])
def test_ambiguous_chunks_are_told_apart(spark, docs, listed, monkeypatch):
    ids = [r[0] for r in docs.selectExpr("explode(regexp_extract_all(coalesce(text, ''), '(?s).{1,64}', 0)) c").selectExpr("xxhash64(c)").limit(2).collect()]
    monkeypatch.setattr(exact_dedup, "shared_ids", lambda *a, **k: ids if listed else list(range(exact_dedup.MAX_LISTED + 2)))
    assert exact_dedup.exact_copies(docs).where("kept").count() == len({t or "" for _, t in corpus()})


def test_jaccard_classes(docs):
    sets = {}
    for i, t in corpus():
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links = {i: [j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    out = {r.doc_id: r for r in chosen_path.jaccard_classes(docs).collect()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        assert (out[i].class_id, out[i].n_links) == (min(seen), len(links[i]))


def test_large_buckets_and_blocks_lose_no_link(spark, monkeypatch):
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(chosen_path, "BUCKET", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(chosen_path.exact_links, "__defaults__", (5, 16))
    monkeypatch.setattr(chosen_path.loose_links, "__defaults__", (0.99, 8))
    out = chosen_path.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 59)}


def test_bpe_is_the_librarys(docs):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for common in (bpe.COMMON, 3):
        out = {r.doc_id: r for r in bpe.encode_decode(docs, common=common).collect()}
        for i, t in corpus():
            data = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
            assert (out[i].n_tokens, out[i].ids_sha256) == (len(data) // 4, hashlib.sha256(data).hexdigest())
            assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_media_round_trip(docs):
    out = {r.doc_id: r for r in media.media_digest(docs).collect()}
    for i, t in corpus():
        raw = (t or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    every = bytes(range(256)) * 8
    frames = media.read_avi(media.encode_avi(every))[2]
    assert media.decode_frames(frames).tobytes() == every
    assert media._decode_any(*media._parse_jpeg(frames[0])).tobytes() == every[: media.FRAME]
    flat, noisy = np.zeros((4, 16, 64), np.uint8), np.full((4, 16, 64), 200, np.uint8)
    assert [c["first_frame"] for c in media.shots(np.concatenate([flat, noisy]))] == [0, 4]
    assert media.clip_rows(docs.select("doc_id", media.to_avi(docs["text"]).alias("media"))).count() >= len(corpus())


def test_tokenizer_files_agree():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    whole = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for _, t in corpus():
        assert packing._encoding(None).encode_ordinary(t or "") == whole.encode(t or "", add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    encode = packing._encoding(None)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in corpus():
        ids = np.array([*encode.encode_ordinary(t or ""), 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r["length"]].tobytes()) == r.ids_crc32 for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1]) and sum(r["length"] for r in own) <= 2048


def test_bin_completion_is_near_the_bound():
    rnd = random.Random(3)
    for _ in range(20):
        lengths = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(1, 200)))
        plan = packing.complete_bins(dict(lengths), 100)
        packed = Counter()
        for times, items in plan:
            assert sum(x * n for x, n in items) <= 100
            for x, n in items:
                packed[x] += times * n
        assert packed == lengths
        assert sum(t for t, _ in plan) <= -(-sum(x * n for x, n in lengths.items()) // 100) * 1.1 + 1
    assert packing.complete_bins({}) == []


def test_context_mixing(docs):
    C, tok = Counter(), {i: [*(t or "").encode().lower().split(), b" "] for i, t in corpus()}
    learnt = {i for i in tok if zlib.crc32(str(i).encode()) % 10}
    for i in learnt:
        C.update(tok[i])
    N, V = sum(C.values()), len(C)
    out = {r.doc_id: r for r in context_mixing.lm_scores(docs).collect()}
    for i, words in tok.items():
        base = sum(math.log10((C[w] + 0.1) / (N + 0.1 * (V + 1))) for w in words)
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(C[w] > 0 for w in words), N, i not in learnt)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and -1e7 < r.score < 0


def test_suffix_dedup(docs):
    first, want = {}, {}
    for i, t in corpus():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want[i] = (len(raw), sum(gone), sum(gone[p] and not (p and gone[p - 1]) for p in range(len(gone))), hashlib.sha256(kept).hexdigest())
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out == want


def test_deep_shallow_order():
    rnd = np.random.default_rng(1)
    for width, most in ((57, 2), (26, 4), (9, 256)):
        x = rnd.integers(0, most, (200, width)).astype(np.uint8)
        x[50:120, : width - 2] = x[3, : width - 2]
        x[130:140] = x[7]
        order, common = suffix_dedup.deep_shallow(x)
        rows = [bytes(x[k]) for k in order]
        assert rows == sorted(rows)
        for k in range(1, 200):
            assert common[k] == next((i for i in range(width) if rows[k][i] != rows[k - 1][i]), width)


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head &amp; tail</h1><p>one<br>two  <b>three<p>four<div class='reader-comments'>no</div></article><footer>f</footer>"
    site = [f"<body><div>Site name</div><div>story {k}</div><div>Call us</div></body>" for k in range(3)]
    rows = [(0, "http://a.b/x", page), (1, None, None), (2, "http://a.b/y", ""), *((3 + k, f"http://c.d/s/{k}", h) for k, h in enumerate(site)), (6, "http://c.d/s/2", site[2])]
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == ("Head & tail\none two three\nfour", 30)
    assert out[1] == out[2] == ("", 0) and out[3][0] == "story 0" and out[4][0] == "story 1"
    for _ in range(30):
        a, b = ([random.randrange(4) for _ in range(random.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(html_extract.common_lines(a, b)) == best[-1][-1]


def test_neighbours_are_exact():
    rnd = random.Random(4)
    examples = [(k, k % 2, {rnd.randrange(40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}) for k in range(300)]
    index = toxicity.build([str(k) for k in range(40)], examples, 0.5)
    for _ in range(40):
        terms, w = toxicity.vector({rnd.randrange(40): 1 for _ in range(4)}, index.idf)
        best, score = toxicity.nearest(index, terms, w)
        brute = np.zeros(len(index.ids))
        for k, n, c in examples:
            t, x = toxicity.vector(c, index.idf)
            brute[np.flatnonzero(index.ids == k)[0]] = sum(a * b for i, a in zip(terms, w) for j, b in zip(t, x) if i == j)
        assert np.allclose(score, np.sort(brute)[::-1][: len(score)]) and np.allclose(brute[best], score)


def test_classifiers_on_held_out_labels(spark):
    rnd = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        junk, toxic = i % 4 == 0, i % 5 == 0
        words = [f"{rnd.choice('abc')}{rnd.randrange(50)}" for _ in range(60)] + ["vile", "vilest"] * toxic
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), "en", f"s{i % 3}", 300))
        marks.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == truth[r.doc_id][1] for r in got)
    assert sum(r.kept == bool(truth[r.doc_id][0]) for r in quality.score(docs, labels).collect()) > 590


def test_empty_tables(docs, labels, spark):
    none = docs.limit(0)
    for f in (exact_dedup.exact_copies, chosen_path.jaccard_classes, bpe.encode_decode, media.media_digest, packing.pack_documents, suffix_dedup.remove_repeats, context_mixing.lm_scores):
        assert f(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0 and quality.score(none, labels).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == quality.score(docs, labels.limit(0)).where("kept").count() == len(corpus())


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len({r.doc_id for r in rows}) < 200
