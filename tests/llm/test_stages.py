"""Each stage of the pipeline against brute force on its own input: whole documents, with awkward rows beside them."""

import math
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pingmill.functions.storage import materialise
from pingmill.llm import quality

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The input of each stage, and the pipeline's result."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = pq.read_table(f"{SF}/documents.parquet")
    long = max((t for t in rows.column("text").to_pylist() if t and len(t) < 5000), key=len)
    more = [(900_001, None), (900_002, ""), (900_003, "  "), (None, "alone " + long[::-1]), (900_004, long + " more"), (900_005, long), (900_006, "short 字 one")]
    added = [{"doc_id": i, "text": t, "lang": None, "source": "made", "n_chars": len(t or "")} for i, t in more]
    pq.write_table(pa.concat_tables([rows, pa.Table.from_pylist(added, rows.schema)]), f"{folder}/documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = materialise(stage(spark, docs, folder), name)
    return folder, out, docs


def found(inputs, name):
    """(rows that go into a stage, rows that come out)."""
    names = list(STAGES)
    after = names[names.index(name) + 1] if name != names[-1] else None
    return inputs[1][name].collect(), (inputs[1][after] if after else inputs[2]).collect()


def key(i):
    return (i is not None, i or 0)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=key)


def test_quality_keeps_what_the_classifier_accepts(spark, inputs):
    before, after = found(inputs, "quality_classifier")
    labels = spark.read.parquet(f"{inputs[0]}/labels.parquet")
    accepted = {r.doc_id for r in quality.score(inputs[1]["quality_classifier"], labels).where("score >= 0.5").collect()}
    assert ids(after) == ids(r for r in before if r.doc_id in accepted) and len(after) < len(before)
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    assert sum((r.doc_id in accepted) == bool(truth[r.doc_id]) for r in before if r.doc_id in truth) >= 0.95 * len(truth)
    assert not {c for c in corpus_pipeline.COLUMNS} ^ set(after[0].asDict())


def test_exact_copies_leave_the_greatest_id(inputs):
    before, after = found(inputs, "exact_dedup")
    best = {}
    for r in before:
        best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id, key=key)
    assert ids(after) == sorted(best.values(), key=key) and {(r.doc_id, r.text or "") for r in after} == {(i, t) for t, i in best.items()}


def test_near_copies_leave_the_least_id(inputs):
    before, after = found(inputs, "ngram_jaccard_join")
    sets = []
    for r in before:
        w = (r.text or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(before)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    classes = defaultdict(list)
    for k, r in enumerate(before):
        classes[top(k)].append(r.doc_id)
    # of ids and nulls, an id stays
    kept = [min((i for i in c if i is not None), default=None) for c in classes.values()]
    assert ids(after) == sorted(kept, key=key) and len(after) < len(before)


def test_passages_of_earlier_documents_go(inputs):
    before, after = found(inputs, "suffix_array_dedup")
    named = [r for r in before if r.doc_id is not None]
    least, want = {}, {}
    for r in named:
        data = (r.text or "").encode()
        for k in range(len(data) - 49):
            least[data[k : k + 50]] = min(r.doc_id, least.get(data[k : k + 50], r.doc_id))
    for r in named:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if least[data[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")
        if text.strip(" "):
            want[r.doc_id] = (text, r.lang, r.source, len(text))
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in after if r.doc_id is not None} == want
    assert any(want[r.doc_id][0] != r.text for r in named if r.doc_id in want)


def test_pieces_hold_every_token_without_gaps(inputs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    before, after = found(inputs, "best_fit_packing")
    sizes = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, size in sizes.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces.pop(i))):
            assert (piece, start) == (k, at) and (k == 0 or length == 2048)
            at += length
        assert at == size
    assert not pieces
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    room, bins = [], 0
    for length in sorted((r.length for r in after), reverse=True):
        k = bisect_left(room, length)
        if k < len(room):
            left = room.pop(k) - length
        else:
            bins, left = bins + 1, 2048 - length
        insort(room, left)
    assert math.ceil(sum(sizes.values()) / 2048) <= len(sequences) <= bins


def test_stages_on_no_rows_and_rows_of_one_id(spark, inputs):
    folder, tables, _ = inputs
    none = tables["exact_dedup"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
    twice = spark.createDataFrame([(1, "a b c d e f", "nl", "x", 1), (1, "g h i j k l", "en", "y", 1), (1, "g h i j k l", "en", "b", 1)], none.schema)
    for parts in (1, 3):
        rows = STAGES["suffix_array_dedup"](spark, twice.repartition(parts), folder).collect()
        assert {(r.lang, r.source) for r in rows} == {("en", "b")} and {r.text for r in rows} >= {"a b c d e f"}


def test_contradicting_labels_teach_nothing(spark):
    rows = [(i, ("fine words of prose " * 9 if i % 2 else "BUY!!! NOW!!! " * 20) + str(i), "en", "s", 100) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = [(i, i % 2) for i in range(100)]
    plain = spark.createDataFrame(marks, "doc_id long, quality int")
    both = spark.createDataFrame(marks + marks + [(i, k) for i in range(100, 120) for k in (0, 1)], "doc_id long, quality int").repartition(5)
    first, second = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (plain, both))
    assert first == pytest.approx(second) and all((p >= 0.5) == bool(i % 2) for i, p in first.items())
