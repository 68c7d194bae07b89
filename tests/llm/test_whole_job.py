"""Places where an operator once did less than the whole job."""

import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np

from pingmill.llm import chosen_path, context_mixing, html_extract, packing, queries
from pingmill.operators.components import connected_components

PAGE = "page_id long, url string, html string"


def texts(spark, rows, **how):
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, PAGE), **how).collect()}


def test_blocks_of_op10_are_joined_by_two_newlines(spark, tmp_path):
    rows = [(0, "http://a.b/x", "<article><h1>Head</h1><p>one<p>two</article>"), (1, "http://c.d/x", "<div>alone</div>"), (2, "http://e.f/", "<div>a</div><div>b</div>")]
    spark.createDataFrame(rows, PAGE).write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: (r.text, r.n_chars) for r in queries.op10_page_differencing(spark, str(tmp_path)).collect()}
    assert out == {0: ("Head\n\none\n\ntwo", 14), 1: ("alone", 5), 2: ("a\n\nb", 4)}


def test_markup_of_articles_keeps_their_text(spark):
    pages = [
        "<article><h1>H</h1><p>a</p><h2 id='related-work'>Related work</h2><p>b</p></article>",
        "<article><h1>H</h1><div class='overflow-hidden'><p>a</p></div><div data-hidden='no'>b</div></article>",
        "<article><div class='content has-sidebar'><h1>H</h1><p>a</p></div></article>",
        "<article><h1>H</h1><div class='widget'><p>a</p></div></article>",
        "<div class='page sidebar'><main><h1>H</h1><p>a</p></main></div>",
        "<article><h1>H</h1><p>a</p><div class='comments'>no</div><div hidden>no</div><p style='display: none'>no</p><div class='ad'>no</div></article>",
        "<article><div class='notice'><h1>H</h1><p>a</p></div><p>b</p><div class='share'>no</div></article>",
        "<div class='notice'>a</div><div class='x'><h1>H</h1></div>",
    ]
    out = texts(spark, [(k, f"http://h{k}.org/", f"<body>{p}</body>") for k, p in enumerate(pages)])
    assert [out[k] for k in range(8)] == ["H\na\nRelated work\nb", "H\na\nb", "H\na", "H\na", "H\na", "H\na", "H\na\nb", "a\nH"]


def test_doubtful_blocks_of_articles_go_if_a_neighbour_has_them(spark):
    page = "<article><h1>H{0}</h1><p>quoted</p><div class='box-related'><p>read more</p><p>own {0}</p></div></article>"
    out = texts(spark, [(k, f"http://a.b/{k}", page.format(k)) for k in range(2)])
    assert out == {0: "H0\nquoted\nown 0", 1: "H1\nquoted\nown 1"}


def test_sets_that_stop_at_a_centre_meet_their_partners_there(spark):
    """x agrees with the centre in 53 slots and stops; y agrees with x in 43, with the centre in 32 (0.5)."""
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**32, 64, np.uint32)
    rows, pairs = [], []
    for k in range(300):
        s = centre.copy()
        s[k % 64] = k
        rows.append((k, s.tobytes()))
    for k in range(300, 700, 2):
        order, x = rng.permutation(64), centre.copy()
        x[order[:11]] = rng.integers(0, 2**32, 11, np.uint32)
        y = x.copy()
        y[order[11:32]] = rng.integers(0, 2**32, 21, np.uint32)
        rows += [(k, x.tobytes()), (k + 1, y.tobytes())]
        pairs.append((k, k + 1))
    sets = spark.createDataFrame(rows, "rep long, signature binary").repartition(3)
    buckets = defaultdict(set)
    for r in chosen_path.first_paths(sets, chosen_path.runs_for(0.8), 1.25 / 64).collect():
        buckets[r.path].add(r.rep)
    met = [p for p in pairs if any(len(b) > chosen_path.BUCKET and set(p) <= b for b in buckets.values())]
    label = {r.node: r.label for r in connected_components(chosen_path.loose_links(sets, 0.8)).collect()}
    assert len(met) > 20 and all(x in label and label[x] == label.get(y) for x, y in met)


def test_counts_of_all_tasks_reach_the_model_whole(spark):
    texts_ = ["a b"] * 2999 + ["a c"]
    docs = spark.createDataFrame([(t,) for t in texts_], "text string").repartition(3)
    code = context_mixing.code_of([b"a", b"b", b"c"], [3000, 2999, 1], 3000, 9000)
    own = context_mixing.Learner()
    data, offsets = np.frombuffer("".join(texts_).encode(), np.uint8), np.arange(0, 9001, 3)
    for d in context_mixing.decisions(context_mixing.tokens(data, offsets, code), code):
        own.see(d)
    own.count()
    want = context_mixing.table_of(own.counts.reshape(context_mixing.PREDICTORS, -1, 2))
    table = context_mixing.learnt(docs, spark.sparkContext.broadcast(code))[0]
    assert own.counts.max() > 255 * 3 and np.array_equal(table.odds, want.odds) and np.array_equal(table.seen, want.seen)


def least_bins(lengths, capacity):
    """By the fewest (bins, room used in the last) of each subset."""
    full = (1 << len(lengths)) - 1

    @cache
    def least(left):
        if not left:
            return 0, capacity
        options = []
        for k, x in enumerate(lengths):
            if left >> k & 1:
                bins, last = least(left & ~(1 << k))
                options.append((bins, last + x) if last + x <= capacity else (bins + 1, x))
        return min(options)

    return least(full)[0]


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(8)
    for _ in range(150):
        capacity = 100
        lengths = [rnd.randint(26, 49) for _ in range(rnd.randint(6, 11))]
        plan = packing.complete_bins(dict(Counter(lengths)), capacity)
        packed = Counter()
        for times, items in plan:
            assert sum(x * n for x, n in items) <= capacity
            packed.update({x: times * n for x, n in items})
        assert packed == Counter(lengths) and sum(t for t, _ in plan) == least_bins(tuple(lengths), capacity)


def test_bin_completion_finds_planted_triplets():
    rnd = random.Random(9)
    for _ in range(30):
        lengths = Counter()
        for _ in range(8):
            a, b = rnd.randint(26, 36), rnd.randint(26, 36)
            lengths.update([a, b, 100 - a - b])
        assert sum(t for t, _ in packing.complete_bins(dict(lengths), 100)) == 8
