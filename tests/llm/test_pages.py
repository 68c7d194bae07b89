"""Page extraction: icons, comments, teasers, long tables, and what differencing removes."""

import random
import time

import pytest

from pingmill.llm import html_extract

PAGE = "page_id long, url string, html string, text string, keep int"


def texts(spark, pages):
    rows = [(k, u, h, "x", 1) for k, (u, h) in enumerate(pages)]
    out = html_extract.main_text(spark.createDataFrame(rows, PAGE), separator="\n\n").collect()
    return {r.page_id: (r.text, r.n_shared) for r in out}


def kept(page):
    """Lines that a page keeps by itself."""
    found = html_extract.lines(page)
    article = any(x[1] and not x[2] for x in found)
    return [x[0] for x in found if not x[2] and (x[1] or not article)]


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<svg/>", '<svg a="/>" />', '<svg class="i"><path d="M1"/></svg>', "<SVG viewBox='0 0 1 1'><title>t</title></SVG>", '<svg class="i">'])
def test_icons_take_no_text_with_them(icon):
    assert kept(f"<p>one {icon} more</p><p>two</p>") == ["one more", "two"]
    assert kept(f"<article><p>one {icon}{icon} more</p></article><p>two</p>") == ["one more"]


def test_comments_and_teasers_after_the_article_go():
    body = "<article><h1>Title</h1><p>Body of it.</p></article>"
    comments = '<div id="comments" class="comments-area"><ol class="comment-list"><li><article class="comment-body"><p>First!</p></article></li><li><article><p>Second.</p></article></li></ol></div>'
    teasers = '<div class="related-posts"><article><h3>Other</h3><p>Read this.</p></article></div>'
    for page in (body + comments, teasers + body, body + teasers + comments, f"<main>{body}{comments}</main>", body.replace("</article>", comments + "</article>")):
        assert kept(page) == ["Title", "Body of it."]


def test_the_only_article_and_one_with_the_title_stay_in_any_box():
    for name in ("widget", "related-posts", "notice"):
        assert kept(f'<div class="{name}"><article><p>Alone.</p></article></div><p>Around.</p>') == ["Alone."]
        assert kept(f'<div class="{name}"><article><h1>Here</h1><p>Text.</p></article></div><div class="comments"><article><p>No.</p></article></div>') == ["Here", "Text."]
        assert kept(f'<article><p>Free.</p></article><div class="{name}"><article><h1>Boxed</h1></article></div>') == ["Free.", "Boxed"]


def best(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    return rows[-1][-1]


def is_part(part, b):
    rest = iter(b)
    return all(x in rest for x in part)


@pytest.mark.parametrize("pairs", [html_extract.PAIRS, 0])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, pairs):
    monkeypatch.setattr(html_extract, "PAIRS", pairs)
    draw = random.Random(1)
    for n in range(120):
        a, b = ([draw.randrange(1 + n % 9) for _ in range(draw.randrange(40))] for _ in range(2))
        part = [x for x, m in zip(a, html_extract.common_lines(a, b), strict=True) if m]
        assert len(part) == best(a, b) and is_part(part, b)


def test_long_tables_of_a_site_end_soon():
    draw = random.Random(2)
    a, b = ([draw.randrange(20) for _ in range(20_000)] for _ in range(2))
    began = time.time()
    html_extract.common_lines(a, b)
    assert time.time() - began < 20


def test_differencing_decides_on_a_site_without_marks(spark):
    """No article, no class: what the pages of a host share goes, and each page's own lines stay."""
    shared_top, shared_end = "<div>Site of things</div><ul><li>Home</li><li>About</li></ul>", "<div>All rights kept</div>"
    pages = [(f"http://a.org/p/{k}", f"<body>{shared_top}<div>Own text {k}.</div><p>More of {k}.</p>{shared_end}</body>") for k in range(4)]
    pages += [("http://b.org/", f"<body>{shared_top}<p>Alone on its host.</p></body>"), ("http://c.org/same", "<p>Tie one.</p><p>Both.</p>"), ("http://c.org/same", "<p>Tie two.</p><p>Both.</p>")]
    got = texts(spark, pages)
    assert [got[k] for k in range(4)] == [(f"Own text {k}.\n\nMore of {k}.", 4) for k in range(4)]
    assert got[4] == ("Site of things\n\nHome\n\nAbout\n\nAlone on its host.", 0)
    assert got[5] == ("Tie one.", 1) and got[6] == ("Tie two.", 1)  # equal addresses are neighbours


def test_differencing_removes_an_unmarked_box_in_articles(spark):
    box = "<div>More from us</div><ul><li>Weather</li><li>Sports</li></ul>"
    pages = [(f"http://a.org/{k}", f"<article><h1>T{k}</h1><p>First {k}.</p><p>Second {k}.</p><p>Third {k}.</p><p>Fourth {k}.</p>{box}</article>") for k in range(3)]
    got = texts(spark, pages)
    assert got[1] == ("T1\n\nFirst 1.\n\nSecond 1.\n\nThird 1.\n\nFourth 1.", 3)
