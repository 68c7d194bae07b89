"""Main text of web pages by page differencing against the nearest URL of the same host.

A page becomes a list of text lines, one per block, each marked by where it stands: inside the page's
article, and inside boilerplate markup. Pages are ordered by (host, path), and each is aligned with the
pages before and after it by a longest common subsequence of lines. Pages with an article keep that
alone, without what markup surely calls boilerplate; pages without one keep what is no boilerplate.
Of these lines, shared ones go:

* in a page without an article, what either neighbour has;
* in an article, what either neighbour has if its markup is doubtful: a class or id that has a word of
  boilerplate among others;
* in an article, any line but its first that is no paragraph, heading or quotation and that both
  neighbours have, where each of them shares less than half of the article's lines. So the site's own
  lists and boxes go without any mark, passages that pages quote stay, and so does an article that a
  neighbour holds a copy of.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?<=/)>|<(svg)\b.*?</svg\s*>|<(script|style|noscript|template|textarea|select|iframe)\b.*?(?:</\2\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stay open or that end by themselves; they are not kept on the stack.
LOOSE = frozenset("p li dd dt tr td th tbody thead tfoot option html".split())
ARTICLE = frozenset(("article", "main"))
OUTSIDE = frozenset("nav footer aside form head button menu dialog".split())
#: Whole class, id and role names of boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " masthead menu menubar nav navbar navigation newsletter notice notices popup promo promoted recommended related reply respond share"
    " sharing sidebar social sponsor sponsored subscribe toolbar widget"
    " ad-banner ad-container ad-slot comment-form comment-list comments-area comments-section cookie-banner cookie-consent cookie-notice"
    " newsletter-signup reader-comments related-articles related-posts related-stories share-bar share-buttons sharing-buttons site-footer"
    " site-header site-nav social-links social-media social-share user-comments".split()
)
#: Words that make any other name that has one of them doubtful.
WORDS = frozenset(n for n in NAMES if "-" not in n)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of prose, which pages quote and repeat by themselves.
PROSE = HEADINGS | {"p", "blockquote", "pre"}
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CONCEALED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
#: What markup says of a block, by rising strength. Names do not count on what holds the body of an article.
CLEAR, DOUBTFUL, NAMED, SURE = range(4)


def _mark(name: str, attributes: str, in_article: bool) -> int:
    if name in OUTSIDE or name == "header" and not in_article:
        return SURE
    if not attributes or name in ARTICLE or name == "body":
        return CLEAR
    mark = CLEAR
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and CONCEALED.search(value):
            return SURE
        if key in ("class", "id", "role") and name not in HEADINGS:
            for token in value.split():
                words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if "-".join(w for w in words if w) in NAMES and not re.search(r"\d", token):
                    mark = NAMED
                elif not WORDS.isdisjoint(words):
                    mark = max(mark, DOUBTFUL)
    return mark


def lines(page: str) -> list[tuple[str, bool, bool, bool, bool]]:
    """(text, in the article, boilerplate, doubtful, prose) of each block that has text; references decoded, white space runs one space."""
    out: list[tuple[str, int, int, bool, int, bool]] = []  # text, article, mark, heading, the outermost element of that mark by name, prose
    buffer: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, article (0: none), mark, the outermost element marked by name
    articles = elements = 0
    block = ""  # that text stands in
    heads: set[int] = set()  # elements marked by name that hold the main heading of their article
    boxed: set[int] = set()  # articles inside what has a name of boilerplate, such as comments and teasers
    titled: set[int] = set()  # articles that hold a main heading

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            _, article, mark, element = stack[-1] if stack else ("", 0, CLEAR, 0)
            if article and any(x[0] == "h1" for x in stack):
                titled.add(article)
                heads.add(element)
            out.append((text, article, mark, any(x[0] in HEADINGS for x in stack), element, block in PROSE))

    for m in TOKEN.finditer(page):
        name = m[4]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                buffer.append(html.unescape(token))
            elif m[1] or m[2] or token[1] in "sS":
                buffer.append(" ")
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
        if name in BLOCKS:
            flush()
            block = "" if m[3] else name
        if name in VOID or name in LOOSE and not m[5]:
            continue
        if m[3]:
            if name not in LOOSE or any(x[0] == name for x in stack):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        if name in LOOSE or name not in BLOCKS and not m[5]:
            if not _mark(name, m[5] or "", bool(stack) and stack[-1][1] > 0):
                continue
            if name in LOOSE:  # a marked paragraph or item: it ends with its own end tag or its parent's
                while stack and stack[-1][0] == name:
                    stack.pop()
        if name == "body":
            stack = [x for x in stack if x[0] != "head"]
        _, inside, mark, element = stack[-1] if stack else ("", 0, CLEAR, 0)
        if m[5].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ARTICLE and not inside:
            articles += 1
            inside = articles
            if mark == NAMED:
                boxed.add(inside)
            if mark < SURE:  # names of what is around the article say nothing of it; ``_judged`` looks at other articles
                mark, element = CLEAR, 0
        own = _mark(name, m[5] or "", inside > 0)
        if own == NAMED and mark < NAMED:
            elements += 1
            element = elements
        stack.append((name, inside, max(mark, own), element))
    flush()
    if len({x[1] for x in out if x[1]}) > 1:  # a page's only article is the article, whatever is around it
        boxed -= titled
        out = [(text, 0, max(mark, NAMED), heading, -1, prose) if article in boxed else (text, article, mark, heading, element, prose) for text, article, mark, heading, element, prose in out]
    return _judged(out, heads - {0})


def _judged(found: list[tuple[str, int, int, bool, int, bool]], heads: set[int]) -> list[tuple[str, bool, bool, bool, bool]]:
    """Lines with names made doubtful where they would leave an article, or a page without one, nothing but headings."""
    named = [mark == NAMED and element not in heads for _, _, mark, _, element, _ in found]
    has_article = any(article and mark < SURE for _, article, mark, *_ in found)
    region = [article if has_article else -1 for _, article, *_ in found]
    body = {r for r, n, (_, _, mark, heading, *_) in zip(region, named, found, strict=True) if mark < SURE and not n and not heading}
    return [
        (text, article > 0, mark == SURE or n and r in body, CLEAR < mark < SURE, prose)
        for r, n, (text, article, mark, *_, prose) in zip(region, named, found, strict=True)
    ]


#: Pairs of equal lines up to which they are followed one by one; more are counted by bits.
PAIRS = 20_000


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of ``a`` are in a longest common subsequence with ``b``."""
    out, low, high = [False] * len(a), 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        out[low] = True
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        out[len(a) - 1 - high] = True
        high += 1
    where = defaultdict(list)
    for j in range(low, len(b) - high):
        where[b[j]].append(j)
    if sum(len(where.get(x, ())) for x in a[low : len(a) - high]) > PAIRS:
        _halved(a, b, low, len(a) - high, low, len(b) - high, out)
        return out
    tails: list[int] = []  # the least end in b of a subsequence of each length
    last: list[tuple] = []  # its (line of a, the one before)
    for i in range(low, len(a) - high):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            node = (i, last[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), last.append(node)
            else:
                tails[k], last[k] = j, node
    node = last[-1] if last else None
    while node:
        out[node[0]] = True
        node = node[1]
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` and each beginning of ``b``: a bit a line of b, all worked on at once."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    every = (1 << len(b)) - 1
    bits = every
    for x in a:
        if own := where.get(x, 0):
            met = bits & own
            bits = (bits + met | bits - met) & every
    grown = np.unpackbits(np.frombuffer((~bits & every).to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(grown, dtype=np.int64))


def _halved(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, out: list[bool]) -> None:
    """Marks a[a0:a1] by halves: b is parted where both halves of a have most in common with its parts. Memory stays in proportion to the lines."""
    stack = [(a0, a1, b0, b1)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            out[a0] = a[a0] in b[b0:b1]
            continue
        middle = (a0 + a1) // 2
        before, after = _lengths(a[a0:middle], b[b0:b1]), _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((before + after).argmax())
        stack += [(a0, middle, b0, cut), (middle, a1, cut, b1)]


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = "page_id long, url string, texts array<string>, article boolean, flags array<boolean>, doubts array<boolean>, prose array<boolean>, open boolean, hashes array<long>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, its lines, whether it has an article, which lines may stay, which go if shared, which are prose, and their hashes.

    flags: in a page with an article, whether a line is in it and no boilerplate; else whether it is no boilerplate.
    doubts: in a page with an article, whether a line stands in doubtful markup; else all lines.
    open: whether a neighbour can change what stays; else the page's text needs no other page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = lines(page.as_py() or "")
                article = any(x[1] and not x[2] for x in found)
                keep = [not x[2] and (x[1] or not article) for x in found]
                doubts = [k and (x[3] or not article) for k, x in zip(keep, found, strict=True)]
                may_go = [d or not x[4] for k, d, x in zip(keep, doubts, found, strict=True) if k]
                out.append((page_id, url, [x[0] for x in found], article, keep, doubts, [x[4] for x in found], any(doubts) or any(may_go[1:]), [_hash(x[0]) for x in found]))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.bool_(), pa.list_(pa.int64()))
            names = ["page_id", "url", "texts", "article", "flags", "doubts", "prose", "open", "hashes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED)


def neighbours(light: DataFrame) -> DataFrame:
    """``light`` with ``place``, a row's place in the order of (host, path, row), counted over all partitions."""
    ordered = light.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    placed = materialise(ordered.select("*", F.monotonically_increasing_id().alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return placed.join(first, "part").withColumn("place", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first", "at", "path")


def unshared(own: list[int], flags: list[bool], doubts: list[bool], prose: list[bool], article: bool, others: list[list[int]]) -> tuple[list[bool], int]:
    """Which lines of a page stay, given the lines of its neighbours, and how many went because a neighbour has them.

    Shared lines go but for those that the page's article protects: clear prose, and what is shared when a
    neighbour holds a copy of the article. Of what no neighbour has, lines that markup calls boilerplate go.
    """
    masks = [np.array(common_lines(own, other), bool) for other in others]
    if not masks or not own:
        return flags, 0
    keep, doubtful, shared = np.array(flags, bool), np.array(doubts, bool), np.any(masks, axis=0)
    protected = keep & ~doubtful
    if article and len(masks) > 1 and all(2 * (m & keep).sum() < keep.sum() for m in masks):
        site = keep & ~np.array(prose, bool) & np.all(masks, axis=0)
        site[np.argmax(keep)] = False
        protected &= ~site
    gone = shared & ~protected
    return (~gone & keep).tolist(), int((gone & keep).sum())


def shared_lines(placed: DataFrame) -> DataFrame:
    """(row, keep, n_shared): which lines of an open page stay beside the pages before and after it on its host, and how many went as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            out = [unshared(*own, [o for o in others if o]) for *own, before, after in rows for others in [(before, after)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in out], pa.list_(pa.bool_())), pa.array([n for _, n in out], pa.int64())], names=["row", "keep", "n_shared"])

    def beside(step: int, name: str) -> DataFrame:
        return placed.select((F.col("place") + step).alias("place"), F.col("host").alias(f"{name}_host"), F.col("hashes").alias(name))

    pairs = placed.where("open").join(beside(1, "before"), "place", "left").join(beside(-1, "after"), "place", "left")
    same = [F.when(F.col("host").eqNullSafe(F.col(f"{n}_host")), F.col(n)).alias(n) for n in ("before", "after")]
    return pairs.select("row", "hashes", "flags", "doubts", "prose", "article", *same).mapInArrow(run, "row long, keep array<boolean>, n_shared long")


def main_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared; ``separator`` stands between the blocks of a text.

    n_shared: lines that went because a neighbouring page has them, of those that markup leaves. Only pages
    that a neighbour can change are joined with what their neighbours say.

    A null html counts as empty, and its text is empty. Pages whose url is null or has no host are
    neighbours of each other. Repeated rows each give a row. An empty table gives no rows; other
    columns of ``pages`` are not read.
    """
    rows = materialise(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "parsed")
    url = F.coalesce("url", F.lit(""))
    light = rows.select(
        "row", "hashes", "flags", "doubts", "prose", "article", "open",
        F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    columns = ["page_id", "url", "texts", "keep", "n_shared"]
    decided = rows.where("not open").select("page_id", "url", "texts", F.col("flags").alias("keep"), F.lit(0).cast("long").alias("n_shared"))
    compared = rows.where("open").select("row", "page_id", "url", "texts").join(shared_lines(neighbours(light)), "row").select(*columns)
    text = F.array_join(F.transform(F.filter(F.arrays_zip("texts", "keep"), lambda x: x["keep"]), lambda x: x["texts"]), separator)
    return decided.union(compared).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_shared")
