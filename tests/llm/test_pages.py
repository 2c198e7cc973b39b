"""Page differencing against plain code, and names of elements that must not cost text."""

import random
from functools import lru_cache
from itertools import groupby
from urllib.parse import urlsplit

import pytest

from barloom.llm import pages

from .helpers import with_clashes

SCHEMA = "page_id long, url string, html string"


def one(spark, html, url="http://h.example/x"):
    return pages.extract(spark.createDataFrame([(1, url, html)], SCHEMA)).first().text


@pytest.mark.parametrize("html, text", [
    ('<article><div class="layout has-sidebar"><p>Main text</p></div></article>', "Main text"),
    ('<div class="layout has-sidebar"><p>Main text</p></div>', "Main text"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>Body</p></article>', "Title\n\nBody"),
    ('<article><p class="notice-period">Four weeks</p><p class="share-price">12 euros</p></article>', "Four weeks\n\n12 euros"),
    ('<article><p>Body</p><div class="share-buttons">Send</div><div id="comments"><article>Nice</article></div><p class="ad ad-300x250">Buy</p></article>', "Body"),
    ('<div class="site-header">Name</div><div class="page sidebar-left"><main><p>Body</p></main></div><div class="main-menu">Home</div>', "Body"),
    ('<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body</p></article>', "Title\n\nBody"),
])
def test_names_that_touch_on_a_role(spark, html, text):
    assert one(spark, f"<html><body>{html}</body></html>") == text


@pytest.mark.parametrize("attributes, stays", [
    ('title="the hidden truth"', True), ('data-note="was hidden once"', True), ("data-note='class=sidebar'", True), ('alt="display: none"', True), ('data-hidden="1"', True),
    ('title="a class=menu and id=footer"', True), ('hidden="until-found"', True), ('aria-hidden="false"', True), ('style="color: red"', True), ('data-x="aria-hidden=true"', True),
    ("hidden", False), ('hidden=""', False), ('class="x" HIDDEN', False), ('aria-hidden = "true"', False), ("aria-hidden=true", False), ('style="color: red; display : none"', False),
    ("style='display:none'", False), ('title="x" class="sidebar"', False), ("role=navigation", False),
])
def test_attributes_are_read_by_name(spark, attributes, stays):
    assert one(spark, f"<article><p>One.</p><p {attributes}>Two.</p><div {attributes}>Three.</div></article>") == ("One.\n\nTwo.\n\nThree." if stays else "One.")


def test_doubtful_lines_go_if_the_near_page_has_them(spark):
    page = '<article><div class="share-price">Live prices by Example</div><div class="share-price">Price {0}</div><p>Own text {0} of this page</p></article>'
    rows = [(i, f"http://h.example/p/{i}", page.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Price {i}\n\nOwn text {i} of this page" for i in range(3)}


def longest_common(a, b):
    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def plain_extract(rows):
    """{key: text} of pages without article whose lines are all different on each page, so that the lines shared are the common subsequence."""
    out = {}
    place = lambda r: (urlsplit(r[1]).netloc.lower(), urlsplit(r[1]).path, r[1], r[0])
    body = lambda r: [t for t, _ in pages.lines(r[2])]
    for _, found in groupby(sorted(rows, key=place), key=lambda r: place(r)[0]):
        runs = [(x, list(g)) for x, g in groupby(found, key=body)]
        for i, (own, same) in enumerate(runs):
            for r in same:
                near = []
                for j, side in ((i - 1, -1), (i + 1, 0)):
                    if 0 <= j < len(runs):
                        other = urlsplit(runs[j][1][side][1]).path
                        common = next((k for k, (x, y) in enumerate(zip(other, urlsplit(r[1]).path)) if x != y), min(len(other), len(urlsplit(r[1]).path)))
                        near.append((-common, runs[j][0]))
                near.sort(key=lambda x: x[0])
                shared = [[t for t in own if t in x] for _, x in near]
                assert all(len(s) == longest_common(tuple(own), tuple(x)) for s, (_, x) in zip(shared, near))
                share = [sum(map(len, s)) / max(1, sum(map(len, own))) for s in shared]
                good = [s for s, x in zip(shared, share) if x <= 0.8] or ([shared[share.index(min(share))]] if share else [[]])
                out[r[0]] = "\n\n".join([t for t in own if t not in good[0]] or own)
    return out


def site(rng):
    """Hosts whose pages have template lines around their own, some of them copies, some near-copies, some with few lines of their own."""
    rows, key = [], 0
    for host in range(4):
        top, low = [f"Top {host}.{i}" for i in range(3)], [f"Low {host}.{i}" for i in range(2)]
        for n in range(rng.choice([1, 2, 30])):
            own = [f"Sentence {host}.{n}.{i} " + "x" * rng.randint(0, 40) for i in range(rng.randint(0, 6))]
            html = "".join(f"<p>{t}</p>" for t in top[: rng.randint(0, 3)] + own + low)
            for _ in range(rng.choice([1, 1, 1, 4])):
                rows.append((key, f"HTTP://H{host}.example/{rng.choice('ab')}/{rng.randint(0, 99)}?q={key}", html))
                key += 1
            if own and rng.random() < 0.2:
                rows.append((key, f"http://h{host}.example/a/{n}", html.replace(own[-1], "Changed end")))
                key += 1
    return rows


def test_differencing_against_plain_code_whatever_the_parts(spark):
    rng = random.Random(8)
    rows = [r for r in site(rng)]
    want = plain_extract(rows)
    table = with_clashes(spark.createDataFrame(rows, SCHEMA), "text", "host", "_block", "lines")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r.page_id: r.text for r in pages.extract(table.repartition(parts)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    removed = sum(len(pages.lines(h)) - (want[k].count("\n\n") + 1) for k, _, h in rows if want[k])
    assert removed > 50  # the template went


def test_large_hosts_are_split_the_same_way_whatever_the_parts(spark):
    # one host with a flat large directory, many small ones and copies of one page that are a third of its rows
    rows = [(i, f"http://big.example/flat/{i}", f"<p>Shop</p><p>Own {i} text of the page</p>") for i in range(200)]
    rows += [(1000 + i, f"http://big.example/d{i}/x", f"<p>Shop</p><p>Text {i} below a folder</p>") for i in range(100)]
    rows += [(2000 + i, "http://big.example/copy", "<p>Shop</p><p>The copied text of the page</p>") for i in range(150)]
    table, found = spark.createDataFrame(rows, SCHEMA), []
    for parts in (1, 16):
        out = pages.extract(table.repartition(parts), most=40)
        assert out.count() == len(rows)
        found.append({r.page_id: r.text for r in out.collect()})
    assert found[0] == found[1]
    assert all(found[0][i] == f"Own {i} text of the page" for i in range(200)) and all(found[0][1000 + i] == f"Text {i} below a folder" for i in range(100))


def articles(rng):
    """Pages of three hosts with an article each: unmarked template lines in it, sentences that some pages share, other versions and copies of a page."""
    rows, key = [], 0
    for host, n in enumerate((3, 9, 60)):
        common = [f"Sentence {i} that articles share" for i in range(3)]
        for page in range(n):
            own = [f"Own text {host}.{page}.{i} " + "x" * rng.randint(60, 90) for i in range(rng.randint(3, 6))]
            for version in range(rng.choice([1, 1, 1, 3])):
                text = [f"Title {host}.{page}.{version}", "By our editors", *own, *(t for t in common if rng.random() < 0.3), "Read more in our letter"]
                html = "<nav>Home</nav><article>" + "".join(f"<p>{t}</p>" for t in text) + "</article>"
                for _ in range(rng.choice([1, 1, 2])):
                    rows.append((key, f"http://h{host}.example/{page % 3}/{page:02}/{version}", html))
                    key += 1
    return rows


def plain_articles(rows):
    """{key: text} of such pages, whose lines are all different and stand in one order."""
    out = {}
    place = lambda r: (urlsplit(r[1]).netloc, urlsplit(r[1]).path, r[1], r[0])
    share = lambda own, x: sum(len(t) for t in own if t in x) / sum(map(len, own))
    for _, found in groupby(sorted(rows, key=place), key=lambda r: place(r)[0]):
        runs = [(x, list(g)) for x, g in groupby(found, key=lambda r: [t for t, k in pages.lines(r[2]) if k == pages.ARTICLE])]
        for i, (own, same) in enumerate(runs):
            for r in same:
                others = [(j, runs[j][1][-1 if j < i else 0][1]) for j in range(max(0, i - 8), min(len(runs), i + 9)) if j != i]
                others.sort(key=lambda x: (-next((k for k, (a, b) in enumerate(zip(x[1], r[1])) if a != b), min(len(x[1]), len(r[1]))), abs(x[0] - i), x[0]))
                asked = [runs[j][0] for j, _ in others if share(own, runs[j][0]) <= 0.5][:8]
                out[r[0]] = "\n\n".join(t for t in own if len(asked) < 8 or not all(t in x for x in asked))
    return out


def test_differencing_decides_the_lines_of_articles(spark):
    rows = articles(random.Random(4))
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    assert got == plain_articles(rows)
    large = [got[k] for k, url, _ in rows if "h2." in url and "/0/00/" not in url]  # the first page has versions among the eight after it
    assert not any("editors" in t or "letter" in t for t in large) and any("that articles share" in t for t in large)
    assert all("editors" in got[k] and "letter" in got[k] for k, url, _ in rows if "h0." in url)  # six other pages at most are too few
