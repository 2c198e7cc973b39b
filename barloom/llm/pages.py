"""Main text of web pages by differencing pages with near URLs.

Pages of a host are ordered by URL path, and each is compared with a neighbour of other content, that whose path shares
the longest prefix first: their text lines are aligned by longest common subsequence, and lines that both pages hold are
template text and go. This decides all lines outside an article element, and those inside one that stand in an element
with a doubtful class name. Two articles may well share a sentence, so the other lines inside an article go only if the alignment with
each of ``WITNESSES`` pages nearby shows them. Elements that are never main text (navigation, scripts, forms and the like) go in any case.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages of a host, and of a directory, that are looked through together; larger ones are split.
BLOCK_PAGES = 256
#: A near page that has more than this share of a page's text is a near-copy, which says little about the template.
COPY_SHARE = 0.8
#: A line of an article is template text if so many pages nearby have it, all that were asked.
WITNESSES = 8
#: A page that has more than this share of an article's text is another version of it, which is not asked about the article's lines.
VERSION_SHARE = 0.5
#: Names of large hosts and directories up to this many are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
#: Elements whose content is text for the machine: skipped up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "head"}
#: Elements that are never main text.
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
BODY = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that stay within a line; all others end it.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Words in class, id or role that name something other than main text. HEADS may also be an article's own heading.
HEADS = {"header", "masthead", "banner", "head", "hero"}
ROLES = HEADS | {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pager", "pagination", "popup", "promo", "recommended", "related", "respond", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "widget",
}
#: Words beside such a word in one name that leave its meaning as it is: main-menu, share-buttons, widget-area.
PLAIN = {
    "area", "bar", "bars", "block", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "fixed", "form", "global", "group", "icons",
    "inner", "item", "items", "left", "link", "links", "list", "main", "media", "mobile", "outer", "overlay", "page", "post", "posts", "primary", "right",
    "row", "secondary", "section", "site", "slot", "sticky", "thread", "title", "top", "trail", "unit", "user", "wrap", "wrapper",
}
#: Names of elements that hold a whole page or its text: another name on them says how they are laid out.
LAYOUT = {"article", "body", "container", "content", "entry", "layout", "main", "page", "post", "site", "story", "wrap", "wrapper"}
WORD = re.compile(r"[A-Za-z]+")
#: An attribute of a tag: its name, and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Kinds of lines: template elements, the rest of the page, inside an article or main element, and there under a doubtful name.
TEMPLATE, LOOSE, ARTICLE, DOUBTFUL = 0, 1, 2, 3


#: An open element of these ends where the next of its kind begins, a paragraph where any block begins.
SIBLINGS = {"li", "td", "th", "tr", "dt", "dd", "option"}


def marked(attributes: str, in_article: bool = False) -> int | None:
    """TEMPLATE for an element whose class, id or role names something other than main text, DOUBTFUL if a name only touches on it.

    A name does the former if all its words are of ROLES or PLAIN (site-nav, sidebar-left), the latter if only some are (share-price,
    has-sidebar), and so do a layout's names (page sidebar) and, in an article, headers.
    """
    if not attributes:
        return None
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += value.lower().split()
        elif name == "hidden" and not value.lower().startswith("until") or name == "aria-hidden" and value.strip().lower() == "true":
            return TEMPLATE
        elif name == "style" and DISPLAY_NONE.search(value):
            return TEMPLATE
    found = None
    for name in names:
        words = WORD.findall(name)
        roles = [w for w in words if w in ROLES]
        if not roles:
            continue
        if not all(w in ROLES or w in PLAIN for w in words) or in_article and all(w in HEADS for w in roles) or LAYOUT.intersection(names):
            found = DOUBTFUL
        else:
            return TEMPLATE
    return found


def lines(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each line of a page in page order, white space made one and trimmed, empty ones left out.

    Unclosed elements end with their parents; a broken tag at the end of a page is no text.
    """
    html = html or ""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    at, n = 0, len(html)

    def close_line():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, stack[-1][1] if stack else LOOSE))

    while at < n:
        m = TAG.search(html, at)
        if not m:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)
            parts.append(rest[: cut.start()] if cut else rest)
            break
        parts.append(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            parts.append(m[1])
        if m[3] is None:
            continue
        closing, name, attributes = m[2], m[3].lower(), m[4]
        if name in RAW:
            close_line()
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif name != "head":
                    break
            continue
        outer = stack[-1][1] if stack else LOOSE
        inline = name in INLINE
        mark = None if closing else marked(attributes, outer in (ARTICLE, DOUBTFUL))
        if inline and not closing and (outer == TEMPLATE or mark is None):
            if name in ("br", "img"):
                parts.append(" ")
            continue
        if closing:
            i = len(stack) - 1
            while i >= 0 and stack[i][0] != name and (stack[i][0] not in BODY or name in ("body", "html")):
                i -= 1
            found = i >= 0 and stack[i][0] == name
            if found or not inline:
                close_line()
            if found:
                del stack[i:]
            continue
        close_line()
        if name in VOID or attributes.endswith("/"):
            continue
        if stack and (stack[-1][0] == "p" and not inline or stack[-1][0] == name and name in SIBLINGS):
            stack.pop()
            outer = stack[-1][1] if stack else LOOSE
        if name in ("html", "body") or name in BODY and outer == LOOSE:
            mark = None
        if outer == TEMPLATE or mark == TEMPLATE or name in OUTSIDE or name == "header" and outer == LOOSE:
            kind = TEMPLATE
        elif name in BODY:
            kind = max(outer, ARTICLE)
        else:
            kind = DOUBTFUL if mark == DOUBTFUL and outer != LOOSE else outer
        stack.append((name, kind))
    close_line()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two lists of lines, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    ones = (1 << len(a)) - 1
    row, rows = ones, [ones]
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row & ~hit) & ones
        rows.append(row)
    # a zero at i in row j: the best subsequence of a[:i+1] and b[:j] is longer than that of a[:i]
    out, i = set(), len(a) - 1
    for j in range(len(b), 0, -1):
        while i >= 0 and rows[j] >> i & 1:
            i -= 1
        if i < 0:
            break
        if rows[j - 1] >> i & 1:  # the gain at i came with b[j-1]
            out.add(i)
            i -= 1
    return out


def shared_share(own: list[tuple[str, int]], shared: set[int]) -> float:
    """Share of the characters outside template elements that stand in the given lines."""
    sizes = [len(t) * (k != TEMPLATE) for t, k in own]
    return sum(sizes[i] for i in shared) / max(1, sum(sizes))


def attested(own: list[tuple[str, int]], around: Sequence[list[str]]) -> set[int]:
    """Places of article lines that the first ``WITNESSES`` pages of ``around`` all share, other versions of the article left out.

    None if there are fewer such pages: what few pages share may be a sentence that they have in common.
    """
    texts = [t for t, _ in own]
    body = {i for i, (_, k) in enumerate(own) if k == ARTICLE}
    size, left, asked = sum(len(texts[i]) for i in body), body, 0
    for x in around:
        if not left or asked == WITNESSES:
            break
        held = common(texts, x) & body
        if sum(len(texts[i]) for i in held) <= VERSION_SHARE * size:
            left, asked = left & held, asked + 1
    return left if asked == WITNESSES else set()


def main_text(own: list[tuple[str, int]], near: Sequence[list[str]], around: Sequence[list[str]] = ()) -> str:
    """The blocks of a page that are left after differencing with pages nearby, of which ``near`` gives the neighbours and ``around`` those
    in a wider circle, the nearest first.

    The neighbour that has at most ``COPY_SHARE`` of the page's text decides; if all have more, as near-copies have, the one with
    least. Template elements go, and so do loose and doubtful lines that this page has too, and lines of the article that all pages around
    have (see ``attested``). What is left of the article is the text if there is any, else what is left of the loose lines. If that is
    nothing, all loose lines stay.
    """
    found = [common([t for t, _ in own], x) for x in near]
    shares = [shared_share(own, x) for x in found]
    best = next((i for i, x in enumerate(shares) if x <= COPY_SHARE), None)
    shared = found[best] if best is not None else min(zip(shares, range(len(found)), found))[2] if found else set()
    gone = attested(own, around) | {i for i in shared if own[i][1] in (LOOSE, DOUBTFUL)}
    left = [(t, k) for i, (t, k) in enumerate(own) if i not in gone]
    inside = [t for t, k in left if k in (ARTICLE, DOUBTFUL)]
    kept = inside or [t for t, k in left if k == LOOSE] or [t for t, k in own if k in (LOOSE, DOUBTFUL)]
    return "\n\n".join(kept)


#: Host and path of a URL as Java and Python both read them.
_HOST, _PATH = r"^\s*(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?//([^/?#]*)", r"^\s*(?:(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?//[^/?#]*)?([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), in lower case for the host, without query and fragment; a null or odd URL is a path without host."""
    return tuple(F.coalesce(c, F.lit("")) for c in (F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _PATH, 1)))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def blocks(placed: DataFrame, most: int) -> DataFrame:
    """Add _block to rows with _host, _path, _url and _key: the pages among which a page's near page is looked for.

    A host of up to ``most`` pages is one block. A larger one is dealt out by directory, and a directory of over ``most`` pages by
    page, in blocks of about that size; the blocks follow from the pages alone, not from how Spark deals them out.
    """
    spark, folder = placed.sparkSession, F.regexp_extract("_path", "^(.*)/[^/]+/?$", 1)
    counted = placed.groupBy("_host", folder.alias("_folder")).agg(F.count("*").alias("_n")).cache()
    hosts = counted.groupBy("_host").agg(F.sum("_n").alias("_hosted")).filter(F.col("_hosted") > most)
    folders = counted.filter(F.col("_n") > most)
    n_large = hosts.count() + folders.count()  # at most two in ``most`` pages
    few = F.broadcast if n_large <= BROADCAST_ROWS else lambda t: t
    out = placed.withColumn("_folder", folder).join(few(hosts), "_host", "left").join(few(folders), ["_host", "_folder"], "left")
    if not n_large:  # the usual case needs no join at all
        out = placed.withColumns({"_folder": folder, "_hosted": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    counted.unpersist()
    part = F.when(F.col("_n").isNotNull(), F.concat_ws("/", "_folder", F.pmod(F.xxhash64("_path", "_url", "_key"), F.ceil(F.col("_n") / most))))
    part = part.when(F.col("_hosted").isNotNull(), F.pmod(F.xxhash64("_folder"), F.ceil(F.col("_hosted") / most)).cast("string"))
    return out.withColumn("_block", F.xxhash64("_host", F.coalesce(part, F.lit("")))).drop("_folder", "_hosted", "_n")


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", most: int = BLOCK_PAGES) -> DataFrame:
    """(key, url, text, n_chars): the main text of every page, blocks joined by an empty line.

    Null and empty pages have the empty text. A page's near pages are its neighbours by path, URL and key with other lines
    in its block (see ``blocks``), ``WITNESSES`` on either side where an article's lines are at stake: copies of a page side by side count as one. Pages with one URL, equal keys or equal
    contents are rows of their own; other columns, whatever their names, play no part. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = df.schema[key].dataType
    kind = key_type.simpleString()

    def parse(batches):
        for batch in batches:
            found = [lines(h) for h in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(5), pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())),
                 pa.array([[k for _, k in x] for x in found], pa.list_(pa.int8()))],
                ["_key", "_url", "_host", "_path", "_block", "_lines", "_kinds"],
            )

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

    def runs(batches):
        """((block, host), lines, kinds, rows) of neighbours with the same lines."""
        run = None
        for own, link, host, path, block, text, kinds in rows(batches):
            if run is None or run[0] != (block, host) or run[1] != text or run[2] != kinds:
                if run is not None:
                    yield run
                run = ((block, host), text, kinds, [])
            run[3].append((own, link, path))
        if run is not None:
            yield run

    def texts(before, ahead):
        """(key, url, text) of the first run ahead, which then stands before the next."""
        _, text, kinds, held = run = ahead.popleft()
        own, solved = list(zip(text, kinds)), None
        others = [(i, r[3][side][2], r[1]) for runs_, side in ((reversed(before), -1), (ahead, 0)) for i, r in enumerate(runs_)]
        for k, link, path in held:
            order = sorted(range(len(others)), key=lambda i: (-_prefix(others[i][1], path), others[i][0], i))  # the one before wins a tie
            if solved is None or order != solved[0]:
                solved = order, main_text(own, [others[i][2] for i in order if not others[i][0]], [others[i][2] for i in order])
            yield k, link, solved[1]
        before.append(run)

    def solve(batches):
        for _, found in groupby(runs(batches), key=lambda x: x[0]):
            before, ahead = deque(maxlen=WITNESSES), deque()
            for run in found:
                ahead.append(run)
                if len(ahead) > WITNESSES:
                    yield from texts(before, ahead)
            while ahead:
                yield from texts(before, ahead)

    def pack(held):
        cols = list(zip(*held)) if held else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], to_arrow_type(key_type)), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([len(t) for t in cols[2]], pa.int64())],
            [key, "url", "text", "n_chars"],
        )

    def difference(batches):
        held, size = [], 0
        for out in solve(batches):
            held.append(out)
            size += len(out[2])
            if size > 8_000_000:
                yield pack(held)
                held, size = [], 0
        yield pack(held)

    host, path = split_url(F.col(url))
    placed = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("_host"), path.alias("_path"), F.col(html).alias("_html"))
    parsed = blocks(placed, most).select("_key", "_url", "_host", "_path", "_html", "_block").mapInArrow(
        parse, f"_key {kind}, _url string, _host string, _path string, _block long, _lines array<string>, _kinds array<tinyint>"
    )
    dealt = parsed.repartition("_block").sortWithinPartitions("_block", "_host", "_path", "_url", "_key")
    return dealt.mapInArrow(difference, f"`{key}` {kind}, url string, text string, n_chars long")
