"""Main text of web pages by site style trees.

The pages of one host are merged into one tree of elements (a path of tags with their first class).  For
each node the pages tell how its children are arranged (presentation) and what text it holds
(content).  A node whose arrangement and text hardly differ between the host's pages has a low
composite importance: such branches are menus, notices and footers, and are taken out of every page.
The fewer pages have a node the less its entropy says, so its importance is drawn towards 1.

Entropy can't tell noise whose text differs on every page (adverts, readers' comments, related pages) from
the page's own text.  What pages say by their tags, roles and class names is therefore used as well, as
prior knowledge, and is all there is for a host with one page.

Pages of a host with the same elements and texts count once, so copies of a page don't speak against its
text.  Copies are dealt by the digest of their page and counts per (host, node, feature) are pre-aggregated
before the shuffle; importances come up the tree level by level, from sums per (host, parent).  So a host
that holds a third of all pages is worked on in many tasks throughout.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, materialise, release, table
from quillspark.llm.url_filter import host_and_path

#: A branch goes if its importance is not above the first figure, inside an article not above the second.
LOW_IMPORTANCE, LOW_IN_ARTICLE = 0.35, 0.15
#: What draws the importance of a node that m pages have towards 1: its distance from 1 counts (m - 1) / (m - 1 + PRIOR) times.
PRIOR = 0.6
GAMMA = 0.9
#: Elements below this depth count as part of the one above them; their text stays.
MAX_DEPTH = 48

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]).*?(?:>|\Z)|\Z", re.S | re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml")}
_BLOCK = set("html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address nav header footer aside form fieldset details summary dialog hgroup menu search center".split())
_TEXT_LEVEL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption td th tr tbody thead tfoot".split())
_NOISE_TAG = set("head nav footer aside menu dialog button select option fieldset object embed canvas audio video datalist search".split())
_NOISE_ROLE = set("navigation banner contentinfo search complementary dialog alertdialog alert menu menubar toolbar tooltip".split())
_NOISE_CLASS = set(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus respond "
    "replies pagination pager widget widgets toolbar skip login search copyright teaser teasers".split()
)
#: Names of notes that belong to the text where they stand in an article.
_NOTE_CLASS = set("notice notices alert".split())
#: Names of readers' comments, which are no wrapper of the page's text however long they are.
_COMMENT_CLASS = set("comment comments commentlist disqus respond replies".split())
#: Words for a holder, before which the name proper stands: comments-area, share-buttons.
_HOLDER = set("area bar block body box button buttons container content group holder icons inner inside item items left link links list main outer panel posts right section top bottom title wrap wrapper".split())
_CLOSES_P = _BLOCK - {"html", "body", "head"}
_SAME_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Element:
    __slots__ = ("tag", "path", "parent", "noise", "named", "article", "main", "header", "children")

    def __init__(self, tag: str, path: str, parent: Element | None, noise: bool, article: bool, header: bool, named: str = "", main: bool = False):
        self.tag, self.path, self.parent, self.noise, self.article, self.header = tag, path, parent, noise, article, header
        self.named, self.main = named, main
        self.children: list[str] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if "=" in raw else {}


def _noise_name(name: str, article: bool) -> str:
    """The noise word that a class or id is, or ends in (before words for a holder); empty if there is none."""
    name = name.lower()
    words = [w for w in re.split(r"[-_]+", name) if w]
    while len(words) > 1 and words[-1] in _HOLDER:
        words.pop()
    for word in (name, words[-1] if words else ""):
        if word in _NOISE_CLASS and not (article and word in _NOTE_CLASS and not _NOISE_CLASS.intersection(words[:-1])):
            return word
    return ""


def _settle(elements: list[Element], blocks: list[tuple[Element, str]]) -> None:
    """Decide which elements are noise: those known by tag, role or being hidden are, with all below them.

    One that only has the name of noise, or is a form, is a wrapper instead if the page's main element,
    or most of its text (of its articles' text, if it has any), stands below it.
    """
    sure: set[int] = set()
    for e in elements:  # parents come first
        if e.noise or id(e.parent) in sure:
            sure.add(id(e))
    size, articles, mains = Counter(), Counter(), set()
    if any(e.named and id(e) not in sure for e in elements):
        for e, text in blocks:
            if id(e) not in sure:
                size[id(e)] += len(text)
                articles[id(e)] += len(text) if e.article else 0
                if e.main:
                    mains.add(id(e))
        for e in reversed(elements[1:]):
            size[id(e.parent)] += size[id(e)]
            articles[id(e.parent)] += articles[id(e)]
            if id(e) in mains:
                mains.add(id(e.parent))
    root = id(elements[0])
    share = articles if articles[root] else size
    inside = {id(e) for e in elements if e.article}
    for e in elements:
        noise = id(e) in sure or (e.parent is not None and e.parent.noise)
        if not noise and e.named:
            above = id(e) in inside  # an article above it, not below
            wraps = id(e) in mains and not above or 2 * share[id(e)] > share[root]
            if e.named in _COMMENT_CLASS and (above or not articles[id(e)]):
                wraps = False
            noise = not wraps
        e.noise = noise


def parse(html: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements of a page and its blocks of text in page order, each with the element it stands in."""
    root = Element("", "", None, False, False, False)
    elements, blocks, stack, text = [root], [], [root], []
    marks: list[tuple[int, int]] = []  # open noise inside a line: where its text and its element begin

    def flush() -> None:
        if text:
            pieces = [(text[: marks[0][0]], stack[marks[0][1] - 1]), (text[marks[0][0] :], stack[-1])] if marks else [(text, stack[-1])]
            for piece, element in pieces:
                add(piece, element)
            text.clear()
            marks[:] = [(0, i) for _, i in marks]

    def add(piece: list[str], element: Element) -> None:
        if joined := " ".join(unescape("".join(piece)).split()):
            blocks.append((element, joined))

    def cut(i: int) -> None:
        while marks and marks[-1][1] >= i:
            begin, at = marks.pop()
            add(text[begin:], stack[at])
            del text[begin:]
        del stack[i:]

    def close(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                cut(i)
                return
            if stack[i].tag in stop:
                return

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if name := m["end"]:
            name = name.lower()
            if name in _BLOCK or any(e.tag == name for e in stack[1:]):
                if name in _BLOCK:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        cut(i)
                        break
                    if stack[i].tag in ("article", "main", "body") and name not in ("body", "html", "article", "main"):
                        break
            continue
        name = (m["tag"] or m["odd"] or "").lower()
        if not name:
            continue
        if name in _RAW:
            at = _RAW[name].search(html, at).end()
            continue
        if name in ("br", "hr"):
            if name == "hr":
                flush()
            text.append(" ")
            continue
        raw = m["attrs"] or ""
        if raw.endswith("/") and name not in _BLOCK:
            continue
        attrs = _attributes(raw)
        noise = name in _NOISE_TAG
        own, named = attrs.get("class", "").split(), ""
        role = attrs.get("role", "").lower()
        if name not in ("html", "body", "article", "main"):
            names = [w for x in (*own, *attrs.get("id", "").split()) if (w := _noise_name(x, stack[-1].article))]
            named = next((w for w in names if w in _COMMENT_CLASS), names[0] if names else "form" if "form" in (name, role) else "")
            noise |= role in _NOISE_ROLE
        elif name == "article":
            noise |= any(w.startswith("comment") for x in own for w in re.split(r"[-_]+", x.lower()))
        noise |= attrs.get("aria-hidden", "") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", raw))
        if name not in _BLOCK and not noise and not named:
            continue
        if name in _BLOCK:
            flush()
        if name in _CLOSES_P:
            close({"p"}, _BLOCK - _TEXT_LEVEL - {"p"} | {"li", "td", "th", "dd", "blockquote"})
        if name in _SAME_CLOSES:
            close(*_SAME_CLOSES[name])
        if name not in _BLOCK:
            marks.append((len(text), len(stack)))
        parent = stack[-1]
        depth = len(stack)
        here = name + ("." + own[0].lower() if own else "")
        path = f"{parent.path}/{here}" if depth <= MAX_DEPTH else parent.path
        main = parent.main or name == "main" or role == "main"
        article = parent.article or name == "article" or main
        header = parent.header or name == "header" or "header" in own
        element = Element(name, path, parent, noise, article, header, named, main)
        parent.children.append(here)
        elements.append(element)
        stack.append(element)
    if at < len(html):
        text.append(html[at:])
    flush()
    _settle(elements, blocks)
    return elements, blocks


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _judged(element: Element) -> bool:
    """Whether the style tree has this element: not the trunk, nor the lines that stand in an article itself."""
    trunk = ("", "html", "body", "article", "main")
    return element.tag not in trunk and not (element.tag in _TEXT_LEVEL and element.parent.tag in ("article", "main"))


def _features(elements: list[Element], blocks: list[tuple[Element, str]]) -> set[tuple[str, int, int]]:
    found = set()
    for e in elements:
        if _judged(e):
            found |= {(e.path, 0, 0), (e.path, 1, _number("\n".join(e.children)))} if e.children else {(e.path, 0, 0)}
    for e, text in blocks:
        if _judged(e) and (e.tag in _BLOCK or not e.noise):
            found.add((e.path, 2, _number(text)))
    return found


def page_features(html: str) -> set[tuple[str, int, int]]:
    """(path, kind, feature): 0 the node itself, 1 its children's arrangement, 2 a text in it."""
    return _features(*parse(html))


def _page_digest(elements: list[Element], blocks: list[tuple[Element, str]]) -> bytes:
    """Equal for pages with the same elements and texts, whatever their scripts, comments and other attributes."""
    digest = hashlib.blake2b(digest_size=16)
    for part in (*(e.path for e in elements), "", *(x for e, text in blocks for x in (e.path, text))):
        digest.update(part.encode("utf-8", "replace") + b"\0")
    return digest.digest()


def extract(html: str, low: frozenset[str] | set[str] = frozenset()) -> str:
    """The blocks outside noise and outside the branches *low*; those of the article, where the page has one."""
    elements, blocks = parse(html)
    gone: dict[int, bool] = {}
    for e in elements:  # parents come first
        gone[id(e)] = e.noise or e.path in low or (e.parent is not None and gone[id(e.parent)])
    kept = [(e, text) for e, text in blocks if not gone[id(e)] and (not e.header or e.article and e.tag in _HEADINGS)]
    if any(e.article for e, _ in kept):
        kept = [x for x in kept if x[0].article]
    return "\n\n".join(text for _, text in kept)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, ``importance`` of the low branches of every host, from *pages* (``host``, ``html``)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            rows, seen = [], set()
            for host, html in zip(batch["host"], batch["html"]):
                parsed = parse(html)
                page = _page_digest(*parsed)
                if (host, page) not in seen:
                    seen.add((host, page))
                    rows += [(host, page, *x) for x in _features(*parsed)]
            yield pd.DataFrame(rows, columns=["host", "page", "path", "kind", "feature"])

    found = pages.select("host", "html").mapInPandas(features, "host string, page binary, path string, kind int, feature long").distinct()
    counted = found.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    n = F.col("n")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    # presentation: minus sum p ln p = ln m - sum n ln n / m for the m pages that have children there
    nodes = counted.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("pages"), of(2, F.lit(1.0)).alias("texts"), of(2, F.log(n)).alias("text_entropy"), of(1, F.lit(1.0)).alias("styles"), of(1, n * F.log(n)).alias("_nlogn"), of(1, n).alias("_m")
    )
    nodes = nodes.select("host", "path", "pages", "texts", "text_entropy", "styles", F.when(F.col("_m") > 0, F.log("_m") - F.col("_nlogn") / F.col("_m")).otherwise(0.0).alias("style_entropy"))
    parent = F.expr("substring(path, 1, length(path) - instr(reverse(path), '/'))")
    depth = F.expr("length(path) - length(replace(path, '/', ''))")
    nodes = materialise(nodes.withColumn("parent", parent).withColumn("depth", depth), "style-tree-nodes")
    # children that only one page has tell nothing and count as important
    none = F.lit(0.0)
    singles = nodes.filter("pages = 1").groupBy("host", F.col("parent").alias("path")).agg(F.count("*").cast("double").alias("value"), F.count("*").alias("n"))
    sums = singles = materialise(singles, "style-tree-singles")
    levels = []
    for level in range(nodes.filter("pages > 1").agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = nodes.filter((F.col("pages") > 1) & (F.col("depth") == level)).join(sums, ["host", "path"], "left")
        scale = F.log("pages")
        below = F.coalesce("value", none) + F.when(F.col("texts") > 0, 1 - F.col("text_entropy") / scale / F.col("texts")).otherwise(none)
        parts = F.coalesce("n", F.lit(0)) + (F.col("texts") > 0).cast("int")
        inner = F.when(parts > 0, below / F.greatest(parts, F.lit(1))).otherwise(none)
        weight = F.pow(F.lit(GAMMA), F.col("styles"))
        value = F.when(F.col("styles") > 0, (1 - weight) * F.col("style_entropy") / scale + weight * inner).otherwise(inner)
        here = here.select("host", "path", "parent", "pages", F.least(F.lit(1.0), F.greatest(none, value)).alias("value"))
        levels.append(materialise(here, "style-tree-level"))
        above = levels[-1].groupBy("host", F.col("parent").alias("path")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
        sums = singles.unionByName(above).groupBy("host", "path").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    if not levels:
        return nodes.select("host", "path", none.alias("importance")).limit(0)
    judged = reduce(DataFrame.unionByName, levels)
    importance = 1 - (1 - F.col("value")) * (F.col("pages") - 1) / (F.col("pages") - 1 + PRIOR)
    tag = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    inside = F.col("path").rlike(r"/(article|main)(\.[^/]*)?(/|$)")
    low = F.when(inside, (F.col("importance") <= LOW_IN_ARTICLE) & ~tag.isin(*sorted(_TEXT_LEVEL))).otherwise(F.col("importance") <= LOW_IMPORTANCE)
    return judged.select("host", "path", importance.alias("importance")).filter(low)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for each row of *pages* (``page_id``, ``url``, ``html``).

    A null html is an empty page and gives an empty text.  Pages with a null url, or one without a
    host, have no style tree in common and are judged by their own tags.  Unclosed and unfinished tags
    are closed as browsers do.  Very long pages are taken whole; elements below ``MAX_DEPTH`` count as part
    of the one above them.  A branch whose importance is exactly the limit goes.  Repeated rows give equal
    results; other columns are ignored; an empty table gives none.
    """
    host, _ = host_and_path(F.col("url"))
    rows = bounded_batches(pages).select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    # a host's list has its low branches that at least two different pages share, however many pages there are
    low = style_tree(rows.filter("host <> ''")).groupBy("host").agg(F.collect_list("path").alias("low"))
    low = materialise(low, "style-tree-low")
    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(html, frozenset(() if paths is None else paths)) for html, paths in zip(batch["html"], batch["low"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
