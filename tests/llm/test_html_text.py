import math
from collections import Counter

import pytest

from quillspark.llm.html_text import LOW_IMPORTANCE, PRIOR, _judged, extract, main_text, page_features, parse, style_tree

SCHEMA = "page_id long, url string, html string, text string, low string"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a &amp; b &lt;c&gt; &eacute;&#8212;&#x41;", "a & b <c> é—A"),
        ("<p>one<p>two\n  lines<br>here<div>three</div>", "one\n\ntwo lines here\n\nthree"),
        ("<nav>menu</nav><header>top</header><article><h1>T</h1><p><b>x <i>y</b> z</article><footer>f</footer>", "T\n\nx y z"),
        ("<body><div class='post'><h2>Q</h2><p>text</p></div><aside>side</aside><form>f<input></form><script>if(a<b)</script><style>p{}</style>", "Q\n\ntext"),
        ("<article><p>a<div class=ad>no</div><p>b</p><section class='comments'><p>reader</p></section></article>out", "a\n\nb"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</article>", "T\n\nx"),
        ("<p>u <span class='ad'>no</span> v <button>no</button>w<!-- c --> <a href=\"/x?a=1&am", "u v w"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<div role='navigation'>n</div><p aria-hidden=true>h</p><p hidden>i</p><p style='display: none'>j</p><p>k</p>", "k"),
        ("<html><body class='has-sidebar menu'><main><p>kept</p></main><div class='cookie-notice'>c</div></body>", "kept"),
        ("<article><h1>T</h1><div class='social-history'><p>A text of it.</p></div><p>See <label>this word</label> and <map>that</map> here.</p></article>", "T\n\nA text of it.\n\nSee this word and that here."),
        ("<p>unfinished <b>tag", "unfinished tag"),
        ("<title>t</title><textarea>x</textarea><p>" + "long " * 20_000, ("long " * 20_000).strip()),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_extract(html, want):
    assert extract(html) == want


def test_parse_gives_paths():
    elements, blocks = parse("<body><div class='a b'><p>x</div>")
    assert [e.path for e in elements] == ["", "/body", "/body/div.a", "/body/div.a/p"] and blocks[0][0] is elements[-1]
    assert ("/body/div.a/p", 0, 0) in page_features("<body><div class='a b'><p>x</div>")


def page(i, template):
    unique = "".join(f"<p>Paragraph {i} number {k} with its own words {i * k}.</p>" for k in range(4))
    return f"<body><div class='x1'><ul><li>Home</li><li>About</li></ul></div><div class='x2'>{unique}</div><div class='x3'>All rights belong to {template}</div></body>"


def test_style_tree_finds_branches_without_names(spark):
    rows = [(i, f"http://site{i % 2}.org/{i}", page(i, i % 2), "clash", "clash") for i in range(20)] + [(100, "http://lone.org/", page(7, 9), "", ""), (101, None, page(7, 9), "", ""), (102, "http://site0.org/", None, "", ""), (102, "http://site0.org/", None, "", "")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(20):
        assert got[i].text == "\n\n".join(f"Paragraph {i} number {k} with its own words {i * k}." for k in range(4))
        assert got[i].n_chars == len(got[i].text) and got[i].url == rows[i][1]
    assert got[100].text == extract(rows[20][2]) == got[101].text and "Home" in got[100].text
    assert (got[102].text, got[102].n_chars) == ("", 0)
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def slow_importances(pages):
    """path -> (pages that have it, importance), from the definition, over different pages."""
    trees = {}
    for html in pages:
        elements, blocks = parse(html)
        judged = {e.path for e in elements if _judged(e)}
        styles = {(e.path, "\n".join(e.children)) for e in elements if e.children and e.path in judged}
        texts = {(e.path, t) for e, t in blocks if e.path in judged and not (e.noise and e.tag not in ("div", "ul", "li", "p"))}
        trees[(tuple(e.path for e in elements), tuple((e.path, t) for e, t in blocks))] = (judged, styles, texts)
    count = lambda i: Counter(x for tree in trees.values() for x in tree[i])
    n, styles, texts = count(0), count(1), count(2)

    def value(path):
        m = n[path]
        mine = [c for (p, _), c in styles.items() if p == path]
        parts = [1.0 if n[p] == 1 else value(p) for p in n if p.rpartition("/")[0] == path]
        held = [c for (p, _), c in texts.items() if p == path]
        if held:
            parts.append(1 - sum(math.log(c) / math.log(m) for c in held) / len(held))
        inner = sum(parts) / len(parts) if parts else 0.0
        if not mine:
            return inner
        share = [c / sum(mine) for c in mine]
        w = 0.9 ** len(mine)
        return (1 - w) * -sum(x * math.log(x) for x in share) / math.log(m) + w * inner

    return {p: 1 - (1 - min(1, max(0, value(p)))) * (n[p] - 1) / (n[p] - 1 + PRIOR) for p in n if n[p] > 1}


def test_importances_against_their_definition(spark):
    pages = [page(i, i % 3 and 1) for i in range(12)] + [page(3, 1)] * 4 + ["<body><div class='x1'><ul><li>Home</li></ul></div><div class='x4'><div><p>deep</p></div></div></body>"]
    rows = spark.createDataFrame([("h", x) for x in pages], "host string, html string")
    got = {r.path: r.importance for r in style_tree(rows).collect()}
    want = {p: v for p, v in slow_importances(pages).items() if v <= LOW_IMPORTANCE}
    assert got == pytest.approx(want) and "/body/div.x1" in got and "/body/div.x2" not in got


def test_copies_of_an_article_keep_their_text(spark):
    html = "<nav>menu</nav><article><h1>T</h1><p>The same text on every page.</p></article>"
    rows = [(i, f"http://a.org/{i}", html, "", "") for i in range(30)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T\n\nThe same text on every page."}


@pytest.mark.parametrize("copies", [3, 5, 30])
def test_copies_of_a_page_keep_their_text(spark, copies):
    text = "<p>The same text on every page.</p><p>And more of it.</p>"
    pages = {"div": f"<body><div class='content'>{text}</div></body>", "article": f"<body><article><div class='entry-content'>{text}</div></article></body>"}
    rows = [(i, f"http://{kind}.org/{i}", html + f"<script>var id = {i}</script>", "", "") for kind, html in pages.items() for i in range(copies)]
    # copies beside other pages of the host, whose common branches still go
    rows += [(1000 + i, f"http://mixed.org/{i}", page(i, 1), "", "") for i in range(20)] + [(2000 + i, "http://mixed.org/copy", page(7, 1).replace("x2", "only-here"), "", "") for i in range(copies)]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id < 1000} == {"The same text on every page.\n\nAnd more of it."}
    assert all(r.text == "\n\n".join(f"Paragraph {k} number {j} with its own words {k * j}." for j in range(4)) for r in got for k in [r.page_id - 1000 if r.page_id < 2000 else 7] if r.page_id >= 1000)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='layout with-sidebar'><nav>n</nav><div class='sidebar'>s</div><main><p>kept</p></main></div>", "kept"),
        ("<div id='no-nav'><article><p>kept</p></article></div><p>out</p>", "kept"),
        ("<div class='content share-enabled'><p>kept</p></div><div class='share-buttons'>s</div>", "kept"),
        ("<body><form id='aspnetForm'><div class='menu'>m</div><div class='post'><p>one two</p></div></form></body>", "one two"),
        ("<app-root class='with-sidebar'>menu<main><p>kept</p></main></app-root>", "kept"),
        ("<article><section class='related-work'><p>a</p></section><p class='notice'>b</p><p>c</p></article>", "a\n\nb\n\nc"),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='t'>x=1</annotation></math> be</p>", "let x=1 be"),
        # what only looks like a wrapper stays noise
        ("<article><p>a text</p></article><div class='related-posts'><article><p>teaser</p></article></div>", "a text"),
        ("<div class='post'><p>short</p></div><div class='comments-area'><p>a long comment of a reader</p></div>", "short"),
        ("<div class='post'><p>a text of a page</p></div><form><p>subscribe</p></form>", "a text of a page"),
        ("<aside class='layout'><article>x</article></aside><div>text</div>", "text"),
    ],
)
def test_wrappers_with_names_of_noise(html, want):
    assert extract(html) == want
