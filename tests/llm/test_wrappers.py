"""HTML extraction: marked-up pages, wrappers of hosts, simple tree matching against its definition, broken markup."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillspark.llm import wrappers

SCHEMA = "page_id long, url string, html string"


def only(source):
    return wrappers.extracted(wrappers.Page(source), None, {})


def plain_article(source):
    """The text between <article> and its end, by patterns that hold for the given pages alone."""
    found = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?p>|</?h1>", found[1] if found else ""))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("most", [wrappers.BROADCAST, -1])
def test_given_pages(spark, sf, most):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = wrappers.with_texts(pages.selectExpr("*", "'x' AS host", "1 AS wrapper", "2 AS text"), most=most).collect()
    expected = {r.page_id: (r.url, plain_article(r.html)) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.n_chars == len(r.text) for r in rows)


CHROME = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header class="site"><a href="/">Site name</a></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="top-ad-1">Buy now</div>
{body}
<aside><p>Aside text</p></aside><section id="comments"><article class="comment"><p>First!</p></article></section>
<form action="/s"><input name=q><p>Subscribe to us</p></form><footer>&copy; all rights</footer></body></html>"""


def test_elements_around_an_article():
    body = '<main><article><header><h1>Title &amp; more</h1></header><p>One\n  two&nbsp;three<br>four <a href="x">link</a>.<p>Five <b>six</b></p><div class="share-buttons">Share</div><ul><li>item a<li>item b</ul><footer>Posted</footer></article></main>'
    assert only(CHROME.replace("{body}", body)) == "Title & more\nOne two three four link.\nFive six\nitem a\nitem b"


def test_without_article_the_part_with_most_text_counts():
    text = "Long enough to be the content of the page, as it goes on. " * 5
    body = f'<div id="wrap"><h1>Head</h1><div class="x9"><p>{text}</p><p>{text}</p></div><div class="x8"><a href=1>more</a> <a href=2>and more</a></div></div>'
    assert only(CHROME.replace("{body}", body)).split("\n") == ["Head", text.strip(), text.strip()]
    assert only(f"<form><p>{text}</p></form>") == text.strip()  # a form around the page
    assert only("<p>a</p><div hidden>b</div><div style='display: none'>c</div><p aria-hidden=true>d") == "a"


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", ""), ("plain text", "plain text"), ("<nav>only a menu</nav>", ""), ("<p>a<p>b", "a\nb"), ("<p><b>a<br><p>c</p></b>", "a\nc"), ("<article>unfinished <p", "unfinished <p"), ("a &lt;b&gt; &#x41;&#66; &nope; &amp", "a <b> AB &nope; &"),
        ("<!-- x --><p>y</p><!-- never ends <p>z</p>", "y"), ("<script>while (a < b) {}</p>", ""), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ('<p title="a > b">t</p>', "t"), ('<p title="open>t</p><p>u</p>', "t\nu"), ("</div></p>x</li>", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<head><meta charset=x><p>no body tag</p>", "no body tag"), ("<title>never closed <p>t</p>", "never closed\nt"), ("<P>Upper</P><ARTICLE>case</ARTICLE>", "case"),
    ],
)
def test_markup(source, expected):
    assert only(source) == expected


def test_deep_and_long_pages_end_in_time():
    assert only("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert only("<a '" * 50_000) is not None and only('<b "' * 50_000) is not None and only("<" * 200_000) == "<" * 200_000
    assert only("<p>w</p>" * 50_000).count("\n") == 49_999
    tree = wrappers.Page("<div><span>" * 3_000 + "x").folded()[0]
    assert wrappers.matched(tree, wrappers.Page("<div><span>" * 2_000 + "x").folded()[0])[5] == 5


def site(k, body, name="h.example"):
    """A page without any marks of its parts: what is template shows only by being the same on others."""
    return k, f"http://{name}/{k}", f'<body><div class="q1">Welcome to our site, dear reader of these pages</div><div class="q2"><h2>{body} heading</h2><div class="q3"><p>Intro of all pages</p></div><p>{body}</p></div><div class="q4">Last words of each page</div></body>'


def test_what_is_the_same_on_a_host_is_template(spark):
    rows = [site(k, f"Text number {k} with words of its own w{'w' * k}") for k in range(9)] + [site(20, "alone", "other.example"), (21, None, "<p>no url</p>"), (22, "nothing", None), (None, "http://H.example/x", site(3, "copy " * 9)[2])]
    rows += [rows[4]]
    found = wrappers.with_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {}
    for r in found:
        texts.setdefault(r.page_id, set()).add(r.text)
    assert len(found) == len(rows) and all(len(t) == 1 for t in texts.values())
    for k in range(9):
        body = f"Text number {k} with words of its own w{'w' * k}"
        assert texts[k] == {f"{body} heading\n{body}"}
    assert "Intro of all pages" in next(iter(texts[20])) and texts[21] == {"no url"} and texts[22] == {""} and texts[None] == {"copy copy copy copy copy copy copy copy copy heading\n" + " ".join(["copy"] * 9)}


def test_copies_are_no_template(spark):
    rows = [site(k, "The very same article in many copies") for k in range(12)] + [site(50, "Another one that differs")]
    texts = {r.text for r in wrappers.with_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("article in many copies" in t or "that differs" in t for t in texts) and len(texts) == 2


def test_empty_table(spark):
    assert wrappers.with_texts(spark.createDataFrame([], SCHEMA)).collect() == []


TREES = st.recursive(st.sampled_from("abc").map(lambda c: (c, ())), lambda below: st.tuples(st.sampled_from("abc"), st.lists(below, max_size=4).map(tuple)), max_leaves=12)


def text_of(tree):
    lines, todo = [], [(-1, tree)]
    while todo:
        up, (label, below) = todo.pop(0)
        lines.append(f"{up} {label}")
        todo += [(len(lines) - 1, c) for c in below]
    return "\n".join(lines)


def plain_matching(x, y):
    if x[0] != y[0]:
        return 0
    rows = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
    for i, c in enumerate(x[1], 1):
        for j, d in enumerate(y[1], 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + plain_matching(c, d))
    return 1 + rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(TREES, TREES)
def test_simple_tree_matching(x, y):
    a, b = text_of(("r", (x,))), text_of(("r", (y,)))
    to = wrappers.matched(a, b)
    assert sum(t >= 0 for t in to) == plain_matching(("r", (x,)), ("r", (y,)))
    left, right = wrappers.Folded(a), wrappers.Folded(b)
    kept = [t for t in to if t >= 0]
    assert len(set(kept)) == len(kept) and all(left.labels[t] == right.labels[k] for k, t in enumerate(to) if t >= 0)
    for k, below in enumerate(right.below):
        found = [to[c] for c in below if to[c] >= 0]
        assert found == sorted(found) and all(c in left.below[to[k]] for c in found)
