"""Layout of pages, and all visible text against a plain reading of the markup."""

import re
from html.parser import HTMLParser

import pytest

from millwright.llm.htmltext import extract_text, page_text


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>name<th>n<tr><td>a<td>100<tr><td>bcd<td>2</table>", "name | n\na    | 100\nbcd  | 2"),
        ("a <b>bold</b>, <i> x </i>y<br>z", "a bold, x y\nz"),
        ("<pre>a  b\n c</pre>", "a  b\n c"),
        ("<p hidden>no</p><p style='color:red; display : none'>no</p><div style=visibility:hidden>no</div>yes", "yes"),
        ("<head><title>no</title><script>if (a<b) x('</p>')</script><style>p{}</style></head><body>yes<noscript>no</noscript><template>no</template>", "yes"),
        ("a<!-- <p>no -->b<!-- open", "ab"),
        ("&lt;b&gt; &amp;amp; caf&eacute;", "<b> &amp; café"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
        ("<details><summary>s</summary>hidden</details><details open>shown</details>", "s\nshown"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<p>a</b></i></div>b</p>c", "ab\n\nc"),
        ("<table><tr><td>out<table><tr><td>in<td>side</table><td>end</table>", "out       | end\n          |\nin | side |"),
        ("<a title='x > y'>q</a><img alt='no'>", "q"),
        ("text < 3 and <", "text < 3 and <"),
        ("<p><a title=it's href=x>hello</a> world</p><p>they don't go</p><p>end</p>", "hello world\n\nthey don't go\n\nend"),
        ("a <b class=\"x>bold</b> c", "a bold c"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>end", "yes\nend"),
        ("<table><tr><th colspan=2>head<th>n<tr><td>a<td>bb<td>1</table>", "head   | n\na | bb | 1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=2>much longer<tr><td>a<td>b</table>", "much longer\na | b"),
        ("<a x='1' y=2 z>q</a><br/>r<img src=x/>s", "q\nrs"),
        ("<!doctype html><?xml?></>a", "a"),
        ('<p>before <svg class="icon"/> after the icon</p>', "before after the icon"),
        ("<body><svg/>one<p>two</p></body>", "one\n\ntwo"),
        ("a<svg><title>no</title><defs><text>no</text></defs><path d=x/><text>label</text></svg>b", "a\nlabel\nb"),
        ("<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>", "x+1"),
        ("<svg><style/><g>open<p>out", "open\n\nout"),
        ("<input value=v><input type=hidden value=no><input type=checkbox value=no>", "v"),
        ("<b style='display:none;display:inline'>yes</b><b style='display:none !important;display:inline'>no</b>", "yes"),
        ("a</br>b", "a\nb"),
        ("<details open>a</details>b", "a\nb"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
        ("", ""),
        (None, ""),
    ],
)
def test_layout(markup, text):
    assert page_text(markup) == text


def test_deep_nesting_keeps_its_text():
    assert page_text("<div>" * 5000 + "deep" + "</div>" * 5000 + " end") == "deep\nend"
    assert page_text("<b>" * 100_000 + "x") == "x"
    for hidden in ("<div style='display:none'>SECRET</div>", "<noscript>SECRET</noscript>", "<video>SECRET</video>"):
        assert page_text("<div>" * 205 + hidden + "shown") == "shown"
        assert page_text("<ul><li>" * 500 + hidden + "shown").split()[-1] == "shown"
    assert page_text("<table><tr><td>" * 300 + "deep").split()[-1] == "deep"


@pytest.mark.parametrize(
    "markup",
    [
        "<table><tr><td>" + "w" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 50_000,
        "<table>" + "<tr><td rowspan=60000>x" * 40_000,
        "<table><tr>" + f"<td>{'w' * 90}" * 1000 + "<tr><td colspan=1000>x<td>y" * 30_000,
        "<ul><li>x" * 100_000,
        "<p><button>" + "<div>" * 150_000,
        "x<b>y</b>" * 100_000,
    ],
)
def test_wide_and_deep_pages_take_bounded_memory_and_time(markup):
    import time

    start = time.process_time()
    assert len(page_text(markup)) < 100_000_000
    assert time.process_time() - start < 30


def test_a_wide_cell_is_whole_and_others_stay_aligned():
    wide = "w" * 500
    assert page_text(f"<table><tr><td>{wide}<td>1<tr><td>abc<td>2<tr><td>a<td>3</table>") == f"{wide} | 1\nabc | 2\na   | 3"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_no_visible_word_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        if re.search("hidden|display|visibility|details|<select", r.html):
            continue
        plain = Plain()
        plain.feed(r.html)
        strip = lambda s: re.sub(r"[\s|]|^\s*(-|\d+\.) ", "", s, flags=re.M)
        assert strip(found[r.page_id].text).replace("-", "") == strip("".join(plain.words)).replace("-", "")


def test_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "<p>x", "old", None), (2, None, "old", 5)], "page_id long, html string, text string, n int")
    assert [tuple(r) for r in extract_text(pages).orderBy("page_id").collect()] == [(1, None, "x"), (2, 5, "")]
    assert extract_text(pages.filter("false")).count() == 0


@pytest.mark.parametrize("piece", ["<a x='", '<a x="', "<a x=", "<", "<!--", "<a b=c d", "</", "<td colspan=1000>x", "<p><b><i>", "<script>", "<a x='y", "<table><tr>", "&amp", "<a =", "<title>x"])
def test_long_hostile_markup_takes_linear_time(piece):
    import time

    start = time.process_time()
    page_text(piece * (300_000 // len(piece)))
    assert time.process_time() - start < 20


def test_repeated_rows_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x", 2), (1, "<p>a", "x", 2), (None, None, None, None)], "page_id long, html string, text string, n_chars int")
    got = sorted(map(tuple, extract_text(pages).select("page_id", "text").collect()), key=str)
    assert got == [(1, "a"), (1, "a"), (None, "")]
