import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.llm import html_text
from pathloom.llm.html_text import visible_text

CASES = {
    "<p>One<p>two <b>three</b>\n four": "One\n\ntwo three four",
    "a<br>b<br><br>c": "a\nb\nc",
    "<p>a <object>fallback</object><p>b<object data=x.pdf>gone</object><p>c": "a fallback\n\nb\n\nc",
    "<p>a<p hidden=until-found>b<p hidden>c<p>d": "a\n\nd",
    "<h1>T</h1><div>x</div><div>y</div><p>z</p>": "T\n\nx\ny\n\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=3><li>a<li value=9>b<li>c</ol>": "3. a\n9. b\n10. c",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<table><tr><th>Name<th>Age<tr><td>Al<td>7<tr><td>Barbara<td>31</table>": "Name     Age\nAl       7\nBarbara  31",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "wide  z\na  b  c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><td>a<br>bb<td>c</table>": "a   c\nbb",
    "<table><caption>Cap</caption><tr><td>x</table>": "Cap\nx",
    "<pre>\n a\n  b</pre>t": " a\n  b\n\nt",
    "<blockquote>q<p>r</blockquote>s": "    q\n\n    r\n\ns",
    "<script>var a='</p>';</script>v<style>p{}</style><template>t</template><noscript>n</noscript>": "v",
    "<p hidden>x</p><p style='color:red; display: NONE'>y</p><i style='visibility:hidden'>w</i>z": "z",
    "<head><title>t</title></head><body>b": "b",
    "<title>t</title>b": "b",
    "1 < 2 &amp; 3 &lt; 4 <!-- c --> 5": "1 < 2 & 3 < 4 5",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<img alt='pic'> x <input value=v><input type=hidden value=h>": "pic x v",
    "<select><option>a<option>b</select>": "a\nb",
    "<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>": "s\n\nt\ny",
    "<a href=\"x>y\" title='>'>l</a></b></p>m": "l\n\nm",
    "x<textarea> a\n b</textarea>": "x\n a\n b",
    "": "",
    "<<p>": "<",
    "<p": "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page)[0] == CASES[page]


HEADS = {
    "<head><title>t</title>plain <a href=x>link</a> text": "plain link text",
    "<head><title>t</title><meta name=a><font><p>one<p>two": "one\n\ntwo",
    "<html><head>\n<link rel=a>\n<style>s</style><script>c</script><noscript>n</noscript><x-tag>custom</x-tag> y": "custom y",
    "<head><title>t</title><img alt=pic><button>b</button>": "picb",
    "<head><title>t</title></br>x": "x",
    "a <svg width=1><title>t</title><defs><text>n</text></defs><g/>.<text x=1>shown <tspan>too</tspan></text><path d='m'/><text>more</text></svg> b": "a shown too more b",
    "<svg><title/><text>x</text><foreignObject><p>y</p></foreignObject></svg>z": "x\n\ny\n\nz",
    "let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>.": "let x=1.",
    "<svg><path><p>broken out</p>": "broken out",
}


@pytest.mark.parametrize("page", HEADS)
def test_end_of_head_and_foreign_text(page):
    assert visible_text(page)[0] == HEADS[page]


@pytest.mark.parametrize("deep", ["<b>" * 300, "<font>x<br>" * 400, "<div>" * 60_000, "<table><tr><td>" * 300])
def test_hidden_and_laid_out_at_any_depth(deep):
    page = deep + "<script>s</script><style>t</style><i hidden>h</i><p style='display:none'>d</p><ul><li>a<li>b</ul><pre>c  d\ne</pre><table><tr><td>f<td>g<tr><td>hhh<td>i</table>end"
    lines = [line for line in visible_text(page)[0].split("\n") if line.strip() not in ("", "x")]
    assert lines == ["- a", "- b", "c  d", "e", "f    g", "hhh  i", "end"]


def test_end_tags_close_their_own_element_at_depth():
    assert visible_text("<div hidden>" + "<div>" * 300 + "</div>" * 300 + "no</div>yes")[0] == "yes"


def test_wide_tables_are_aligned():
    cells = lambda w: "<tr>" + "".join(f"<td>{w if k % 2 else k % 10}" for k in range(100))
    lines = visible_text(f"<table>{cells('abc')}{cells('d')}</table>")[0].split("\n")
    assert len(lines) == 2 and all(lines[1][k] == "d" for k, c in enumerate(lines[0]) if c == "a")
    assert [k for k, c in enumerate(lines[0]) if c.isdigit()] == [k for k, c in enumerate(lines[1]) if c.isdigit()]


INLINE, BLOCK, HIDDEN = ["b", "i", "span", "a"], ["div", "p", "section", "h2", "ul", "li", "table", "tr", "td", "blockquote"], ["script", "style", "template"]


class Plain(HTMLParser):
    """Words outside hidden elements, for well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag in HIDDEN or "hidden" in dict(attrs))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if not any(self.stack):
            self.words += data.split()


def well_formed(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth > 5:
            out.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))) + " ")
        elif kind < 0.55:
            name = rng.choice(HIDDEN)
            out.append(f"<{name}>x{rng.randrange(99)}</{name}> ")
        elif kind < 0.7:
            name = rng.choice(INLINE)
            out.append(f"<{name}{' hidden' if rng.random() < 0.2 else ''}>{well_formed(rng, depth + 1)}</{name}> ")
        elif kind < 0.8:
            cells = "".join("<tr>" + "".join(f"<td>{well_formed(rng, depth + 2)}</td>" for _ in range(2)) + "</tr>" for _ in range(2))
            out.append(f"<table>{cells}</table>")
        elif kind < 0.9:
            out.append("<ul>" + "".join(f"<li>{well_formed(rng, depth + 1)}</li>" for _ in range(2)) + "</ul>")
        else:
            name = rng.choice(["div", "section", "blockquote", "h2"])
            out.append(f"<{name}{' hidden' if rng.random() < 0.2 else ''}>{well_formed(rng, depth + 1)}</{name}>")
    return "".join(out)


def test_every_visible_word_once():
    rng = random.Random(5)
    for _ in range(150):
        page = well_formed(rng)
        words = [w for w in visible_text(page)[0].split() if w != "-"]
        assert Counter(words) == Counter(Plain(page).words)
        if "<table>" not in page:
            assert words == Plain(page).words


@given(st.text(alphabet="<>/ap!-\"'= tdrulih&;\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_never_fails(page):
    text, _ = visible_text(page)
    assert text is not None


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<table><tr><td>" * 5_000 + "x", "<!--" * 50_000, "<a '\"" * 30_000, "<p>" * 100_000 + "x", "<li>a" * 50_000, "<" * 200_000, "</b>" * 50_000, "<script>" * 20_000, "<td colspan=1000>a" * 3_000, "word " * 400_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    visible_text(page)
    assert time.time() - began < 20


def test_table_of_pages(spark):
    rows = [(1, "<p>a<p>b"), (2, None), (None, ""), (1, "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(0))
    got = sorted(((r.page_id or 0, r.text, r.n_blocks, r.n_chars) for r in html_text.extract(pages).collect()), key=str)
    assert got == [(0, "", 0, 0), (1, "a\n\nb", 2, 4), (1, "a\n\nb", 2, 4), (2, None, 0, None)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_visibility_is_inherited_and_shown_again():
    text = lambda page: html_text.visible_text(page)[0]
    assert text('<div style="visibility:hidden">a <b style="VISIBILITY : visible">b</b> c<img alt=d></div>e') == "b\ne"
    assert text('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b<li><i style="visibility:initial">c</i></ul>') == "- b\n  c"
    assert text('<table style="visibility:collapse"><tr><td>a<td style="visibility:visible">b<tr style="visibility:visible"><td>c<td>d</table>') == "   b\nc  d"
    assert text('<div style="visibility:visible;visibility:hidden">a<p hidden style="visibility:visible">b</p></div>') == ""
    assert text('<div style="display:none">a<b style="visibility:visible">b</b></div>c') == "c"
    assert text("<body style=visibility:hidden>a<hr><q>b</q><p style=visibility:visible>c") == "c"
    deep = "<div style=visibility:hidden>" + "<b>" * 3000 + "x<i style=visibility:visible>y<script>z</script>"
    assert text(deep) == "y"


@pytest.mark.parametrize("depth", [1, 190, 300, 5000])
def test_rules_hold_at_any_depth(depth):
    page = "<b>" * depth + "<script>var leaked=1</script><p hidden>secret</p><svg><text>drawn</text></svg><math><mi>m</mi></math><ul><li>x</ul>"
    assert html_text.visible_text(page)[0] == "drawn m\n\n- x"
