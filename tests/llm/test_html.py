import re
import time
from html.parser import HTMLParser

import pytest

from newsgauge.llm import html_text, registry

PAGES = [
    ("<p>One<p>Two &amp; three<br>four", "One\n\nTwo & three\nfour"),
    ("<ul><li>a<li>b<ol><li>c</li><li>d</ol><li>e</ul>after", "- a\n- b\n  1. c\n  2. d\n- e\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
    ("<div hidden>no</div><div style='display: none'>no<p>no</div>tail <b>bold</b>  text", "tail bold text"),
    ("<head><title>t</title><style>p{}</style></head><script>if(a<b)'</p>'</script>x<!-- c -->y", "xy"),
    ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a < b & c &lt; d", "a < b & c < d"),
    ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("<b><p>x</b>y</p>", "x\n\ny"),
    ("<table><caption>Cap</caption><tr><td>a<p>b</p></td><td>c</td></tr></table>", "Cap\na  c\nb"),
    ("<a title='x > y'>k</a>", "k"),
    ("", ""),
    (None, ""),
    ("<script>never closed", ""),
    ("<p", "<p"),
    ("<!doctype html><html><body>&copy; &nonsense;", "© &nonsense;"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_layout(page, want):
    assert html_text.page_text(page) == want


def test_bad_markup_ends():
    assert html_text.page_text("<div>" * 5000 + "deep").strip() == "deep"
    assert html_text.page_text("<a '" * 2000 + "x") is not None
    assert html_text.page_text("<ul><li>" * 3000 + "x").endswith("x")
    assert len(html_text.page_text("<p>word " * 50_000)) > 200_000


def test_frame(spark):
    rows = [(i, "u", p, "clash") for i, (p, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "clash"), (None, None, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text"}
    want = [(i, w) for i, (_, w) in enumerate(PAGES)] + [(0, PAGES[0][1]), (None, "x")]
    assert sorted(((r["page_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert html_text.extract(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["op7_html_text"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r["text"] == html_text.page_text(pages[r["page_id"]]) for r in rows)
    assert not any("margin:0" in r["text"] or "track(" in r["text"] or "<p>" in r["text"] for r in rows)


SHOWN = [
    ('<a title="Find hidden gems">a</a> <div class="menu hidden md:flex">b</div>', "a\nb"),
    ("<p title='style=display:none'>a<p HIDDEN=false>no<p style='color:red; DISPLAY : none'>no", "a"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<p style='display:none;display:block'>a", "a"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
    ("<svg><title>no</title><defs/><path d='m'/><text>one</text><text>two</text></svg>z", "one\ntwo\nz"),
    ("<span>" * 300 + "<table><tr><td>a<td>b", "a  b"),
    ("<font>" * 300 + "<p>a<p style='display:none'>no<p>b<ul><li>c<li>d</ul>", "a\n\nb\n\n- c\n- d"),
]


@pytest.mark.parametrize(("page", "want"), SHOWN)
def test_visibility_and_depth(page, want):
    assert html_text.page_text(page) == want


def test_depth_has_no_bound():
    assert html_text.page_text("<div>" * 100_000 + "<table><tr><td>a<td>b") == "a  b"
    assert html_text.page_text("<pre>" + "<b>" * 100_000 + "x") == "x"


TABLES = [
    ("<table><tr><td colspan=2>Head<td>Z<tr><td>a<td>bbb<td>c</table>", "Head    Z\na  bbb  c"),
    ("<table><tr><td>a<td>b<tr><td colspan='2'>a long heading over both<tr><td>cc<td>d</table>", "a   b\na long heading over both\ncc  d"),
    ("<table><tr><td colspan=0>a<td colspan=x>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    (f"<table><tr><td>{'x' * 60}<td>b<tr><td>c<td>d</table>", f"{'x' * 60}  b\nc  d"),
]


@pytest.mark.parametrize(("page", "want"), TABLES)
def test_tables_are_aligned(page, want):
    assert html_text.page_text(page) == want


def test_comments_and_signs_at_the_end():
    for page, want in [("a<!-- no > yes <b>", "a"), ("a > b <", "a > b <"), ("a<b", "a<b"), ("<p>x<!--", "x"), ("<p>x</p><!-- > --> y", "x\n\ny"), ("1 < 2", "1 < 2")]:
        assert html_text.page_text(page) == want


BIG = {
    "unclosed": "<a" * 500_000, "unclosed-quotes": "<a '" * 250_000 + ">", "lists": "<ul><li>" * 60_000 + "x", "items": "<ul><li>y" * 60_000,
    "wide": "<table><tr><td>" + "w" * 400_000 + "<td>z" + "<tr><td>a<td>b" * 40_000, "tables": "<table><tr><td>q" * 60_000,
    "spans": "<table>" + "<tr>" + "<td>aaaa" * 300 + ("<tr>" + "<td colspan=300>x<td>y" * 3) * 10_000, "open-comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("name", sorted(BIG))
def test_a_megabyte_takes_seconds_and_stays_in_bounds(name):
    page = BIG[name]
    began = time.perf_counter()
    text = html_text.page_text(page)
    assert time.perf_counter() - began < 20 and len(text) < 10 * len(page)


class Words(HTMLParser):
    """Visible words in order, by another parser: hidden elements are skipped with all they hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        style = (given.get("style") or "").replace(" ", "").lower()
        if tag not in html_text.VOID:
            unseen = tag in ("script", "style", "template", "noscript", "title", "head") or "hidden" in given or "display:none" in style or "visibility:hidden" in style
            self.open.append((tag, unseen))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(unseen for _, unseen in self.open):
            self.found += data.split()


def test_the_words_of_whole_tables_equal_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    different = []
    for r in registry.QUERIES["op7_html_text"](spark, sf).collect():
        other = Words()
        other.feed(pages[r["page_id"]])
        other.close()
        marks = re.compile(r"^ *(?:- |\d+\. )+", re.M)
        if sorted(marks.sub("", r["text"]).split()) != sorted(other.found):
            different.append(r["page_id"])
    assert len(pages) == 250 and different == []
