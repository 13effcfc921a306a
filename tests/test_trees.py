"""Trees of pages as browsers build them, by hand, and what is read from them."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import crawl, tree
from pagewright.sources import dom
from pagewright.sources import pages as P
from pagewright.sources.treebuilder import DEEP, Node, build


def shown(n):
    return n.tag + "(" + " ".join(shown(k) if isinstance(k, Node) else k for k in n.kids) + ")"


BODIES = {
    "<table><tr><td>1<td>2<tr>": "table(tbody(tr(td(1) td(2)) tr()))",
    "<dl><dt>d<dd>e</dl>": "dl(dt(d) dd(e))",
    "<p>a<h4>b": "p(a) h4(b)",
    "<p>a<p>b": "p(a) p(b)",
    "<p>a<pre>\nb</pre>": "p(a) pre(b)",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x": "ul(li(a) li(b ul(li(c))) li(d)) x",
    "<table>x<tr><td>y</table>z": "x table(tbody(tr(td(y)))) z",
    "<table><div>a</div><td>b": "div(a) table(tbody(tr(td(b))))",
    "<table><tr><form><input type=hidden><td>b": "table(tbody(tr(form() input() td(b))))",
    "<table><colgroup><col><col><tbody><tr><td>k": "table(colgroup(col() col()) tbody(tr(td(k))))",
    "<div><table><caption>c<tr><th>h</table></div>t": "div(table(caption(c) tbody(tr(th(h))))) t",
    "<table><tr><td><table><tr><td>in</table>out</table>": "table(tbody(tr(td(table(tbody(tr(td(in)))) out))))",
    "<p>1<table><tr><td>2</table>3": "p(1) table(tbody(tr(td(2)))) 3",
    "<td>stray</td>s": "strays",
    "<b>1<p>2</b>3</p>": "b(1) p(b(2) 3)",
    "<b><i>1</b>2</i>": "b(i(1)) i(2)",
    "<p><b>x<p>y": "p(b(x)) p(b(y))",
    "<a href=x>1<a>2": "a(1) a(2)",
    "<a>1<div>2<a>3": "a(1) div(a(2) a(3))",
    "<select><option>a<option>b<optgroup><option>c</select>d": "select(option(a) option(b) optgroup(option(c))) d",
    "<button>a<button>b": "button(a) button(b)",
    "<h1>a<h2>b</h1>c": "h1(a) h2(b) c",
    "</p>x</br>y": "p() x br() y",
    "<form><form>x</form>y</form>z": "form(x) yz",
    "<ruby>x<rp>(<rt>y<rp>)</ruby>": "ruby(x rp(() rt(y) rp()))",
    "<textarea>\n<b>&lt;</textarea>": "textarea(<b><)",
    "<svg><path/><g/></svg>q": "svg(path() g()) q",
    "a</body>b": "ab",
}


@pytest.mark.parametrize("html", BODIES)
def test_bodies(html):
    assert shown(build(html)) == f"html(head() body({BODIES[html]}))"


def test_what_every_page_has():
    assert shown(build("")) == "html(head() body())" and shown(build("text")) == "html(head() body(text))"
    assert shown(build("<meta a><div>1</div><title>2</title>")) == "html(head(meta()) body(div(1) title(2)))"
    assert shown(build("<!doctype html><html lang=en><head><title>a &amp; b<i></title><script>1<b</script></head><body class=q>hi")) == "html(head(title(a & b<i>) script(1<b)) body(hi))"
    page = build("<html lang=en><html lang=de dir=x><body class=q><body class=r id=s>")
    assert page.attrs == {"lang": "en", "dir": "x"} and page.kids[1].attrs == {"class": "q", "id": "s"}


def test_broken_and_deep_pages():
    for html in ("<", "<a", "<!--", "<![CDATA[x", "<table>" * 900, "<b>" * 600 + "<p>x" * 30, "<a><div>" * 400, "<select>" * 50, "</" * 100, "<li>" * 3000):
        build(html)
    deep = build("<div>" * 20_000 + "<nav>x</nav>")
    todo, most = [(deep, 1)], 0
    while todo:
        n, depth = todo.pop()
        most = max(most, depth)
        todo += [(k, depth + 1) for k in n.kids if isinstance(k, Node)]
    assert most <= DEEP + 1


def test_rows(spark):
    html = "<body><p id=a>one <b>two</b>\n three<p>" + "x" * 600 + "<span> \n </span><table><td>c<td>d"
    df = spark.createDataFrame([(7, html), (8, None), (9, "")], "page_id long, html string")
    rows = {(r.page_id, r.idx): r for r in dom.dom_elements(df).collect()}
    assert [rows[9, i].tag for i in range(3)] == ["html", "head", "body"] and not any(k[0] == 8 for k in rows)
    assert (rows[7, 3].text, rows[7, 3].content, rows[7, 3].attrs, rows[7, 3].last) == ("one three", "one two three", {"id": "a"}, 4)
    assert rows[7, 5].content == "x" * dom.CONTENT and rows[7, 6].content == " " and rows[7, 2].content == ("one two three" + "x" * 600)[: dom.CONTENT]
    paths = {r.idx: r.xpath for r in tree.paths(dom.dom_elements(df.where("page_id = 7"))).collect()}
    assert paths[5] == "/html/body/p[2]" and paths[11] == "/html/body/table/tbody/tr/td[2]"


def test_a_page_that_breaks_the_parser(spark):
    def parse(html):
        if html == "poison":
            raise ValueError("no page")
        return build(html)

    df = spark.createDataFrame([(i, "poison" if i == 4 else f"<p>{i}") for i in range(10)], "page_id long, html string").repartition(2)
    got = dom.dom_rows(df, parse).collect()
    assert [(r.page_id, r.idx, r.error) for r in got if r.error] == [(4, None, "ValueError: no page")]
    assert sorted(r.content for r in got if r.tag == "p") == [str(i) for i in range(10) if i != 4]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_patterns_find_what_the_tree_holds(spark, sf):
    """Tags and links that patterns find against the elements of parsed pages; implied elements, and formatting that paragraphs open again, aside."""
    pages = P.table(spark, sf, "pages")
    a = P.tags(pages).groupBy("page_id", "tag").count().where("tag NOT IN ('html', 'head', 'body', 'b')")
    b = dom.dom_elements(pages).groupBy("page_id", "tag").count().where("tag NOT IN ('html', 'head', 'body', 'b')")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    want = dom.dom_elements(pages).where("tag = 'a' AND attrs['href'] <> ''").select("page_id", F.col("attrs")["href"].alias("href"))
    got = P.links(pages).where("source = 'link'").select("page_id", "href")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


B = "http://a.example/d/e?q#f"
RESOLVED = [
    ("/x/../p1", "http://a.example/p1"), ("HTTP://A.EXAMPLE/p2", "http://a.example/p2"), (" /p3 ", "http://a.example/p3"), ("http://a.example:80/p4", "http://a.example/p4"), ("p5", "http://a.example/d/p5"), ("", "http://a.example/d/e?q"),
    ("#z", "http://a.example/d/e?q#z"), ("?", "http://a.example/d/e?"), ("//Other:0443/x", "http://other:443/x"), ("https://u:p@H:443", "https://u:p@h/"), ("..", "http://a.example/"), ("../../../g", "http://a.example/g"),
    ("./", "http://a.example/d/"), ("g/.", "http://a.example/d/g/"), ("%2e%2E/g", "http://a.example/g"), ("é ü", "http://a.example/d/%C3%A9%20%C3%BC"), ("?a b'c", "http://a.example/d/e?a%20b%27c"), ("\\\\h\\x\\y", "http://h/x/y"),
    ("mailto:A@b", "mailto:A@b"), ("javascript:void(0)", "javascript:void(0)"), ("http://h:99999/", None), ("http://", None), ("http:///x", "http://x/"), ("http:g", "http://a.example/d/g"), ("https:g", "https://g/"),
    ("file:///a/../b", "file:///b"), ("file:/x", "file:///x"), ("http://a b/", None), ("http://[::1]:8080/", "http://[::1]:8080/"), ("ht\ntp://x/", "http://x/"), ("a//b/../c", "http://a.example/d/a//c"), ("http://x?y", "http://x/?y"),
    ("data:,a#b", "data:,a#b"), ("/😀", "http://a.example/%F0%9F%98%80"),
]


def test_references(spark):
    df = spark.createDataFrame(RESOLVED, "a string, want string").withColumn("got", U.resolved("a", F.lit(B)))
    assert [(r.a, r.got) for r in df.collect()] == RESOLVED
    alone = spark.createDataFrame([("no url",), ("/x",), (None,), ("ftp://H/x",)], "a string").select(U.resolved("a").alias("u"))
    assert [r.u for r in alone.collect()] == [None, None, None, "ftp://h/x"]
    values = [("a&amp;b", "a&b"), ("p&#53;", "p5"), ("&#x1F600;x", "😀x"), ("&copy=1", "&copy=1"), ("&copy 1", "© 1"), ("&nosuch;", "&nosuch;"), ("&", "&"), ("&&lt;", "&<"), ("&#150;", "–"), ("&#0;", "�"), (None, None)]
    assert [(r.a, r.b) for r in spark.createDataFrame(values, "a string, c string").select("a", U.decoded("a").alias("b")).collect()] == values


def test_crawl_by_any_spelling(spark):
    html = "<a href='/x/../p1'></a><a href='/p1'></a><a href='HTTP://A.EXAMPLE/p2'></a><a href=' /p3 '></a><a href='http://a.example:80/p4'></a><a href='p&#53;'></a><a href='https://a.example/no'></a><a href='mailto:x@a.example'></a>"
    pages = spark.createDataFrame([("http://a.example/", html), ("http://A.example:80/p2#x", "<base href='/deep/er/'><a href=last></a>")], "url string, html string")
    got = [r.url for r in crawl.discover(pages, "HTTP://a.example", 50).orderBy("ord").collect()]
    assert got == ["http://a.example/", *(f"http://a.example/p{i}" for i in range(1, 6)), "http://a.example/deep/er/last"]


def test_summaries(spark):
    html = '<html lang=de><head><meta http-equiv=c content="text/html; charset=utf-8"><title> A  b </title><link rel="x STYLESHEET"><style></style></head><h1> One </h1><h2> </h2><h4>no</h4><a href=/x>l</a><a name=y>n</a><nav aria-label=Top>x</nav><footer></footer><div role="search"></div><p role="">p</p><input><button>b</button>'
    r = tree.summaries(dom.dom_elements(spark.createDataFrame([(1, html), (2, "")], "page_id long, html string"))).orderBy("page_id").collect()
    assert (r[0].title, r[0].lang, r[0].charset) == ("A b", "de", "UTF-8") and (r[1].title, r[1].lang, r[1].charset) == ("", "", "")
    assert r[0].counts.asDict() == {"elements": 18, "links": 1, "images": 0, "forms": 0, "inputs": 2, "scripts": 0, "stylesheets": 2} and r[1].counts.elements == 3
    assert [tuple(h) for h in r[0].headings] == [("h1", "One")]
    assert [tuple(m) for m in r[0].landmarks] == [("nav", "", "Top"), ("div", "search", ""), ("p", "", "p")]


REPLAYS = [
    ("<html><HEAD class=a><title><script></title>x</HEAD><p a='>'>1", "<html><HEAD class=a>B<title><script></title>x</HEAD><p a='>'>1"),
    ("<!doctype html>\n<html lang=x>\n<p>1", "<!doctype html>\n<html lang=x><head>B</head>\n<p>1"),
    ("<!doctype html><p>1", "<!doctype html><head>B</head><p>1"),
    ("1 < 2", "<head>B</head>1 < 2"),
    ("<head><!-- <script> --><script>if (a<b) '<head>'</script>", "<head>B<!-- <script> --><script D>if (a<b) '<head>'</script>"),
    ("<head><Script  SRC = '/a?src=1'\ntype=\"module\" title=' src=x' async>1</Script>", "<head>B<Script  S = '/a?src=1'\nT=\"module\" title=' src=x' async D>1</Script>"),
    ("<head><script src='' type=''></script><script src=/x/></script>", "<head>B<script src='' D></script><script S=/x/ D></script>"),
    ('<head><base data-replay-base="true" href="old"><base href=/own>', "<head>B<base href=/own>"),
]


def test_replays(spark):
    from pyspark.sql import functions as F

    from pagewright.functions import replay as R

    base = f'<base {R.BASE}="true" href="http://h/?a&amp;&quot;">'
    want = [(a, b.replace("B", base, 1).replace(" D>", f' type="{R.DISABLED}">').replace(" S =", f" {R.SRC} =").replace(" S=", f" {R.SRC}=").replace("\nT=", f"\n{R.TYPE}=")) for a, b in REPLAYS]
    df = spark.createDataFrame(want, "a string, b string").withColumn("got", R.replayed("a", F.lit('http://h/?a&"')))
    assert [(r.a, r.got) for r in df.collect()] == want
