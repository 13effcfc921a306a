"""Operators against plain sequential versions, on random inputs."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.functions import elements as E
from pagewright.functions import text as X
from pagewright.functions import urls as U
from pagewright.operators import crawl, items, timeline, tree
from pagewright.sources import dom
from pagewright.sources import pages as P


def near(a, b):
    return abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 and abs(a.width - b.width) <= 3 and abs(a.height - b.height) <= 3


def test_greedy_removal(spark):
    r = random.Random(1)
    rows = [Row(page_id=r.randrange(3), kind=r.choice("ab"), idx=i, priority=float(r.randrange(4)), area=r.randrange(3), x=r.randrange(8), y=r.randrange(30), width=r.randrange(5), height=r.randrange(5)) for i in range(300)]
    want = []
    for page in range(3):
        for k in "ab":
            kept = []
            for e in sorted((e for e in rows if e.page_id == page and e.kind == k), key=lambda e: (-e.priority, -e.area, e.idx)):
                if not any(near(e, o) for o in kept):
                    kept.append(e)
            want += [e.idx for e in kept]
    got = [x.idx for x in items.without_near_copies(spark.createDataFrame(rows).repartition(5)).collect()]
    assert sorted(got) == sorted(want)


def fifo(edges, seeds, most):
    seen, queue = [], list(dict.fromkeys(seeds))[:most]
    while queue and len(seen) < most:
        n = queue.pop(0)
        seen.append(n)
        for d in edges.get(n, []):
            if d not in seen and d not in queue and len(seen) + len(queue) < most:
                queue.append(d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_is_a_queue(spark, seed):
    r = random.Random(seed)
    edges = {n: [r.randrange(25) for _ in range(r.randrange(4))] for n in range(25)}
    df = spark.createDataFrame([(s, i, d) for s, ds in edges.items() for i, d in enumerate(ds)], "src long, ord int, dst long")
    seeds = spark.createDataFrame([(0, 0), (7, 1)], "node long, ord int")
    for most in (1, 9, 40):
        got = [x.node for x in crawl.bfs(df, seeds, most).orderBy("ord").collect()]
        assert got == fifo(edges, [0, 7], most)


def test_bfs_of_a_long_row(spark):
    edges = [(i, 0, i + 1) for i in range(60)]
    got = crawl.bfs(spark.createDataFrame(edges, "src int, ord int, dst int"), spark.createDataFrame([(0, 0)], "node int, ord int"), 100)
    assert [x.node for x in got.orderBy("ord").collect()] == list(range(61))


def test_novel_states(spark):
    r = random.Random(3)
    rows = [(u, i, r.choice("abcdefg"), r.random() < 0.8) for u in range(4) for i in range(25)]
    want = []
    for u in range(4):
        seen, n = set(), 0
        for _, i, s, ok in (x for x in rows if x[0] == u):
            if n == 3:
                break
            if ok and s != "a" and s not in seen:
                seen.add(s)
                want.append((u, i))
                n += 1
    df = spark.createDataFrame(rows, "u int, i int, s string, ok boolean")
    got = timeline.novel_states(df, "u", "i", "s", F.lit("a"), F.col("ok"), 3)
    assert sorted((x.u, x.i) for x in got.collect()) == want


def test_last_after_row_counts(spark):
    before = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, k string, v string")
    after = spark.createDataFrame([("a", 1, "y"), ("a", 2, "z")], "k string, rank int, v string")
    assert {(x.id, x.after.v if x.after else None) for x in timeline.with_after(before, after, ["k"], "rank", ["v"]).collect()} == {(1, "z"), (2, None)}


def one(spark, **columns):
    return spark.createDataFrame([Row(**columns)])


BASE = dict(tag="div", **{"class": ""}, role="", raw_label="l", label="l", id="", type="", href="", expanded="", selected="", overflow="visible", scroll_height=0, client_height=0, x=0, y=0, width=10, height=5, painted=False, outer_frame=False, aria_modal="", onclick="", contenteditable="", scroll_width=0, client_width=0)


@pytest.mark.parametrize(
    "change,kind",
    [
        ({"tag": "span", "raw_label": "", "label": "span 2"}, "decoration"), ({"tag": "dialog"}, "modal"), ({"class": "side-sheet"}, "modal"), ({"tag": "svg"}, "icon"), ({"class": "btn-icon"}, "icon"), ({"class": "big btn"}, "button"), ({"role": "button"}, "button"),
        ({"tag": "a"}, "link"), ({"tag": "select"}, "field"), ({"role": "navigation"}, "navigation"), ({"tag": "form"}, "form"), ({"tag": "video"}, "media"), ({"class": "my-pill"}, "badge"), ({"painted": True, "label": "Owned"}, "badge"), ({"painted": True, "label": "énew", "width": 30}, "badge"), ({"painted": True, "label": "anew", "width": 30, "height": 11}, "text"),
        ({"tag": "article"}, "card"), ({"class": "tile", "width": 601, "height": 300}, "card-large"), ({"class": "window"}, "panel"), ({"outer_frame": True}, "card-large"), ({"painted": True, "width": 601, "height": 300}, "card-large"),
        ({"painted": True, "width": 200, "height": 121}, "card"), ({"painted": True, "width": 1001, "height": 5}, "panel"), ({"label": "score"}, "stat"), ({"label": "3 / 4"}, "price"), ({"width": 25, "height": 11}, "text"), ({"width": 24, "height": 11}, "layout"),
    ],
)
def test_kinds(spark, change, kind):
    assert one(spark, **{**BASE, **change}).select(E.kind().alias("k")).first().k == kind


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \n b﻿", "http://h.example/a/b//?q#f", "all", "2,1,x,2"), (None, "http://h.example/", "1", "1")], "t string, u string, s string, m string")
    r = df.select(X.normalize_text("t").alias("t"), U.page_url("u").alias("p"), X.slug("u").alias("s"), X.item_indexes("s", F.lit(3)).alias("a"), X.item_indexes("m", F.lit(3)).alias("b")).collect()
    assert (r[0].t, r[0].p, r[0].s, r[0].a, r[0].b) == ("a b", "http://h.example/a/b", "b", [0, 1, 2], [1, 0])
    assert (r[1].t, r[1].p, r[1].s, r[1].a) == ("", "http://h.example/", "h-example", [0])
    with pytest.raises(Exception, match="out of range"):
        df.select(X.item_indexes(F.lit("1,,3"), F.lit(3))).collect()
    assert df.select(X.round_half_up(F.lit(-2.5)).alias("x")).first().x == -2
    assert [timeline.state_limit(x) for x in (None, 0, -3, 7, 99)] == [5, 5, 0, 7, 20]


def test_links_and_manifests(spark, tmp_path):
    html = '<a href="/x">1</a><a href="">2</a><form action="y.html"></form><a class="c" href="http://z/">3</a>'
    df = spark.createDataFrame([(1, "http://h/a/b.html?q", html)], "page_id long, url string, html string")
    got = P.links(df).withColumn("t", U.resolved("href", "base")).orderBy("ord").collect()
    assert [(x.href, x.source, x.t) for x in got] == [("/x", "link", "http://h/x"), ("http://z/", "link", "http://z/"), ("y.html", "form", "http://h/a/y.html")]
    P.write_json(df.withColumn("kind", F.lit("k")), str(tmp_path / "m"), "kind")
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    (tmp_path / "one.json").write_text('{\n "items": [{"id": "a"}]\n}')
    assert P.read_manifest(spark, str(tmp_path / "one.json")).first()["items"][0].id == "a"


def test_tree(spark):
    df = spark.createDataFrame([(1, "<ul><li>a<li>b <b>c</b></ul><br><p>d<p>e")], "page_id long, html string")
    e = dom.dom_elements(df)
    rows = [(x.tag, x.parent, x.last, x.text) for x in e.orderBy("idx").collect()]
    assert rows == [("html", None, 9, ""), ("head", 0, 1, ""), ("body", 0, 9, ""), ("ul", 2, 6, ""), ("li", 3, 4, "a"), ("li", 3, 6, "b"), ("b", 5, 6, "c"), ("br", 2, 7, ""), ("p", 2, 8, "d"), ("p", 2, 9, "e")]
    assert {x.idx: x.n for x in dom.descendant_counts(e, F.col("tag").isin("li", "b"), 2).collect()} == {0: 2, 1: 0, 2: 2, 3: 2, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0}


def test_trees_of_parsed_pages(spark):
    html = '<html><body><label>Your <b>name</b> <input id=a></label><INPUT ID=b><label for=b>Mail</label><div aria-labelledby="x a y">t</div><i id=x> X </i><!-- <p>no</p> --><p>1<p>2</body></html>'
    e = dom.dom_elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    rows = {r.idx: r for r in e.collect()}
    assert [rows[i].tag for i in range(len(rows))] == ["html", "head", "body", "label", "b", "input", "input", "label", "div", "i", "p", "p"]
    assert rows[3].content == "Your name" and rows[5].above == [0, 2, 3] and rows[2].last == 11 and rows[4].parent == 3 and rows[0].parent is None
    names = {r.idx: r.accessible_name for r in tree.named(e).collect()}
    assert names[5] == "Your name" and names[6] == "Mail" and names[8] == "X" and names[9] == "X"
    paths = {r.idx: (r.xpath, r.css_path) for r in tree.paths(e).collect()}
    assert paths[0] == ("/html/", "") and paths[5] == ("/html/body/label[1]/input", "input#a") and paths[11] == ("/html/body/p[2]", "body > p:nth-of-type(2)")
    n = {r.idx: r.n for r in dom.descendant_counts(e, F.col("tag").isin("input", "p"), 3).collect()}
    assert (n[0], n[2], n[3], n[4], n[11]) == (3, 3, 1, 0, 0)
    assert tree.paths(e.limit(0)).count() == 0 and tree.named(e.limit(0)).count() == 0


def test_crawl_of_a_long_row(spark):
    pages = spark.createDataFrame([(f"http://a/{i}", f"<a href='/{i + 1}'>n</a><a href='http://b/{i}'>o</a>") for i in range(40)], "url string, html string")
    got = [r.url for r in crawl.discover(pages, "http://a/0?x#y", 200).orderBy("ord").collect()]
    assert got == [f"http://a/{i}" for i in range(41)]  # the last one wasn't fetched
    assert crawl.discover(pages.limit(0), "http://a/0", 5).count() == 1


def test_links_in_any_quotes(spark):
    html = "<A class=x HREF='/a'>a</A><area href=/b><a data-href=\"/no\">n</a><script>\"<a href='/s'>\"</script><!-- <a href='/c'> --><a title='>' href=\"/d\">d</a><form ACTION='/f'>"
    rows = P.links(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")).orderBy("ord").collect()
    assert [(r.href, r.source) for r in rows] == [("/a", "link"), ("/b", "link"), ("/d", "link"), ("/f", "form")]


def test_config_round_trip(spark, tmp_path):
    at = str(tmp_path / "config")
    assert P.read_config(spark, at).count() == 0
    P.write_config(spark.createDataFrame([("patchPath", "/p"), ("x", None), (None, "y")], "key string, value string"), at)
    assert [tuple(r) for r in P.read_config(spark, at).collect()] == [("patchPath", "/p")]


def test_patch_items(spark):
    items_ = spark.createDataFrame([(1, "card", "block-001", "a.png"), (2, "", "", ""), (3, "link", "block-003", "/x.png")], "reading int, kind string, id string, image string")
    chosen = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "pos int, at int")
    got = [(r["index"], r.source, r.path) for r in items.patch_items(items_, chosen, F.lit("/out/manifest.json")).orderBy("pos").collect()]
    assert got == [(3, "/x.png", "items/link/003-block-003.png"), (1, "/out/a.png", "items/card/001-block-001.png"), (2, "", "items/unknown/002-item-2.png")]


def test_arrays_of_a_page_are_made_once(spark):
    """No test of the size of a page's results makes them before they are made: its labels would be made for each element there."""
    e = dom.dom_elements(spark.createDataFrame([(1, "<p>x")], "page_id long, html string"))
    for made in (tree.named(e), tree.paths(e)):
        assert "size(transform(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_labels_name_the_first_field_inside(spark):
    html = "<label>a</label><input id=p><label>b<i>c<input id=q></i><input id=r></label><label for=r>d</label><label>e<input type=hidden id=s><i></i></label><input id=t><label for=none>f<input id=u></label>"
    e = dom.dom_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    names = {r.attrs["id"]: r.accessible_name for r in tree.named(e).where("attrs['id'] IS NOT NULL").collect()}
    assert names == {"p": "", "q": "bc", "r": "d", "s": "", "t": "", "u": ""}


def test_links_are_taken_once(spark):
    """Neither is the array of a page's links tested for its size first, nor does a level of a crawl take links again."""
    pages = spark.createDataFrame([(f"http://a/{i}", f"<a href='/{i + 1}'>n</a>") for i in range(3)], "url string, html string")
    found = P.links(pages.selectExpr("0 AS page_id", "*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(filter(" not in found
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = [r.url for r in crawl.discover(pages.mapInArrow(through, pages.schema), "http://a/0", 9).orderBy("ord").collect()]
    assert got == [f"http://a/{i}" for i in range(4)] and seen.value == 3
