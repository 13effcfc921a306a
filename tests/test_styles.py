"""Computed styles, by hand."""

from pagewright.operators import styles
from pagewright.sources import dom

PAGE = """<html><head><style>
/* all { color: no } */ p { color: red; display: block } .a { color: blue } #x { color: green } p.b { color: teal !important; }
@media print { p { color: black } .a { color: black } } @import url(x);
div > p { position: absolute } div p em { opacity: 0.5 } section > div em { opacity: .25 } [data-k] { cursor: help } [data-k="v w"] { cursor: wait } a:hover { color: pink } p + p { color: pink }
.box { overflow: hidden; visibility: hidden } .Box { top: 1px } * { will-change: transform }
</style><style>p { left: 2px; background-image: url("a;b.png") } p { left: 3px }</style></head>
<body style="color: inherit"><section><div class="box q"><p id=x class=a>1<em style="visibility: visible; color: INHERIT">e</em></p><p class="a b" style="color: orange; display: none">2</p><i class=a style="color: orange!important; top: initial">3</i><span data-k="v w">4</span><b data-k>5</b></div></section><p>6</p></body></html>"""


def test_cascade(spark):
    e = dom.dom_elements(spark.createDataFrame([(1, PAGE), (2, "<p class=a>x"), (3, None)], "page_id long, html string"))
    rows = e.join(styles.computed_styles(e), ["page_id", "idx"]).collect()
    assert len(rows) == e.count()
    s = {r.text: r.style for r in rows if r.page_id == 1 and r.text}
    got = lambda t, *names: tuple(s[t][n] for n in names)
    assert got("1", "color", "display", "position", "left", "visibility", "background-image") == ("green", "block", "absolute", "3px", "hidden", 'url("a;b.png")')
    assert got("2", "color", "display") == ("teal", "none")
    assert got("e", "color", "visibility", "opacity", "display", "overflow") == ("green", "visible", ".25", "inline", "visible")
    assert got("3", "color", "top", "visibility", "position") == ("orange", "auto", "hidden", "static")
    assert got("4", "cursor") == ("wait",) and got("5", "cursor") == ("help",)
    assert got("6", "color", "position", "left", "visibility", "will-change") == ("red", "static", "3px", "visible", "transform")
    box = next(r.style for r in rows if r.tag == "div")
    assert (box["overflow-x"], box["overflow"], box["top"], box["display"]) == ("hidden", "hidden", "auto", "block")
    tags = {r.tag: r.style for r in rows if r.page_id == 2}
    assert tags["head"]["display"] == "none" and tags["p"]["color"] == "rgb(0, 0, 0)" and set(tags["p"]) == set(styles.INITIAL)
    assert styles.computed_styles(e.limit(0)).count() == 0


def test_children_below_descendants(spark):
    """A chain that a single walk upward would miss."""
    html = "<style>.a > .b .c { color: red } .x .y > .z { color: blue }</style><div class=a><div class=b><div class=b><u class=c>1</u></div></div></div><div class=x><div class=y><div class=y><u class=z>2</u><div><u class=z>3</u></div></div></div></div>"
    e = dom.dom_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.text: r.style["color"] for r in e.join(styles.computed_styles(e, ["color"]), ["page_id", "idx"]).where("tag = 'u'").collect()}
    assert got == {"1": "red", "2": "blue", "3": "rgb(0, 0, 0)"}


def test_elements_are_moved_once(spark):
    e = dom.dom_elements(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    plan = styles.computed_styles(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan


def test_keywords_and_displays_in_any_case(spark):
    html = "<style>u { DISPLAY: BLOCK; color: Red; opacity: .5 } i { display: Inherit; color: UNSET; opacity: Inherit } b { display: revert; color: INITIAL }</style><u id=u>1<i id=i>2</i><b id=b>3</b></u>"
    e = dom.dom_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.attrs["id"]: [r.style[n] for n in ("display", "color", "opacity")] for r in e.join(styles.computed_styles(e, ["display", "color", "opacity"]), ["page_id", "idx"]).where("attrs['id'] IS NOT NULL").collect()}
    assert got == {"u": ["block", "Red", ".5"], "i": ["block", "Red", ".5"], "b": ["inline", "rgb(0, 0, 0)", "1"]}
