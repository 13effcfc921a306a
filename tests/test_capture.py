"""What a capture keeps, by hand: for every stage an element that only it leaves out."""

import pytest

from pagewright.operators import capture, styles
from pagewright.sources import dom

HTML = """<html><head><style>.paint { background-color: rgb(1, 2, 3) } .gone { display: none } #r { border-radius: 9999px 50% }</style></head><body>
<div id=shell class=paint>all</div><button id=b1 TYPE=Submit>Buy</button><button id=b2>Buy</button><button id=b3 style="visibility: hidden">Buy</button><button id=b4 aria-hidden=true>Buy</button>
<span id=dot></span><span id=bare> </span><p id=t>text</p><div id=hid class="card paint gone">x</div><div id=card class="card paint">c</div><div id=flat class=card>c</div><label>Your <b>name</b><input id=in type=TEXT></label>
<a id=l href=/x>link</a><div id=frame class=paint>f<i class=paint id=i1>1</i><i class=paint id=i2>2</i><i class=paint id=i3>3</i><i class=paint id=i4>4</i></div><div id=r class=paint>round</div><div id=lay>big</div><div id=small>small</div></body></html>"""
#: x, y, width, height by id; elements without a box are left out.
BOXES = {
    "shell": (0, 0, 1400, 950), "b1": (10, 10, 100, 40), "b2": (11, 12, 98, 42), "b3": (300, 10, 100, 40), "b4": (500, 10, 100, 40), "dot": (700, 10, 20, 20), "bare": (0, 60, 300, 90), "t": (10, 80, 200, 20), "hid": (0, 100, 300, 200),
    "card": (10, 120, 300, 200), "flat": (400, 120, 300, 200), "in": (10, 350, 200, 30), "l": (5, 350, 50, 20), "frame": (0, 400, 1200, 600), "i1": (0, 410, 100, 50), "i2": (100, 410, 100, 50), "i3": (200, 410, 100, 50), "i4": (300, 410, 100, 50),
    "r": (20.4, 1100.5, 100, 90), "lay": (0, 1300, 400, 300), "small": (0, 1700, 40, 40),
}


def kept(spark, most=240, html=HTML):
    e = dom.dom_elements(spark.createDataFrame([(1, html), (2, "<p>no box"), (3, None)], "page_id long, html string"))
    at = {r.attrs["id"]: r.idx for r in e.where("attrs['id'] IS NOT NULL AND page_id = 1").collect()}
    rows = [(1, at[k], *map(float, v), 0, 0, 0, 0) for k, v in BOXES.items() if k in at]
    layout = spark.createDataFrame(rows, "page_id long, idx int, x double, y double, width double, height double, scroll_height int, client_height int, scroll_width int, client_width int")
    got = capture.captured(e, layout, styles.computed_styles(e), most=most).orderBy("reading").collect()
    ids = {f"block-{i + 1:03d}": k for k, i in at.items()}
    return [(ids[r.item.id], r.item) for r in got]


def test_stages(spark):
    got = kept(spark)
    assert [k for k, _ in got] == ["b2", "card", "l", "in", "frame", "r"]
    by = dict(got)
    assert [(i.bounds.y, i.bounds.x) for _, i in got] == sorted((i.bounds.y, i.bounds.x) for _, i in got)
    assert {k: i.kind for k, i in got} == {"b2": "button", "card": "card", "l": "link", "in": "field", "frame": "card-large", "r": "panel"}
    assert by["in"].aria.name == "Your name" and by["in"].actions == ["fill", "hover"] and by["l"].selectors.xpath == "/html/body/a"
    assert (by["r"].cornerRadii.topLeft.x, by["r"].cornerRadii.topLeft.y, by["r"].bounds.y, by["r"].bounds.x) == (9999, 45, 1101, 20)
    assert by["frame"].ownPaint and by["card"].dom.classList == ["card", "paint"]


@pytest.mark.parametrize("most,want", [(1, ["frame"]), (3, ["card", "frame", "r"])])
def test_the_best_in_reading_order(spark, most, want):
    assert [k for k, _ in kept(spark, most)] == want


def test_frames_and_paint_decide(spark):
    """Without its painted descendants the frame is one large card by paint alone; without paint it goes."""
    plain = HTML.replace("<div id=frame class=paint>", "<div id=frame>")
    assert [k for k, _ in kept(spark, html=plain)] == ["b2", "card", "l", "in", "r"]


def test_what_is_inside_needs_no_box(spark):
    """An element stays if the last one inside it has no box."""
    got = kept(spark, html=HTML.replace('class="card paint">c</div>', 'class="card paint">c<script id=boxless></script></div>'))
    assert [k for k, _ in got] == ["b2", "card", "l", "in", "frame", "r"]


def test_pages_are_moved_once(spark):
    e = capture.described(dom.dom_elements(spark.createDataFrame([(1, HTML)], "page_id long, html string")))
    e = e.selectExpr("*", *[f"cast(idx AS double) AS {n}" for n in ("x", "y", "width", "height")], *[f"0 AS {n}" for n in ("scroll_height", "client_height", "scroll_width", "client_width")])
    plan = capture.kept(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan
