"""What a capture keeps of a page, from its elements, their boxes and their styles: filters, kinds, removal of near copies, the best, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import text as X
from ..sources.dom import with_descendants
from . import items, styles, tree

VIEW = (1440, 1000)
SIDES = ("top", "right", "bottom", "left")
CORNERS = {"topLeft": "top-left", "topRight": "top-right", "bottomRight": "bottom-right", "bottomLeft": "bottom-left"}
KEYS = ["page_id", "idx"]
#: The properties that the rules look at.
LOOKED = [
    "display", "visibility", "opacity", "position", "overflow", "overflow-x", "overflow-y", "background-color", "background-image", "box-shadow", "outline-width", "outline-style",
    *[f"border-{x}-{p}" for x in SIDES for p in ("width", "style")], *[f"border-{p}-radius" for p in CORNERS.values()], "border-radius",
]


def pixels(c: Column) -> Column:
    """The leading number of a CSS length; 0 without one."""
    return F.coalesce(X.truthy(F.regexp_extract(c, "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))", 1)).try_cast("double"), F.lit(0.0))


def described(elements: DataFrame) -> DataFrame:
    """elements as dom_elements gives them, with names, label, paths and style (of LOOKED); a page's elements are gathered once for all of these, and moved once."""
    spread = tree.stepped(elements.repartition("page_id")).withColumn("classes", styles.classes())
    rest = ["idx", "parent", "above", "last", "tag", "attrs", "content"]
    page = tree.gathered(spread, [*rest, F.when(F.col("tag") == "style", F.col("text")).alias("text"), "classes", "step_x", "step_css", "css_own"])
    all_ = F.col("all")
    e = page.select("page_id", F.inline(F.arrays_zip(all_.alias("e"), tree.names_of(all_).alias("n"), tree.paths_of(all_).alias("p"), styles.styles_of(all_, LOOKED).alias("style"))))
    return e.select("page_id", *[f"e.{c}" for c in rest], "n.*", "p.*", "style").withColumn("label", tree.label())


def boxed(elements: DataFrame) -> DataFrame:
    """elements (attrs, style, x, y, width, height) with the columns that the rules look at, and without style."""
    s = lambda n: F.coalesce(F.try_element_at("style", F.lit(n)), F.lit(""))
    a = tree.attr
    text = lambda n: F.coalesce(a(n), F.lit(""))
    # a function over an array keeps this projection out of a stage's one method, which would be too long to be compiled
    borders = F.transform(F.array(*map(F.lit, SIDES)), lambda x: F.struct(*[f(F.coalesce(F.try_element_at("style", F.concat(F.lit("border-"), x, F.lit(f"-{p}"))), F.lit(""))).alias(p) for p, f in (("width", pixels), ("style", lambda c: c))]))
    columns = {
        "class": text("class"), "role": text("role"), "type": text("type"), "href": a("href"), "expanded": a("aria-expanded"), "selected": a("aria-selected"), "contenteditable": a("contenteditable"), "aria_modal": a("aria-modal"),
        "onclick": a("onclick"), "aria_hidden": a("aria-hidden"), "source": text("src"), "display": F.lower(s("display")), "visibility": F.lower(s("visibility")), "opacity": s("opacity"), "position": F.lower(s("position")),
        "overflow": F.concat_ws(" ", s("overflow"), s("overflow-x"), s("overflow-y")), "background": F.lower(s("background-color")), "image": s("background-image"), "shadow": s("box-shadow"), "outline_width": pixels(s("outline-width")),
        "outline_style": s("outline-style"), "borders": borders,
        "corners": F.struct(*[F.coalesce(X.truthy(s(f"border-{p}-radius")), s("border-radius")).alias(n) for n, p in CORNERS.items()]),
    }
    e = elements.withColumns(columns).withColumn("id_attr", text("id")).drop("style")
    return e.withColumns({"painted": E.has_paint(), "seen": E.visible(), "area": F.col("width") * F.col("height")})


def captured(elements: DataFrame, layout: DataFrame, styles: DataFrame, view: tuple[int, int] = VIEW, most: int = items.MOST) -> DataFrame:
    """page_id, reading and item of what is kept of each page: elements as dom_elements gives them.

    layout: page_id, idx, x, y, width, height (of the page, in pixels), scroll_height, client_height, scroll_width, client_width.
    styles: page_id, idx and style (a map, as computed_styles gives it).
    """
    e = tree.named(elements).join(tree.paths(elements), KEYS).join(styles, KEYS).join(layout, KEYS, "left")
    return kept(e, view, most)


def kept(elements: DataFrame, view: tuple[int, int] = VIEW, most: int = items.MOST) -> DataFrame:
    """The same from elements as described gives them, with the columns of layout; those without a box have nulls there and are left out.

    An element has to be visible, not to cover the view and not to be mere decoration; its kind has to stay as a block. Of near copies of a kind
    the best is kept, of all of a page the `most` best, given in reading order. All that is done here is done within pages, by windows and groups: rows that come by page stay where they are.
    """
    e = boxed(elements)
    large = F.col("seen") & F.col("painted") & (F.col("area") >= 5000)
    e = with_descendants(e, {"visuals": large, "renderables": F.col("width").isNotNull() & E.renderable()})
    e = e.where(F.col("width").isNotNull() & F.col("seen") & ~E.background_shell(*view)).where(~E.paint_only())
    e = e.withColumn("outer_frame", E.outer_frame(*view)).withColumn("kind", E.kind())
    e = e.withColumns({n: X.round_half_up(F.col(n)) for n in ("x", "y", "width", "height")}).withColumn("area", F.col("width") * F.col("height"))
    e = e.where(E.keeps_block()).withColumn("aria_role", E.aria_role()).withColumn("id", F.col("id_attr")).withColumn("semantic_type", E.semantic_type(view[1]))
    e = e.withColumn("priority", E.priority()).withColumn("actions", E.actions()).withColumn("id", F.format_string("block-%03d", F.col("idx") + 1))
    e = items.top_items(items.without_near_copies(e), most)
    e = e.withColumn("radii", X.corner_radii({n: F.col(f"corners.{n}") for n in CORNERS}, F.col("width"), F.col("height")))
    e = e.withColumn("selectors", tree.selector_candidates(F.col("id"), F.col("aria_role"), F.col("label"), F.col("xpath")))
    return items.reading_order(e).select("page_id", "reading", items.item_struct().alias("item"))
