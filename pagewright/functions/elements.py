"""Rules that classify page elements, as columns over one row per element.

Expected columns: tag, class, role, raw_label (what the element itself says), label (never empty), id, type, href (null if none), expanded, selected, contenteditable, aria_modal,
onclick, overflow, scroll_height, client_height, scroll_width, client_width, x, y, width, height, painted, outer_frame. First match wins
in every chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truthy

#: Weights of kinds; a kind not listed weighs 0.
WEIGHTS = {"modal": 110, "card-large": 105, "card": 100, "panel": 92, "stat": 88, "media": 86, "button": 84, "price": 82, "badge": 80, "navigation": 78, "field": 76, "link": 70, "icon": 62, "text": 52, "layout": 40}
#: Patterns over lower-cased class, role and label.
MODAL = "modal|dialog|drawer|popover|sheet"
BUTTON = "(^|\\s)(btn|button)(\\s|$)"
BADGE = "(^|[-_\\s])(badge|pill|tag|label|status)([-_\\s]|$)"
BADGE_WORDS = "(?<![A-Za-z0-9_])(ready|owned|new|offer|super offer)(?![A-Za-z0-9_])"
CARD = "card|tile|product|feature|offer"
PANEL = "panel|pane|window|dialog|detail|sidebar|drawer|container"
STAT = "stat|metric|data cores|costs|score|counter"
PRICE = "price|cost|coin|core|energy|currency|amount|(?<![A-Za-z0-9_])[0-9]+\\s*/\\s*[0-9]+(?![A-Za-z0-9_])"
PROBE = "tab|menu|filter|dropdown|accordion|toggle|expand|more|open|faq|modal|drawer"
#: Semantic types by pattern over lower-cased id, class, role and label, after the tag rules.
HERO, NEAR_TOP = "hero|headline|above[-_\\s]?fold", "h1|headline|trial|demo|start|signup|sign up"
CTA = "trial|demo|start|buy|subscribe|contact|signup|sign up|get started|learn more"
DECORATION = "blur|gradient|glow|orb|background|decoration|absolute|rounded-full"
NO_COLOUR = "rgba?\\(\\s*0\\s*,\\s*0\\s*,\\s*0\\s*(?:,\\s*0\\s*)?\\)"
#: Roles of tags, and elements that show something by themselves.
TAG_ROLES = [("select", "combobox"), ("img", "img"), ("nav", "navigation"), ("form", "form"), ("header", "banner"), ("footer", "contentinfo"), ("main", "main")]
RENDERABLE = ["img", "svg", "canvas", "picture", "video", "input", "textarea", "select", "button", "a"]
#: Kinds by how their image is taken.
HIDES_INNER = ["card-large", "card", "panel", "badge"]
ISOLATED = ["card-large", "card", "panel", "button", "badge", "stat", "price", "media", "icon"]
HIDES_OUTER = ["button", "badge"]
BROWSER_SHAPE = ["button", "badge", "stat", "price", "media", "icon"]
SEMANTIC = [("pricing", "pricing|price|plan|billing|subscription"), ("testimonial", "testimonial|review|quote|customer story|case study"), ("faq", "faq|question|accordion"), ("feature", "feature|benefit|capability")]


def _lc(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def weighed(terms: list[tuple[Column, int]]) -> Column:
    """The sum of the weights of the conditions that hold."""
    total = F.lit(0)
    for condition, weight in terms:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def aria_role() -> Column:
    """The role an element has; which tags and input types have which is fixed."""
    t, kind = F.col("tag"), _lc("type")
    out = F.when((t == "a") & (F.coalesce(F.col("href"), F.lit("")) != ""), "link").when(t == "button", "button")
    out = out.when((t == "input") & kind.isin("button", "submit", "reset"), "button").when((t == "input") & (kind == "checkbox"), "checkbox").when((t == "input") & (kind == "radio"), "radio")
    out = out.when(t.isin("input", "textarea"), "textbox")
    for tag, role in TAG_ROLES:
        out = out.when(t == tag, role)
    return F.coalesce(truthy("role"), out.when(t.isin("h1", "h2", "h3", "h4", "h5", "h6"), "heading").otherwise(""))


def kind() -> Column:
    cls, labelled = _lc("class"), _lc("class", "role", "label")
    w, h, t, role = F.col("width"), F.col("height"), F.col("tag"), F.coalesce(F.col("role"), F.lit(""))
    area, painted = w * h, F.col("painted")
    large = lambda other: F.when(area > 180000, "card-large").otherwise(other)
    return (
        F.when((F.coalesce(F.col("raw_label"), F.lit("")) == "") & (t == "span") & (cls == ""), "decoration")
        .when((t == "dialog") | (role == "dialog") | (F.coalesce(F.col("aria_modal"), F.lit("")) == "true") | has(cls, MODAL), "modal")
        .when((t == "svg") | has(cls, "icon|ico"), "icon")
        .when((t == "button") | (role == "button") | has(cls, BUTTON), "button")
        .when(t == "a", "link")
        .when(t.isin("input", "textarea", "select"), "field")
        .when((t == "nav") | (role == "navigation"), "navigation")
        .when((t == "form") | (role == "form"), "form")
        .when(t.isin("img", "canvas", "picture", "video"), "media")
        .when((has(_lc("class", "role"), BADGE) | (painted & has(labelled, BADGE_WORDS))) & (w < 360) & (h < 120), "badge")
        .when((t == "article") | has(cls, CARD), large("card"))
        .when(has(cls, PANEL), large("panel"))
        .when(F.col("outer_frame"), "card-large")
        .when(painted & (area > 180000) & (w > 240) & (h > 220), "card-large")
        .when(painted & (area > 24000) & (w > 120) & (h > 80), "card")
        .when(painted & (area > 5000), "panel")
        .when(has(labelled, STAT) & (w < 320) & (h < 180), "stat")
        .when(has(labelled, PRICE) & (w < 520) & (h < 140), "price")
        .when((F.col("label") != "") & (w > 24) & (h > 10), "text")
        .otherwise("layout")
    )


def semantic_type(viewport_height: int = 1000) -> Column:
    """Needs the columns kind and aria_role besides."""
    text, t, role, k = _lc("id", "class", "aria_role", "label"), F.col("tag"), F.col("aria_role"), F.col("kind")
    out = F.when((t == "header") | (role == "banner") | has(text, "(^|[-_\\s])header([-_\\s]|$)"), "header").when((t == "nav") | (role == "navigation"), "navigation").when((t == "footer") | (role == "contentinfo"), "footer")
    out = out.when((k == "modal") | has(text, MODAL), "modal").when((t == "form") | (role == "form"), "form")
    for name, pattern in SEMANTIC:
        out = out.when(has(text, pattern), name)
    near_top = F.col("y") < 0.9 * viewport_height
    out = out.when(has(text, HERO) | (near_top & has(text, NEAR_TOP) & (F.col("width") > 360)), "hero")
    out = out.when((k == "button") & has(text, CTA), "cta")
    return out.when(k.isin("card", "card-large", "panel"), "section").otherwise(k)


def actions() -> Column:
    """Ordered actions; needs aria_role. Which tags, roles and input types allow which is fixed."""
    t, role, kind_ = F.col("tag"), F.col("aria_role"), _lc("type")
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    click = (t == "button") | set_("onclick") | ((t == "a") & (F.coalesce(F.col("href"), F.lit("")) != "")) | role.isin("button", "link", "menuitem", "tab", "option") | F.col("expanded").isNotNull() | (t == "summary")
    fill = (t == "textarea") | (F.coalesce(F.col("contenteditable"), F.lit("")) == "true") | ((t == "input") & ~kind_.isin("button", "checkbox", "file", "hidden", "image", "radio", "reset", "submit")) | (role == "textbox")
    select = (t == "select") | role.isin("combobox", "listbox")
    toggle = role.isin("checkbox", "radio", "switch") | ((t == "input") & kind_.isin("checkbox", "radio"))
    scroll = has(F.col("overflow"), "(auto|scroll)") & ((F.col("scroll_height") > F.col("client_height") + 8) | (F.col("scroll_width") > F.col("client_width") + 8))
    hover = click | fill | select | toggle
    found = F.array(*[F.when(c, F.lit(n)) for n, c in (("click", click), ("fill", fill), ("select", select), ("toggle", toggle), ("hover", hover), ("scroll", scroll))])
    return F.filter(found, lambda a: a.isNotNull())


def priority() -> Column:
    """Needs kind and area."""
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(weights[F.col("kind")], F.lit(0)) + F.least(F.col("area") / F.lit(100000.0), F.lit(12.0))


def visible() -> Column:
    """Needs display, visibility, opacity and aria_hidden. An opacity that is no number hides nothing; an empty one is 0."""
    number = F.when(F.trim("opacity") == "", 0.0).otherwise(F.col("opacity").try_cast("double"))
    shown = F.coalesce(number, F.lit(1.0)) != 0
    return (F.col("width") >= 4) & (F.col("height") >= 4) & (F.col("display") != "none") & (F.col("visibility") != "hidden") & shown & (F.coalesce(F.col("aria_hidden"), F.lit("")) != "true")


def has_paint() -> Column:
    """Needs background, image, shadow, outline_width and outline_style, and borders, an array of (width, style). Opaque black counts as no colour."""
    colour = ~F.col("background").isin("", "transparent") & ~has(F.col("background"), NO_COLOUR)
    drawn = lambda width, style: (width > 0) & ~style.isin("", "none")
    effects = ~F.col("image").isin("", "none") | ~F.col("shadow").isin("", "none")
    return colour | effects | drawn(F.col("outline_width"), F.col("outline_style")) | F.exists("borders", lambda b: (b["width"] > 0) & (b["style"] != "none"))


def renderable() -> Column:
    """Elements of which an ancestor isn't mere decoration; needs attrs."""
    return F.col("tag").isin(*RENDERABLE) | F.map_contains_key("attrs", F.lit("role"))


def paint_only() -> Column:
    """Decoration without label or content; needs raw_label, source, class, position and renderables, the number of renderable descendants."""
    plain = (F.coalesce(F.col("raw_label"), F.lit("")) == "") & F.col("tag").isin("div", "span") & (F.coalesce(F.col("source"), F.lit("")) == "") & (F.col("renderables") == 0)
    return plain & (has(_lc("class"), DECORATION) | F.col("position").isin("absolute", "fixed") | ((F.col("width") <= 72) & (F.col("height") <= 72)))


def outer_frame(width: int = 1440, height: int = 1000) -> Column:
    """Frames of an application; needs area, painted and visuals, the number of visible painted descendants of 5000 square pixels or more, up to 4."""
    view = width * height
    return (F.col("area") >= 0.45 * view) & (F.col("area") < 0.9 * view) & (F.col("width") >= 0.75 * width) & (F.col("height") >= 0.55 * height) & F.col("painted") & (F.col("visuals") >= 4)


def image_rules() -> dict[str, Column]:
    """How an item's image is taken, by its kind."""
    rules = {"hides_inner": HIDES_INNER, "isolated": ISOLATED, "hides_outer": HIDES_OUTER, "browser_shape": BROWSER_SHAPE}
    return {name: F.col("kind").isin(*kinds) for name, kinds in rules.items()}


def background_shell(width: int = 1440, height: int = 1000) -> Column:
    return (F.col("width") >= 0.94 * width) & (F.col("height") >= 0.9 * height)


def keeps_block() -> Column:
    """Which kinds stay as blocks; needs kind and area."""
    return ~(F.col("kind").isin("decoration", "text") | ((F.col("kind") == "layout") & (F.col("area") < 120000)) | (F.col("kind").isin("card", "card-large", "panel") & ~F.col("painted") & ~F.col("outer_frame")))


def probe_score() -> Column:
    """Needs kind, semantic_type and aria_role."""
    text = _lc("label", "kind", "semantic_type", "aria_role", "id", "class")
    terms = [(F.col("expanded").isNotNull(), 20), (F.col("selected").isNotNull(), 12), (F.col("aria_role").isin("tab", "switch", "checkbox"), 18), (has(text, PROBE), 16), (F.col("semantic_type") == "navigation", 6)]
    return weighed(terms)


def can_probe() -> Column:
    """Needs actions and score."""
    return (F.array_contains("actions", "click") | F.array_contains("actions", "toggle")) & (F.col("tag") != "a") & ~_lc("type").isin("submit", "reset", "file") & (F.col("score") > 0)
