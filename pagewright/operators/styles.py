"""Computed styles of elements from the CSS that pages hold: style elements and style attributes.

Rules are taken apart in the JVM; each of their selectors is indexed by its rightmost part (an id, else a class, else a tag, else any). A page's elements are one array, and a look at that index
finds what may match an element; what is left of it is tested on the element and its ancestors. Of what matches, the
cascade takes one declaration a property: important ones first, then style attributes, then specificity, then order. Inherited properties come from the nearest
ancestor that has a value, others have their initial value.

Selectors: tags, ids, classes, attributes (present or equal), any (`*`), descendants and children. Others (siblings, pseudo-classes and -elements, further attribute
tests) match nothing. At-rules are left out whole, so what depends on a medium doesn't count. Of shorthands, those in SHORTHANDS are spread; values stay as they are written, in lower case for keywords that rules compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .tree import attr, gathered

#: Properties that children inherit, and initial values (others are '').
INHERITED = ["visibility", "color", "cursor"]
INITIAL = {
    "display": "inline", "visibility": "visible", "opacity": "1", "position": "static", "overflow": "visible", "overflow-x": "visible", "overflow-y": "visible", "background-color": "rgba(0, 0, 0, 0)", "background-image": "none", "box-shadow": "none",
    "outline-width": "0px", "outline-style": "none", "transform": "none", "filter": "none", "clip-path": "none", "top": "auto", "left": "auto", "color": "rgb(0, 0, 0)", "cursor": "auto", "will-change": "auto", "animation-name": "none", "animation-duration": "0s",
    "animation-delay": "0s", "animation-timing-function": "ease", "animation-iteration-count": "1", "animation-direction": "normal", "animation-fill-mode": "none", "animation-play-state": "running", "transition-property": "all",
    "transition-duration": "0s", "transition-delay": "0s", "transition-timing-function": "ease", "border-radius": "",
    **{f"border-{side}-{p}": v for side in ("top", "right", "bottom", "left") for p, v in (("width", "0px"), ("style", "none"))},
}
#: What elements are displayed as without a rule; others are inline.
DISPLAY = {
    "none": ["area", "base", "datalist", "head", "link", "meta", "noembed", "noframes", "param", "rp", "script", "style", "template", "title"],
    "block": ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "ul"],
    "list-item": ["li"], "table": ["table"], "table-row": ["tr"], "table-cell": ["td", "th"], "table-row-group": ["tbody"], "table-header-group": ["thead"], "table-footer-group": ["tfoot"], "table-caption": ["caption"], "table-column": ["col"], "table-column-group": ["colgroup"],
    "inline-block": ["button", "input", "meter", "progress", "select", "textarea"],
}
#: Shorthands and the properties that they set, all to the same value.
SHORTHANDS = {"overflow": ["overflow-x", "overflow-y"], "border-width": [f"border-{s}-width" for s in ("top", "right", "bottom", "left")], "border-style": [f"border-{s}-style" for s in ("top", "right", "bottom", "left")]}
#: Keywords that stand for another value.
KEYWORDS = ["inherit", "initial", "unset", "revert"]
NAME = "[A-Za-z_\\x{80}-\\x{10ffff}-][A-Za-z0-9_\\x{80}-\\x{10ffff}-]*"
COMPOUND = f"(?:\\*|{NAME})?(?:#{NAME}|\\.{NAME}|\\[\\s*{NAME}\\s*(?:=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\]\"'\\s]+)\\s*)?\\])*"
SELECTOR = f"^{COMPOUND}(?:\\s*>\\s*{COMPOUND}|\\s+{COMPOUND})*$"


def _parts(compound: Column) -> Column:
    """tag ('' for any), ids, classes and tests (name, value or null) of a compound selector."""
    tests = F.transform(
        F.regexp_extract_all(compound, F.lit("\\[([^\\]]*)\\]"), F.lit(1)),
        lambda t: F.struct(F.lower(F.trim(F.regexp_extract(t, "^([^=]*)", 1))).alias("name"), F.when(F.contains(t, F.lit("=")), F.regexp_replace(F.trim(F.regexp_extract(t, "=(.*)$", 1)), "^[\"']|[\"']$", "")).alias("value")),
    )
    bare = F.regexp_replace(compound, "\\[[^\\]]*\\]", "")
    tag = F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^#.]*", 0), "^\\*$", ""))
    found = lambda sign: F.regexp_extract_all(bare, F.lit(f"{sign}({NAME})"), F.lit(1))
    return F.struct(tag.alias("tag"), found("#").alias("ids"), found("\\.").alias("classes"), tests.alias("tests"))


def declarations(css: Column) -> Column:
    """Array of (name, value, important) of the declarations of a block, in order."""
    halves = F.filter(F.regexp_extract_all(css, F.lit("((?:\"[^\"]*\"|'[^']*'|\\([^)]*\\)|[^;\"'(])+)"), F.lit(1)), lambda d: F.contains(d, F.lit(":")))

    def one(d: Column) -> Column:
        value = F.trim(F.regexp_replace(F.regexp_extract(d, "(?s)^[^:]*:(.*)$", 1), "\\s+", " "))
        important = F.rlike(value, F.lit("(?i)!\\s*important$"))
        return F.struct(F.lower(F.trim(F.regexp_extract(d, "(?s)^\\s*([^:]*)", 1))).alias("name"), F.regexp_replace(value, "(?i)\\s*!\\s*important$", "").alias("value"), important.alias("important"))

    def spread(d: Column) -> Column:
        own = F.array(d)
        for short, longs in SHORTHANDS.items():
            own = F.when(d["name"] == short, F.concat(F.array(d), F.array(*[F.struct(F.lit(n).alias("name"), d["value"].alias("value"), d["important"].alias("important")) for n in longs]))).otherwise(own)
        return own

    return F.flatten(F.transform(F.transform(halves, one), spread))


def rules_of(all_: Column, names: list[str]) -> Column:
    """The rules of a page (an array of its elements) that set one of names: key, chain (the compound selectors from the right, with how each stands to the one before) and decls, each with its name and what ranks it."""

    def one(s: Column, sheet: Column, pos: Column, decls: Column) -> Column:
        steps = F.reverse(F.regexp_extract_all(F.regexp_replace(s["selector"], " ?> ?", " >"), F.lit("(?:^| )(>?[^ \\[]*(?:\\[[^\\]]*\\][^ \\[]*)*)"), F.lit(1)))
        chain = F.transform(steps, lambda x: F.struct(x.startswith(">").alias("child"), _parts(F.regexp_replace(x, "^>", "")).alias("of")))

        def whole(chain: Column) -> Column:
            count = lambda f: F.aggregate(chain, F.lit(0), lambda n, c: n + f(c["of"]))
            specificity = count(lambda c: 10_000 * F.size(c["ids"]) + 100 * (F.size(c["classes"]) + F.size(c["tests"])) + F.when(c["tag"] != "", 1).otherwise(0))
            last = chain[0]["of"]
            key = F.coalesce(F.concat(F.lit("#"), F.get(last["ids"], F.lit(0))), F.concat(F.lit("."), F.get(last["classes"], F.lit(0))), F.nullif(last["tag"], F.lit("")), F.lit("*"))
            ranked = U.let(specificity, lambda n: F.transform(decls, lambda d: _ranked(d, F.lit(0), n, sheet, pos, s["k"])))
            return F.struct(key.alias("key"), chain.alias("chain"), ranked.alias("decls"))

        return U.let(chain, whole)

    def block(rule: Column, sheet: Column, pos: Column) -> Column:
        split = F.split(F.regexp_extract(rule, "(?s)^([^{]*)", 1), ",(?![^\\[]*\\])")
        selectors = F.transform(split, lambda x, k: F.struct(F.trim(F.regexp_replace(x, "\\s+", " ")).alias("selector"), k.alias("k")))
        known = lambda decls: F.filter(selectors, lambda s: (F.size(decls) > 0) & (s["selector"] != "") & F.rlike(s["selector"], F.lit(SELECTOR)))
        return U.let(_wanted(F.regexp_extract(rule, "(?s)\\{([^}]*)\\}", 1), names), lambda decls: F.transform(known(decls), lambda s: one(s, sheet, pos, decls)))

    def sheet(e: Column) -> Column:
        css = F.regexp_replace(F.coalesce(e["text"], F.lit("")), "(?s)/\\*.*?\\*/|<!--|-->", " ")
        css = F.regexp_replace(F.regexp_replace(css, "(?s)@[^{};]*\\{(?:[^{}]*\\{[^{}]*\\})*[^{}]*\\}", " "), "@[^;{}]*;", " ")
        return F.flatten(F.transform(F.regexp_extract_all(css, F.lit("(?s)([^{}]*\\{[^{}]*\\})"), F.lit(1)), lambda rule, pos: block(rule, e["idx"], pos)))

    return F.flatten(F.transform(F.filter(all_, lambda e: e["tag"] == "style"), sheet))


def _wanted(css: Column, names: list[str]) -> Column:
    """The declarations of a block that set one of names, with their place n in it."""
    placed = F.transform(declarations(css), lambda d, n: F.struct(d["name"].alias("name"), d["value"].alias("value"), d["important"].alias("important"), n.alias("n")))
    return F.filter(placed, lambda d: d["name"].isin(*names) & (d["value"] != ""))


def _ranked(d: Column, own: Column, specificity: Column, sheet: Column, pos: Column, k: Column) -> Column:
    """A declaration's name and rank, what decides first at the front and the value at the end; displays and keywords that stand for another value in lower case."""
    value = F.when((d["name"] == "display") | F.lower(d["value"]).isin(*KEYWORDS), F.lower(d["value"])).otherwise(d["value"])
    rank = {"important": d["important"], "own": own, "specificity": specificity, "sheet": sheet, "pos": pos, "k": k, "n": d["n"], "value": value}
    return F.struct(d["name"].alias("name"), F.struct(*[c.alias(n) for n, c in rank.items()]).alias("rank"))


def _matches(of: Column, e: Column) -> Column:
    """Whether an element (tag, classes, attrs) fits a compound selector."""
    value = lambda t: F.try_element_at(e["attrs"], t["name"])
    tests = F.forall(of["tests"], lambda t: value(t).isNotNull() & (t["value"].isNull() | (value(t) == t["value"])))
    return ((of["tag"] == "") | (of["tag"] == e["tag"])) & F.forall(of["ids"], lambda i: F.coalesce(i == F.try_element_at(e["attrs"], F.lit("id")), F.lit(False))) & F.forall(of["classes"], lambda c: F.array_contains(e["classes"], c)) & tests


def _fits(chain: Column, line: Column) -> Column:
    """Whether a chain fits the last element of a line of elements from the root down.

    The places at which what was read so far can begin are carried along, so a child after a descendant needs no second try.
    """
    at = lambda p: F.element_at(line, p)
    places = F.when(_matches(chain[0]["of"], at(F.size(line))), F.array(F.size(line))).otherwise(F.array().cast("array<int>"))
    rest = F.slice(chain, F.lit(2), F.size(chain))
    above = lambda n: F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    # how a compound stands to the one on its right is marked on the right one
    def step(state: Column, c: Column) -> Column:
        reach = F.when(state["child"], F.filter(F.transform(state["places"], lambda p: p - 1), lambda p: p > 0)).otherwise(above(F.coalesce(F.array_max(state["places"]), F.lit(0))))
        return F.struct(F.filter(reach, lambda p: _matches(c["of"], at(p))).alias("places"), c["child"].alias("child"))

    return F.size(F.aggregate(rest, F.struct(places.alias("places"), chain[0]["child"].alias("child")), step)["places"]) > 0


def classes() -> Column:
    """The classes of an element (attrs), as selectors see them."""
    return F.filter(F.split(F.coalesce(attr("class"), F.lit("")), "[ \\t\\n\\f\\r]+"), lambda w: w != "")


def styles_of(all_: Column, names: list[str] | None = None) -> Column:
    """The style (a map of names, all of INITIAL unless given) of each of a page's elements: an array of idx, above, tag, attrs, text and classes, in order and whole."""
    names = list(INITIAL) if names is None else names
    nowhere = F.lit(0)

    def given(e: Column, found: Column) -> Column:
        """What rules (by key) and its own attribute give an element: a map of the best declarations' values."""
        id_ = F.try_element_at(e["attrs"], F.lit("id"))
        plain = F.array(F.lit("*"), e["tag"])
        keys = F.array_distinct(F.concat(plain, F.transform(e["classes"], lambda c: F.concat(F.lit("."), c)), F.filter(F.array(F.concat(F.lit("#"), id_)), lambda k: k.isNotNull())))
        keys = F.when((F.size(e["classes"]) == 0) & id_.isNull(), plain).otherwise(keys)
        met = F.flatten(F.filter(F.transform(keys, lambda k: F.try_element_at(found, k)), lambda r: r.isNotNull()))
        line = F.transform(F.array_append(e["above"], e["idx"]), lambda i: F.get(all_, i))
        of_rules = U.let(line, lambda line: F.flatten(F.transform(F.filter(met, lambda r: _fits(r["chain"], line)), lambda r: r["decls"])))
        css = F.try_element_at(e["attrs"], F.lit("style"))
        own = F.transform(_wanted(F.coalesce(css, F.lit("")), names), lambda d: _ranked(d, F.lit(1), F.lit(0), nowhere, nowhere, nowhere))
        every = F.when(css.isNull(), of_rules).otherwise(F.concat(of_rules, own))

        def best(decls: Column) -> Column:
            first = lambda n: F.array_max(F.transform(F.filter(decls, lambda d: d["name"] == n), lambda d: d["rank"]))["value"]
            return U.let(F.array_distinct(F.transform(decls, lambda d: d["name"])), lambda have: F.map_from_arrays(have, F.transform(have, first)))

        return U.let(every, best)

    def style(e: Column, values: Column) -> Column:
        line = F.transform(F.array_append(e["above"], e["idx"]), lambda i: F.get(values, i))
        return U.let(line, lambda line: F.create_map(*[x for n in names for x in (F.lit(n), _value(n, e["tag"], line))]))

    by_key = lambda rules: U.let(F.array_distinct(F.transform(rules, lambda r: r["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(rules, lambda r: r["key"] == k))))
    values = U.let(U.let(rules_of(all_, names), by_key), lambda found: F.transform(all_, lambda e: given(e, found)))
    return U.let(values, lambda values: F.transform(all_, lambda e: style(e, values)))


def computed_styles(elements: DataFrame, names: list[str] | None = None) -> DataFrame:
    """page_id, idx and style (a map of names, all of INITIAL unless given) of every element (page_id, idx, above, tag, attrs, text).

    A page's elements are gathered once, and rules meet them in that array: elements are read once, and moved once.
    """
    page = gathered(elements, ["idx", "above", "tag", "attrs", F.when(F.col("tag") == "style", F.col("text")).alias("text"), classes().alias("classes")])
    return page.select("page_id", F.inline(F.zip_with("all", styles_of(F.col("all"), names), lambda e, s: F.struct(e["idx"].alias("idx"), s.alias("style")))))


def _value(name: str, tag: Column, line: Column) -> Column:
    """A property of the last element, of this tag, of a line of maps of given values from the root down."""
    own = F.try_element_at(F.element_at(line, -1), F.lit(name))
    start = F.lit(INITIAL.get(name, ""))
    none = lambda v: v.isNull() | v.isin("unset", "revert")

    def step(above: Column, values: Column) -> Column:
        """The value at an element, from that of its parent."""
        v = F.try_element_at(values, F.lit(name))
        return F.when(none(v), above if name in INHERITED else start).when(v == "inherit", above).when(v == "initial", start).otherwise(v)

    value = F.aggregate(line, start, step)
    if name not in INHERITED:
        value = F.when(none(own) | (own == "initial"), start).when(own == "inherit", value).otherwise(own)
    if name == "display":
        displayed = F.coalesce(*[F.when(tag.isin(*tags), F.lit(v)) for v, tags in DISPLAY.items()], F.lit("inline"))
        return F.when(own.isNull() | (own == "revert"), displayed).otherwise(value)
    return value
