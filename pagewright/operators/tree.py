"""Operators over element trees: paths, selectors, attributes, names and labels.

Elements have page_id, idx (document order), parent, above (ancestors from the root on), tag, attrs (a map) and
content (all text inside). An attribute that an element lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import urls as U

#: Attributes that an item keeps, and those that an animation snapshot keeps.
KEPT = ["aria-controls", "aria-expanded", "aria-haspopup", "aria-label", "aria-modal", "aria-selected", "alt", "data-cy", "data-test", "data-testid", "href", "id", "name", "placeholder", "title", "type", "value"]
MOTION = ["class", "style", "aria-expanded", "aria-hidden", "aria-selected", "data-state", "data-status", "data-open", "data-active", "data-motion", "data-animate", "data-framer-motion"]
#: Attributes that hold a test id, and that name an element, in order; elements that a label can name.
TEST_IDS = ["data-testid", "data-test", "data-cy"]
NAMES = ["aria-label", "alt", "title", "placeholder", "value"]
LABELABLE = ["button", "input", "meter", "output", "progress", "select", "textarea"]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def attribute_map() -> Column:
    """The attributes that an item keeps: known names, values of at most 160 characters."""
    return F.map_filter("attrs", lambda k, v: k.isin(*KEPT) & (F.length(v) <= 160))


def relevant_attributes() -> Column:
    """The attributes that an animation snapshot keeps, cut at 240 characters."""
    return F.transform_values(F.map_filter("attrs", lambda k, v: k.isin(*MOTION)), lambda k, v: F.substring(v, 1, 240))


def class_list(most: int) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.coalesce(attr("class"), F.lit("")), X.BLANK, " "), " "), lambda w: w != "")
    return F.slice(words, 1, most)


def _classes(most: int) -> Column:
    """Classes as a selector, led by a point each."""
    return F.array_join(F.transform(class_list(most), lambda w: F.concat(F.lit("."), X.escape_css(w))), "")


def _test_id() -> Column:
    value = F.coalesce(*[X.truthy(attr(n)) for n in TEST_IDS])
    return F.array_join(F.transform(F.array(*map(F.lit, TEST_IDS)), lambda n: F.concat(F.lit("["), n, F.lit('="'), value, F.lit('"]'))), ", ")


def _has_test_id() -> Column:
    return F.coalesce(*[X.truthy(attr(n)) for n in TEST_IDS]).isNotNull()


def selector() -> Column:
    """By test id, else by id, else by up to three classes, else the tag alone."""
    by_id = F.concat(F.col("tag"), F.lit("#"), X.escape_css(attr("id")))
    return F.when(_has_test_id(), _test_id()).when(X.truthy(attr("id")).isNotNull(), by_id).otherwise(F.concat(F.col("tag"), _classes(3)))


def selector_candidates(capture_id: Column, role: Column, label: Column, xpath: Column) -> Column:
    """Every way to find an element again: captureId, css, id, testId, role, text and xpath; '' where there is none."""
    short = F.substring(X.normalize_text(label), 1, 120)
    quoted = F.replace(short, F.lit('"'), F.lit('\\"'))
    none = F.lit("")
    return F.struct(
        F.concat(F.lit('[data-capture-id="'), capture_id, F.lit('"]')).alias("captureId"),
        selector().alias("css"),
        F.when(X.truthy(attr("id")).isNotNull(), F.concat(F.lit("#"), X.escape_css(attr("id")))).otherwise(none).alias("id"),
        F.when(_has_test_id(), _test_id()).otherwise(none).alias("testId"),
        F.when((F.coalesce(role, none) != "") & (short != ""), F.concat(F.lit('getByRole("'), role, F.lit('", { name: "'), quoted, F.lit('" })'))).otherwise(none).alias("role"),
        F.when((short != "") & (F.length(short) <= 80), F.concat(F.lit('text="'), quoted, F.lit('"'))).otherwise(none).alias("text"),
        xpath.alias("xpath"),
    )


def ranked_siblings(elements: DataFrame) -> DataFrame:
    """elements with nth: the place among siblings of the same tag, null for an only one."""
    by = W.partitionBy("page_id", "parent", "tag")
    return elements.withColumn("nth", F.when(F.count("*").over(by) > 1, F.row_number().over(by.orderBy("idx"))))


def stepped(elements: DataFrame) -> DataFrame:
    """elements with step_x and step_css, an element's step of a path by position and by class, and css_own, its whole css path if it has an id."""
    nth = F.col("nth").cast("string")
    by_position = F.concat("tag", F.coalesce(F.concat(F.lit("["), nth, F.lit("]")), F.lit("")))
    by_class = F.concat(F.col("tag"), _classes(2), F.coalesce(F.concat(F.lit(":nth-of-type("), nth, F.lit(")")), F.lit("")))
    own = F.when(X.truthy(attr("id")).isNotNull(), F.concat(F.col("tag"), F.lit("#"), X.escape_css(attr("id"))))
    return ranked_siblings(elements).withColumns({"step_x": by_position, "step_css": by_class, "css_own": own}).drop("nth")


def paths_of(all_: Column) -> Column:
    """xpath and css_path of each of a page's elements, an array as stepped gives them, in order and whole."""

    def both(e: Column) -> Column:
        inner = F.slice(F.array_append(e["above"], e["idx"]), F.lit(2), F.size(e["above"]))
        near = F.when(F.size(inner) > 6, F.slice(inner, F.size(inner) - 5, F.lit(6))).otherwise(inner)
        step = lambda at, name: F.transform(at, lambda i: F.element_at(all_, i + 1)[name])
        css = F.coalesce(e["css_own"], F.array_join(step(near, "step_css"), " > "))
        return F.struct(F.concat(F.lit("/html/"), F.array_join(step(inner, "step_x"), "/")).alias("xpath"), css.alias("css_path"))

    return F.transform(all_, both)


def gathered(elements: DataFrame, columns: list[str | Column]) -> DataFrame:
    """page_id and all: the columns of a page's elements as an array, in order."""
    return elements.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: a["idx"] - b["idx"]).alias("all"))


def paths(elements: DataFrame) -> DataFrame:
    """page_id, idx, xpath and css_path of every element.

    The steps of a page are gathered once and read by position, so no element meets another in a join. The root
    itself has no step. A css path begins at the element's id if it has one; else it has the nearest six steps.
    """
    page = gathered(stepped(elements), ["idx", "above", "step_x", "step_css", "css_own"])
    row = F.zip_with("all", paths_of(F.col("all")), lambda e, p: F.struct(e["idx"].alias("idx"), p["xpath"].alias("xpath"), p["css_path"].alias("css_path")))
    return page.select("page_id", F.inline(row))  # named first, Spark would test the array's size too, and so make it twice


def _of(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _field(e: Column) -> Column:
    """Whether a label can name an element."""
    return e["tag"].isin(*LABELABLE) & ~((e["tag"] == "input") & (F.lower(F.coalesce(_of(e, "type"), F.lit(""))) == "hidden"))


def names_of(all_: Column) -> Column:
    """accessible_name and raw_label of each of a page's elements, an array of idx, tag, above, attrs and content, in order.

    What refers to another element is looked up in what is taken from the array once.
    """
    known = F.transform(F.filter(all_, lambda e: _of(e, "id").isNotNull()), lambda e: F.struct(_of(e, "id").alias("id"), e["idx"].alias("idx"), _field(e).alias("field"), F.coalesce(e["content"], F.lit("")).alias("content")))
    fields = F.transform(F.filter(all_, _field), lambda e: F.struct(e["idx"].alias("idx"), e["above"].alias("above")))
    spoken = lambda c: X.truthy(X.normalize_text(c))

    def target(label: Column, first, fields: Column) -> Column:
        at = first(_of(label, "for"))
        after = F.get(F.filter(fields, lambda f: f["idx"] > label["idx"]), F.lit(0))  # what is inside comes first of what comes after
        inside = U.let(after, lambda f: F.when(F.array_contains(f["above"], label["idx"]), f["idx"]))
        return F.when(_of(label, "for").isNull(), inside).when(at["field"], at["idx"])

    def told(e: Column, first, labels: Column, labelled: Column) -> Column:
        refs = F.split(F.regexp_replace(X.truthy(_of(e, "aria-labelledby")), X.BLANK, " "), " ")
        by = F.array_join(F.transform(refs, lambda r: F.coalesce(first(r)["content"], F.lit(""))), " ")
        own = F.filter(labels, lambda k: k["of"] == e["idx"])
        label = F.when(F.array_contains(labelled, e["idx"]), F.array_join(F.transform(own, lambda k: k["content"]), " "))
        name = F.coalesce(spoken(by), spoken(label), *[X.truthy(_of(e, n)) for n in NAMES], X.truthy(e["content"]), F.lit(""))
        raw = F.coalesce(X.truthy(_of(e, "aria-label")), X.truthy(_of(e, "title")), X.truthy(e["content"]), _of(e, "alt"))
        return F.struct(F.substring(X.normalize_text(name), 1, 160).alias("accessible_name"), X.normalize_text(raw).alias("raw_label"))

    def page(known: Column, ids: Column) -> Column:
        first = lambda ref: F.get(known, F.array_position(ids, ref).cast("int") - 1)
        content = lambda e: F.coalesce(e["content"], F.lit("")).alias("content")
        labels = U.let(fields, lambda fields: F.transform(F.filter(all_, lambda e: e["tag"] == "label"), lambda e: F.struct(target(e, first, fields).alias("of"), content(e))))
        whole = lambda labels: U.let(F.transform(labels, lambda k: k["of"]), lambda labelled: F.transform(all_, lambda e: told(e, first, labels, labelled)))
        return U.let(F.filter(labels, lambda k: k["of"].isNotNull()), whole)

    return U.let(known, lambda known: U.let(F.transform(known, lambda k: k["id"]), lambda ids: page(known, ids)))


def label() -> Column:
    """An element's label, of raw_label and accessible_name."""
    return F.substring(F.coalesce(X.truthy("raw_label"), X.truthy("accessible_name"), F.concat("tag", F.lit(" "), (F.col("idx") + 1).cast("string"))), 1, 96)


def named(elements: DataFrame) -> DataFrame:
    """elements with raw_label, accessible_name and label.

    The name is the first of: what aria-labelledby names, labels, attributes, content; blanks in it as one, cut at 160
    characters. The label is the first of aria-label, title, content and alt, else the name, else tag and number. aria-labelledby and labels
    mean the first element with an id; a label without `for` names the first field inside it; several names are joined, in document order for labels.

    A page's elements are gathered once, and what refers to another is looked up in that array: elements are read once, and moved once.
    The array of results has no name before it becomes rows: Spark tests the size of a named one first, and for that takes all that it is made of
    into one expression, in which a page's labels are made anew for each of its elements.
    """
    rest = [c for c in elements.columns if c != "page_id"]
    told = F.zip_with("all", names_of(F.col("all")), lambda e, n: F.struct(*[e[c].alias(c) for c in rest], n["accessible_name"].alias("accessible_name"), n["raw_label"].alias("raw_label")))
    return gathered(elements, rest).select("page_id", F.inline(told)).withColumn("label", label())


#: Elements that a summary counts and lists.
IMAGES, INPUTS, HEADINGS = ["img", "picture", "svg", "canvas", "video"], ["input", "textarea", "select", "button"], ["h1", "h2", "h3"]
LANDMARKS = ["header", "nav", "main", "aside", "footer", "form"]


def summaries(elements: DataFrame) -> DataFrame:
    """page_id, title, lang, charset, counts, headings (level, text) and landmarks (tag, role, label) of each page, from one array of its elements.

    Of the first 30 headings those with text count, of the first 80 landmarks (by tag, or with any role) those with role or label; '' for what a page doesn't say.
    """
    row = F.struct("idx", "tag", "attrs", "content")
    page = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["idx"] - b["idx"]).alias("all"))
    n = lambda test: F.size(F.filter("all", test)).cast("long")
    of = lambda tags: lambda e: e["tag"].isin(*tags)
    said = lambda e, name: F.coalesce(_of(e, name), F.lit(""))
    first = lambda test: F.get(F.filter("all", test), F.lit(0))
    sheet = lambda e: (e["tag"] == "style") | ((e["tag"] == "link") & F.array_contains(F.split(F.lower(said(e, "rel")), "\\s+"), "stylesheet"))
    counts = {
        "elements": F.size("all").cast("long"), "links": n(lambda e: (e["tag"] == "a") & _of(e, "href").isNotNull()), "images": n(of(IMAGES)), "forms": n(of(["form"])), "inputs": n(of(INPUTS)),
        "scripts": n(of(["script"])), "stylesheets": n(sheet),
    }
    meta = first(lambda e: (e["tag"] == "meta") & (_of(e, "charset").isNotNull() | F.rlike(said(e, "content"), F.lit("(?i)charset\\s*="))))
    charset = F.coalesce(X.truthy(F.trim(_of(meta, "charset"))), F.regexp_extract(said(meta, "content"), "(?i)charset\\s*=\\s*[\"']?([^\\s;\"']+)", 1), F.lit(""))
    headings = F.transform(F.slice(F.filter("all", of(HEADINGS)), 1, 30), lambda e: F.struct(e["tag"].alias("level"), F.substring(X.normalize_text(e["content"]), 1, 180).alias("text")))
    marks = F.slice(F.filter("all", lambda e: e["tag"].isin(*LANDMARKS) | _of(e, "role").isNotNull()), 1, 80)
    label = lambda e: F.substring(X.normalize_text(F.coalesce(X.truthy(_of(e, "aria-label")), e["content"])), 1, 120)
    landmarks = F.transform(marks, lambda e: F.struct(e["tag"].alias("tag"), said(e, "role").alias("role"), label(e).alias("label")))
    return page.select(
        "page_id", X.normalize_text(first(of(["title"]))["content"]).alias("title"), said(F.get("all", F.lit(0)), "lang").alias("lang"), F.upper(charset).alias("charset"), F.struct(*[c.alias(k) for k, c in counts.items()]).alias("counts"),
        F.filter(headings, lambda h: h["text"] != "").alias("headings"), F.filter(landmarks, lambda m: (m["role"] != "") | (m["label"] != "")).alias("landmarks"),
    )
