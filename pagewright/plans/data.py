"""Inputs of the queries: elements with geometry made from the tags of pages by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import pages as P

CLASSES = ["card", "btn", "badge", "panel", "hero", "icon", ""]
ROLES = ["", "tab", "link", "option", "checkbox", "listbox", "switch"]
TYPES = ["", "Submit", "CHECKBOX", "radio", "Text", "hidden", "FILE"]
LABELS = ["start trial", "price 3 / 4", "new", "data cores", "menu", ""]


def _pick(values: list[str], n: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(({n}) % {len(values)} + 1 AS int)"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per element, some of them twice with shifted bounds; every attribute that the rules look at."""
    t = P.tags(P.table(spark, sf_dir, "pages"))
    base = t.select(
        "page_id", "i", F.expr("CASE WHEN i % 20 = 8 THEN 'input' WHEN i % 20 = 13 THEN 'span' ELSE tag END").alias("tag"),
        F.expr("40 + (i * 37 + page_id * 13) % 1200").alias("width"), F.expr("10 + (i * 53 + page_id * 7) % 400").alias("height"),
        F.expr("(i * 29) % 300").cast("long").alias("x0"), F.expr("i * 24").cast("long").alias("y"),
        _pick(CLASSES, "i * 7 + page_id").alias("class"), F.expr("(i + page_id) % 3 <> 0").alias("painted"),
        _pick(ROLES, "i * 3 + page_id").alias("role"), _pick(LABELS, "i * 5 + page_id").alias("raw_label"),
        F.expr("CASE (i * 5 + page_id) % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END").alias("expanded"),
        F.expr("CASE WHEN (i + page_id) % 5 = 0 THEN 'true' END").alias("selected"),
        F.expr("CASE WHEN tag = 'a' THEN '/x' END").alias("href"), _pick(TYPES, "i + page_id").alias("type"), F.lit("").alias("id"),
        F.expr("CASE WHEN (i + page_id) % 11 = 0 THEN 'auto' ELSE 'visible' END").alias("overflow"), F.expr("i * 10").alias("scroll_height"), F.lit(100).alias("client_height"),
        F.expr("i * 5").alias("scroll_width"), F.lit(120).alias("client_width"), F.expr("(i + page_id) % 31 = 0").alias("outer_frame"),
        F.expr("CASE WHEN (i + page_id) % 17 = 0 THEN 'go()' END").alias("onclick"), F.expr("CASE (i * 3 + page_id) % 19 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END").alias("contenteditable"),
        F.expr("CASE WHEN (i + page_id) % 23 = 0 THEN 'true' END").alias("aria_modal"),
    )
    base = base.withColumn("label", F.coalesce(F.nullif("raw_label", F.lit("")), F.concat("tag", F.lit(" "), (F.col("i") + 1).cast("string"))))
    copies = base.withColumn("copy", F.explode(F.expr("filter(array(0, 1, 2), c -> c = 0 OR (c = 1 AND i % 5 = 0) OR (c = 2 AND i % 10 = 0))")))
    return copies.select("*", F.expr("cast(i * 10 + copy AS long)").alias("idx"), F.expr("x0 + 2 * copy").alias("x"), F.expr("cast(width * height AS long)").alias("area")).drop("i", "copy", "x0")


#: The same rows in DuckDB.
ELEMENTS_SQL = f"""
tags AS (SELECT page_id, lower(unnest(t)) AS tag, generate_subscripts(t, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all({P.plain_sql("html")}, '{P.TAG}', 1) AS t FROM pages)),
base AS (SELECT *, coalesce(nullif(raw_label, ''), tag || ' ' || (i + 1)) AS label FROM (SELECT page_id, i, CASE WHEN i % 20 = 8 THEN 'input' WHEN i % 20 = 13 THEN 'span' ELSE tag END AS tag,
  (['', 'submit', 'checkbox', 'radio', 'text', 'hidden', 'file'])[(i + page_id) % 7 + 1] AS type, 40 + (i * 37 + page_id * 13) % 1200 AS width, 10 + (i * 53 + page_id * 7) % 400 AS height, (i * 29) % 300 AS x0, i * 24 AS y,
  (['card', 'btn', 'badge', 'panel', 'hero', 'icon', ''])[(i * 7 + page_id) % 7 + 1] AS class, (i + page_id) % 3 <> 0 AS painted,
  (['', 'tab', 'link', 'option', 'checkbox', 'listbox', 'switch'])[(i * 3 + page_id) % 7 + 1] AS role,
  (['start trial', 'price 3 / 4', 'new', 'data cores', 'menu', ''])[(i * 5 + page_id) % 6 + 1] AS raw_label,
  CASE (i * 5 + page_id) % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS expanded, CASE WHEN (i + page_id) % 5 = 0 THEN 'true' END AS selected,
  CASE WHEN tag = 'a' THEN '/x' END AS href, CASE WHEN (i + page_id) % 11 = 0 THEN 'auto' ELSE 'visible' END AS overflow, i * 10 AS scroll_height, i * 5 AS scroll_width,
  (i + page_id) % 31 = 0 AS outer_frame, (i + page_id) % 17 = 0 AS clicks, (i * 3 + page_id) % 19 = 0 AS edits, (i + page_id) % 23 = 0 AS modal FROM tags)),
el AS (SELECT *, i * 10 + copy AS idx, x0 + 2 * copy AS x, width * height AS area FROM base, (VALUES (0), (1), (2)) c(copy) WHERE copy = 0 OR (copy = 1 AND i % 5 = 0) OR (copy = 2 AND i % 10 = 0)),
ro AS (SELECT *, CASE WHEN role <> '' THEN role WHEN tag = 'a' THEN 'link' WHEN tag = 'button' OR (tag = 'input' AND type = 'submit') THEN 'button' WHEN tag = 'input' AND type IN ('checkbox', 'radio') THEN type WHEN tag IN ('input', 'textarea') THEN 'textbox' WHEN tag = 'select' THEN 'combobox' WHEN tag = 'img' THEN 'img' WHEN tag = 'nav' THEN 'navigation' WHEN tag = 'form' THEN 'form'
  WHEN tag = 'header' THEN 'banner' WHEN tag = 'footer' THEN 'contentinfo' WHEN tag = 'main' THEN 'main' WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'heading' ELSE '' END AS aria_role FROM el),
ki AS (SELECT *, CASE WHEN raw_label = '' AND tag = 'span' AND class = '' THEN 'decoration' WHEN modal THEN 'modal' WHEN class = 'icon' THEN 'icon' WHEN tag = 'svg' THEN 'icon' WHEN tag = 'button' OR class = 'btn' THEN 'button' WHEN tag = 'a' THEN 'link' WHEN tag IN ('input', 'textarea', 'select') THEN 'field'
  WHEN tag = 'nav' THEN 'navigation' WHEN tag = 'form' THEN 'form' WHEN tag IN ('img', 'canvas', 'picture', 'video') THEN 'media' WHEN (class = 'badge' OR (painted AND label = 'new')) AND width < 360 AND height < 120 THEN 'badge'
  WHEN tag = 'article' OR class = 'card' THEN CASE WHEN area > 180000 THEN 'card-large' ELSE 'card' END WHEN class = 'panel' THEN CASE WHEN area > 180000 THEN 'card-large' ELSE 'panel' END
  WHEN outer_frame THEN 'card-large' WHEN painted AND area > 180000 AND width > 240 AND height > 220 THEN 'card-large' WHEN painted AND area > 24000 AND width > 120 AND height > 80 THEN 'card' WHEN painted AND area > 5000 THEN 'panel'
  WHEN label = 'data cores' AND width < 320 AND height < 180 THEN 'stat' WHEN label IN ('price 3 / 4', 'data cores') AND width < 520 AND height < 140 THEN 'price' WHEN label <> '' AND width > 24 AND height > 10 THEN 'text' ELSE 'layout' END AS kind FROM ro),
se AS (SELECT *, CASE WHEN tag = 'header' THEN 'header' WHEN tag = 'nav' OR aria_role = 'navigation' THEN 'navigation' WHEN tag = 'footer' OR aria_role = 'contentinfo' THEN 'footer' WHEN kind = 'modal' THEN 'modal' WHEN tag = 'form' THEN 'form' WHEN label = 'price 3 / 4' THEN 'pricing'
  WHEN class = 'hero' OR (y < 900 AND (label = 'start trial' OR label LIKE 'h1 %') AND width > 360) THEN 'hero' WHEN kind = 'button' AND label = 'start trial' THEN 'cta' WHEN kind IN ('card', 'card-large', 'panel') THEN 'section' ELSE kind END AS semantic_type FROM ki),
pr AS (SELECT *, CASE kind WHEN 'modal' THEN 110 WHEN 'card-large' THEN 105 WHEN 'card' THEN 100 WHEN 'panel' THEN 92 WHEN 'stat' THEN 88 WHEN 'media' THEN 86 WHEN 'button' THEN 84 WHEN 'price' THEN 82 WHEN 'badge' THEN 80 WHEN 'navigation' THEN 78 WHEN 'field' THEN 76 WHEN 'link' THEN 70 WHEN 'icon' THEN 62 WHEN 'text' THEN 52 WHEN 'layout' THEN 40 ELSE 0 END + least(area / 100000.0::DOUBLE, 12.0::DOUBLE) AS priority,
  list_filter([CASE WHEN tag = 'button' OR tag = 'a' OR aria_role IN ('button', 'link', 'tab', 'option') OR expanded IS NOT NULL OR tag = 'summary' OR clicks THEN 'click' END, CASE WHEN tag = 'textarea' OR (tag = 'input' AND type IN ('', 'text')) OR aria_role = 'textbox' OR edits THEN 'fill' END, CASE WHEN tag = 'select' OR aria_role IN ('combobox', 'listbox') THEN 'select' END, CASE WHEN aria_role IN ('checkbox', 'radio', 'switch') OR (tag = 'input' AND type IN ('checkbox', 'radio')) THEN 'toggle' END,
    CASE WHEN tag IN ('button', 'a', 'summary', 'textarea', 'select') OR (tag = 'input' AND type NOT IN ('submit', 'hidden', 'file')) OR aria_role IN ('button', 'link', 'tab', 'option', 'textbox', 'combobox', 'listbox', 'checkbox', 'radio', 'switch') OR expanded IS NOT NULL OR clicks OR edits THEN 'hover' END, CASE WHEN overflow = 'auto' AND (scroll_height > 108 OR scroll_width > 128) THEN 'scroll' END], lambda v: v IS NOT NULL) AS actions FROM se)"""


TREE_CLASSES = ["card wide a:b extra", "btn", "x  y", ""]
TREE_TEXTS = ["start  trial", " price 3 / 4 ", "", "menu"]
#: Attributes of the made trees by name; expressions that Spark and DuckDB read alike, with {d} for whole division.
TREE_ATTRIBUTES = {
    "id": "CASE WHEN (i * 7 + page_id) % 9 = 0 OR i % 20 = 8 THEN concat('n:', i - i % 3) END",
    "data-test": "CASE WHEN (i + page_id) % 13 = 0 THEN concat('t', i) END",
    "aria-labelledby": "CASE WHEN i % 7 = 3 THEN concat('n:', i {d} 2 - (i {d} 2) % 3, '  n:', i + 1) END",
    "aria-label": "CASE WHEN i % 11 = 5 THEN concat(' Say \"it\" ', i) END",
    "title": "CASE WHEN i % 6 = 1 THEN concat('title ', i) END",
    "placeholder": "CASE WHEN i % 20 = 18 THEN 'type here' END",
    "for": "CASE WHEN i % 20 = 7 THEN concat('n:', i + 1 - (i + 1) % 3) END",
    "style": "CASE WHEN i % 8 = 2 THEN repeat('s', 300) END",
    "value": "CASE WHEN i % 9 = 4 THEN repeat('v', cast(100 + i AS int)) END",
}


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made tree over the tags of each page: every fourth element holds the next four, in document order; attributes and text by arithmetic."""
    t = P.tags(P.table(spark, sf_dir, "pages")).withColumn("n", F.count("*").over(W.partitionBy("page_id")))
    attributes = [x for name, e in TREE_ATTRIBUTES.items() for x in (F.lit(name), F.expr(e.replace("{d}", "div")))]
    attributes += [F.lit("class"), F.nullif(_pick(TREE_CLASSES, "i * 3 + page_id"), F.lit(""))]
    return t.select(
        "page_id", F.col("i").alias("idx"), F.expr("CASE WHEN i % 10 = 7 OR i % 20 = 4 THEN 'label' WHEN i % 10 = 8 THEN 'input' ELSE tag END").alias("tag"),
        F.expr("CASE WHEN i > 0 THEN cast(4 * ((i - 1) div 4) AS int) END").alias("parent"), F.expr("CASE WHEN i > 0 THEN sequence(0, cast(4 * ((i - 1) div 4) AS int), 4) ELSE array() END").alias("above"),
        F.expr("cast(CASE WHEN i % 4 = 0 AND i + 1 < n THEN n - 1 ELSE i END AS int)").alias("last"), F.map_filter(F.create_map(*attributes), lambda k, v: v.isNotNull()).alias("attrs"),
        _pick(TREE_TEXTS, "i + page_id").alias("content"), F.expr("40 + (i * 37 + page_id * 13) % 1200").alias("width"), F.expr("10 + (i * 53 + page_id * 7) % 800").alias("height"),
        F.expr("(i + page_id) % 3 <> 0").alias("painted"), _pick(["static", "absolute", "fixed", "static", "relative"], "i + page_id").alias("position"),
    )


_NAMES_SQL = ", ".join(f'{e.replace("{d}", "//")} AS "{n}"' for n, e in TREE_ATTRIBUTES.items())
#: The same trees in DuckDB.
TREE_SQL = f"""
tags AS (SELECT page_id, lower(unnest(t)) AS tag, generate_subscripts(t, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all({P.plain_sql("html")}, '{P.TAG}', 1) AS t FROM pages)),
tr AS (SELECT page_id, i, CASE WHEN i % 10 = 7 OR i % 20 = 4 THEN 'label' WHEN i % 10 = 8 THEN 'input' ELSE tag END AS tag, CASE WHEN i > 0 THEN 4 * ((i - 1) // 4) END AS parent, CASE WHEN i % 4 = 0 AND i + 1 < n THEN n - 1 ELSE i END AS last, {_NAMES_SQL},
  (['card wide a:b extra', 'btn', 'x  y', ''])[(i * 3 + page_id) % 4 + 1] AS class, (['start  trial', ' price 3 / 4 ', '', 'menu'])[(i + page_id) % 4 + 1] AS content, 40 + (i * 37 + page_id * 13) % 1200 AS width, 10 + (i * 53 + page_id * 7) % 800 AS height,
  (i + page_id) % 3 <> 0 AS painted, (['static', 'absolute', 'fixed', 'static', 'relative'])[(i + page_id) % 5 + 1] AS position FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM tags)),
si AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY page_id, parent, tag) > 1 THEN row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY i) END AS nth FROM tr)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elements with aria_role, kind, semantic_type, priority and actions."""
    from ..functions import elements as E

    e = elements(spark, sf_dir).withColumn("aria_role", E.aria_role())
    return e.withColumn("kind", E.kind()).withColumn("semantic_type", E.semantic_type()).withColumn("priority", E.priority()).withColumn("actions", E.actions())
