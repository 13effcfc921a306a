"""Ranking, near-duplicate removal, selection and aggregation of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from .tree import attr, attribute_map, class_list


#: Fixed value: items that a page keeps.
MOST = 240


def ranked(items: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return items.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def priority_order() -> list[Column]:
    """Priority, then area, then document order."""
    return [F.col("priority").desc(), F.col("area").desc(), F.col("idx")]


def top_items(items: DataFrame, most: int = MOST) -> DataFrame:
    return ranked(items, ["page_id"], priority_order()).where(F.col("rank") <= most)


def reading_order(items: DataFrame) -> DataFrame:
    return ranked(items, ["page_id"], [F.col("y"), F.col("x"), F.col("area").desc(), F.col("priority").desc(), F.col("idx")], "reading")


def near(a: Column, b: Column) -> Column:
    """Nearly the same bounds: positions within 2, sizes within 3."""
    return (F.abs(a.x - b.x) <= 2) & (F.abs(a.y - b.y) <= 2) & (F.abs(a.width - b.width) <= 3) & (F.abs(a.height - b.height) <= 3)


def without_near_copies(items: DataFrame, kind: str = "kind") -> DataFrame:
    """Items of which no kept item of the same page and kind with higher priority has nearly the same bounds.

    The relation isn't transitive, so items are taken in order and compared with those kept so far: a fold over
    the items of one page, kind and row of height, as items further apart than a cell can't be near. Cells
    overlap no decisions: a group is cut only where consecutive y differ by more than 2.
    """
    w = W.partitionBy("page_id", kind).orderBy("y", "idx")
    cut = F.when(F.col("y") - F.lag("y").over(w) > 2, 1).otherwise(0)
    group = items.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rest = [c for c in items.columns if c not in ("page_id", kind)]
    before = lambda a, b: F.when(a["_by"] < b["_by"], -1).when(a["_by"] > b["_by"], 1).otherwise(0)
    rows = group.groupBy("page_id", kind, "_run").agg(F.array_sort(F.collect_list(F.struct(F.struct(-F.col("priority"), -F.col("area"), "idx").alias("_by"), *rest)), before).alias("_all"))
    kept = F.aggregate("_all", F.filter("_all", lambda x: F.lit(False)), lambda done, x: F.when(F.exists(done, lambda k: near(k, x)), done).otherwise(F.array_append(done, x)))
    return rows.select("page_id", kind, F.explode(kept).alias("_k")).select("page_id", kind, *[F.col(f"_k.{c}").alias(c) for c in rest])


def action_rows(items: DataFrame) -> DataFrame:
    """One row for each action of an item, in order; items without actions vanish."""
    return items.select("page_id", "idx", F.posexplode("actions").alias("pos", "action")).withColumn("id", F.concat_ws(":", F.format_string("block-%03d", F.col("idx") + 1), "action"))


def kind_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def site_totals(pages: DataFrame, by: str) -> DataFrame:
    """Totals of pages (status) by site."""
    return pages.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


def item_struct() -> Column:
    """The record of an item, from columns of its name in lower case with underscores, attrs and content."""
    text = X.normalize_text("content")
    name = F.coalesce(X.truthy("accessible_name"), F.col("label"))
    return F.struct(
        "id", F.col("id").alias("captureId"), "label", "kind", F.col("semantic_type").alias("semanticType"), F.upper("tag").alias("tagName"), F.col("selectors.css").alias("selector"), "selectors", "actions",
        F.struct(F.col("aria_role").alias("role"), name.alias("name"), *[attr(f"aria-{n}").alias(n) for n in ("expanded", "selected", "controls")], F.coalesce(attr("aria-hidden") == "true", F.lit(False)).alias("hidden")).alias("aria"),
        F.struct(F.lower("tag").alias("tagName"), F.coalesce(attr("id"), F.lit("")).alias("id"), class_list(12).alias("classList"), attribute_map().alias("attributes"), F.substring(text, 1, 240).alias("text")).alias("dom"),
        F.coalesce("source", F.lit("")).alias("sourceUrl"), F.col("painted").alias("ownPaint"), F.col("radii").alias("cornerRadii"), F.struct("x", "y", "width", "height").alias("bounds"), "area", "priority",
    )


def crop_paths(n: Column, id_: Column, kind: Column) -> tuple[Column, Column]:
    """Where an item's images go, without and with text: a folder for each kind; n: the place of the item from 1."""
    name = F.concat(F.format_string("%03d", n), F.lit("-"), id_, F.lit("-"), kind, F.lit(".png"))
    return F.concat_ws("/", F.lit("items"), kind, name), F.concat_ws("/", F.lit("items-with-text"), kind, name)


def agent_element(item: Column) -> Column:
    """What an agent needs of an item (with image and textImage): names, bounds, selectors, actions and both crops; an item without semantic type has its kind for it."""
    kind = F.coalesce(X.truthy(item["semanticType"]), item["kind"])

    def crop(*images: Column) -> Column:
        first = lambda f, none: F.coalesce(*[i[f] for i in images], F.lit(none))
        return F.struct(first("path", "").alias("path"), first("width", 0).alias("width"), first("height", 0).alias("height"), F.coalesce(*[i["bounds"] for i in images]).alias("bounds"), first("sha256", "").alias("sha256"))

    return F.struct(
        item["id"].alias("id"), kind.alias("type"), item["kind"].alias("kind"), kind.alias("semanticType"), item["label"].alias("label"), item["dom"]["text"].alias("text"), item["dom"]["tagName"].alias("tagName"), item["bounds"].alias("bbox"),
        item["selectors"].alias("selectors"), item["actions"].alias("actions"), item["aria"].alias("aria"), item["dom"].alias("dom"), crop(item["textImage"], item["image"]).alias("crop"), crop(item["image"]).alias("textlessCrop"),
    )


def crop_of(element: Column) -> Column:
    """The crop of an agent element as an entry of its own."""
    c = element["crop"]
    return F.struct(F.concat(element["id"], F.lit(":crop")).alias("id"), element["id"].alias("elementId"), *[element[n].alias(n) for n in ("semanticType", "label")], c["path"].alias("path"), c["width"].alias("width"), c["height"].alias("height"), c["bounds"].alias("bbox"), c["sha256"].alias("sha256"))


def actions_of(elements: Column) -> Column:
    """An entry for each action of each of an array of agent elements, in order."""
    one = lambda e: F.transform(e["actions"], lambda a: F.struct(F.concat_ws(":", e["id"], a).alias("id"), e["id"].alias("elementId"), a.alias("action"), e["label"].alias("label"), e["semanticType"].alias("semanticType"), F.coalesce(X.truthy(e["selectors"]["captureId"]), X.truthy(e["selectors"]["css"]), F.lit("")).alias("selector")))
    return F.flatten(F.transform(elements, one))


#: Id, file and whether text is hidden of the pictures of a page.
SCREENSHOTS = [("full-page", "screenshots/full-page.png", False), ("viewport", "screenshots/viewport.png", False), ("with-text-full-page", "screenshots/with-text.png", False), ("without-text-full-page", "screenshots/without-text.png", True)]


def page_documents(pages: DataFrame, items: DataFrame) -> DataFrame:
    """The nested document of each page: pages (page_id, url, title, captured_at, image_width, image_height, image_sha, textless_sha), items (page_id, reading, item); pages without items have empty lists."""
    rows = items.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("reading", "item")), lambda a, b: a["reading"] - b["reading"]).alias("_rows"), F.count("*").alias("_n"))
    both = pages.join(rows, "page_id", "left")
    total = F.coalesce("_n", F.lit(0))
    kinds = F.transform("_rows", lambda r: r["item"]["kind"])
    counted = F.transform(F.sort_array(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias("value")))
    counts = F.coalesce(F.map_from_entries(counted), F.create_map().cast("map<string,bigint>"))
    none = F.slice(F.array(F.struct(F.lit(0).alias("reading"), F.lit(None).cast(items.schema["item"].dataType).alias("item"))), 1, 0)
    listed = F.transform(F.coalesce("_rows", none), lambda r: r["item"])
    image = lambda path, sha: F.struct(F.lit(path).alias("path"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), F.col(sha).alias("sha256"))
    shot = lambda name, path, hidden: F.struct(F.lit(name).alias("id"), F.lit(path).alias("path"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), F.col("textless_sha" if hidden else "image_sha").alias("sha256"), F.lit(hidden).alias("textHidden"))
    out = both.withColumn("items", listed).withColumn("elements", F.transform("items", agent_element))
    return out.select(
        "page_id", F.lit("2.0.0").alias("schemaVersion"), F.lit("agent-ready-ui").alias("captureKind"), "url", "title", F.col("captured_at").alias("capturedAt"),
        F.array(F.struct(F.lit("page-001").alias("id"), "url", "title", F.lit("full-page").alias("screenshotId"), total.alias("totalBlocks"), counts.alias("itemKindCounts"))).alias("pages"),
        image("screenshots/full-page.png", "image_sha").alias("image"), image("screenshots/with-text.png", "image_sha").alias("withTextImage"), image("screenshots/without-text.png", "textless_sha").alias("textlessImage"), image("screenshots/without-text.png", "textless_sha").alias("withoutTextImage"),
        F.array(*[shot(*s) for s in SCREENSHOTS]).alias("screenshots"), "elements", actions_of(F.col("elements")).alias("actions"), F.transform("elements", crop_of).alias("crops"), total.alias("totalBlocks"), counts.alias("itemKindCounts"), "items",
    )


def page_results(pages: DataFrame) -> DataFrame:
    """pages (site, ord, url, error, blocks and more) with status, folder and manifest: a page whose capture failed stays, with its error and without a manifest.

    The only page of a site lies in the site's folder itself.
    """
    alone = F.count("*").over(W.partitionBy("site")) == 1
    folder = F.when(alone, F.col("site")).otherwise(F.concat(F.col("site"), F.lit("/pages/page-"), F.format_string("%03d-", "ord"), X.slug("url")))
    good = F.col("error").isNull()
    return pages.withColumn("status", F.when(good, "success").otherwise("failed")).withColumn("folder", folder).withColumn("manifest", F.when(good, F.concat("folder", F.lit("/manifest.json"))))


def site_documents(results: DataFrame) -> DataFrame:
    """The document of each site: its pages in order and their totals; results as page_results gives them, with job_id, start_url and mode."""
    page = F.struct("ord", "url", "status", F.col("folder").alias("outputDir"), F.col("manifest").alias("manifestPath"), F.when(F.col("status") == "success", F.col("blocks")).alias("totalBlocks"), "error")
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(F.col("job_id").alias("jobId"), "mode", F.col("start_url").alias("startUrl")).agg(F.count("*").alias("totalPages"), count("success").alias("succeeded"), count("failed").alias("failed"), F.sort_array(F.collect_list(page)).alias("pages"))


def patch_items(items: DataFrame, chosen: DataFrame, manifest: Column) -> DataFrame:
    """The chosen items (reading from 0 in `at`, in the order of `pos`) with index, source (where the image lies) and path (where the patch has it)."""
    picked = items.join(chosen, F.col("reading") == F.col("at") + 1)
    name = F.concat(F.format_string("%03d-", F.col("reading")), F.coalesce(X.truthy("id"), F.format_string("item-%d", F.col("reading"))), F.lit(".png"))
    path = F.concat_ws("/", F.lit("items"), F.coalesce(X.truthy("kind"), F.lit("unknown")), name)
    return picked.withColumn("index", F.col("reading")).withColumn("source", X.resolved_path(manifest, "image")).withColumn("path", path)


def patch_documents(pages: DataFrame, picked: DataFrame, created: Column) -> DataFrame:
    """The document of each page's patch: pages (page_id, job_id, url, manifest), picked as patch_items gives it; a page of which nothing is picked has an empty patch.

    A patch is named after its job, else `patch`, and the time at which it is made; its images lie in its own folder.
    """
    made = F.date_format(F.to_utc_timestamp(created, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = picked.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "index", "id", "kind", "source", "path"))).alias("_rows"))
    kind = rows.schema["_rows"].dataType
    p = pages.join(rows, "page_id", "left").withColumn("patchId", F.concat(F.coalesce(X.truthy("job_id"), F.lit("patch")), F.lit("-"), F.regexp_replace(made, "[:.]", "-")))
    p = p.withColumn("outputDir", F.concat(F.lit("patches/"), "patchId")).withColumn("_rows", F.coalesce("_rows", F.array().cast(kind)))
    listed = F.transform("_rows", lambda r: F.struct(r["index"].alias("index"), r["id"].alias("id"), r["kind"].alias("kind"), r["source"].alias("source"), F.concat_ws("/", F.col("outputDir"), r["path"]).alias("path")))
    return p.select("page_id", "patchId", "outputDir", F.col("manifest").alias("sourceManifest"), F.coalesce("url", F.lit("")).alias("sourceUrl"), made.alias("createdAt"), F.size("_rows").alias("totalItems"), listed.alias("items"))
