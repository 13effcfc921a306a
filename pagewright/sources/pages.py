"""Sources: captured pages, their tags, links and text parts, sitemaps, and JSON manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U

#: What starts a tag, and what holds no tags: comments and the bodies of scripts and styles.
TAG = "<([a-zA-Z][a-zA-Z0-9]*)"
SILENT = "(?is)<!--.*?(?:-->|\\z)|(<script\\b[^>]*>).*?(</script|\\z)|(<style\\b[^>]*>).*?(</style|\\z)"
LINK = "(?is)<(?:a|area)\\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\\shref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
BASE = "(?is)<base\\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\\shref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
FORM = "(?is)<form\\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\\saction\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(html: Column | str) -> Column:
    """html without comments and the bodies of scripts and styles, in which nothing is a tag."""
    return F.regexp_replace(X.col(html), SILENT, "$1$2$3$4")


def plain_sql(html: str) -> str:
    """The same as a DuckDB expression."""
    return f"regexp_replace({html}, '{SILENT}', '\\1\\2\\3\\4', 'g')"


def tags(pages: DataFrame) -> DataFrame:
    """page_id, i (0-based document order) and tag of every start tag in lower case, found by pattern in the JVM."""
    found = F.regexp_extract_all(plain("html"), F.lit(TAG), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("i", "tag")).withColumn("tag", F.lower("tag"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, base, ord (from 0), href and source of links (of `a` and `area`), then of form actions; empty ones are left out.

    href has its character references replaced; base is what hrefs are seen from: the page's first `base` element, or its URL.
    """
    bare = lambda h: U.decoded(F.regexp_replace(h, "^[\"']|[\"']$", ""))
    found = lambda p, s: F.transform(F.regexp_extract_all("_html", F.lit(p), F.lit(1)), lambda h: F.struct(bare(h).alias("href"), F.lit(s).alias("source")))
    both = F.filter(F.concat(found(LINK, "link"), found(FORM, "form")), lambda x: x.href != "")
    rows = pages.select("page_id", "url", plain("html").alias("_html"))
    own = X.truthy(bare(F.regexp_extract("_html", BASE, 1)))
    base = F.when(own.isNull(), F.col("url")).otherwise(F.coalesce(U.resolved(own, "url"), F.col("url")))
    # the array has no name, else Spark would test its size first: twice the work, and on pages that a later join leaves out
    found_in = rows.select("page_id", "url", base.alias("base"), "_html").select("page_id", "url", "base", F.posexplode(both).alias("ord", "l"))
    return found_in.select("page_id", "url", "base", "ord", "l.href", "l.source")


def sitemap_urls(robots: Column | str, start_origin: Column) -> Column:
    """The default sitemap, then those that robots.txt declares; each once."""
    lines = F.transform(F.split(X.col(robots), "\n"), lambda x: F.regexp_replace(x, f"^{X.BLANK}|{X.BLANK}$", ""))
    declared = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit("(?i)^sitemap:"))), lambda x: F.regexp_replace(x, "(?i)^sitemap:\\s*", ""))
    return F.array_distinct(F.concat(F.array(F.concat(start_origin, F.lit("/sitemap.xml"))), declared))


def sitemap_pages(documents: DataFrame, start_origin: str, most: int) -> DataFrame:
    """ord (from 1) and url of the first `most` pages of sitemaps (ord, body): same origin, no assets, each once."""
    locs = documents.select("ord", F.posexplode(F.regexp_extract_all("body", F.lit("(?i)<loc>\\s*([^<]+?)\\s*</loc>"), F.lit(1))).alias("pos", "loc"))
    pages = locs.select("ord", "pos", U.page_url(U.decoded("loc")).alias("url")).where((U.origin_of("url") == start_origin) & ~X.is_asset("url"))
    first = pages.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at"))
    top = first.orderBy("at").limit(most)  # at most as many rows as a crawl has pages
    from pyspark.sql.window import Window as W

    return top.select(F.row_number().over(W.orderBy("at")).alias("ord"), "url")


def landed(wanted: DataFrame, bodies: DataFrame) -> DataFrame:
    """wanted (url and more) with body: what was fetched from it with a status from 200 to 299, '' for what failed or is missing.

    bodies: url, status and body; of several rows of a URL one with such a status counts, of these the largest body.
    """
    good = bodies.where(F.col("status").between(200, 299)).groupBy("url").agg(F.max("body").alias("_body"))
    return wanted.join(good, "url", "left").withColumn("body", F.coalesce("_body", F.lit(""))).drop("_body")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a JSON object of strings; a missing or broken file has none."""
    kind = "key string, value string"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], kind)
    entries = F.map_entries(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return text.select(F.inline(entries)).select("key", "value")


def write_config(config: DataFrame, path: str) -> None:
    """key and value as one JSON object in a folder; null values are left out, of repeated keys the largest value counts."""
    one = config.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
    whole = one.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON document per file; malformed input fails."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, one folder for each value of `by` if it is given."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").json(path)


def ax_nodes(documents: DataFrame) -> DataFrame:
    """Accessibility nodes from JSON (page_id, body): null and empty properties are left out."""
    value = "struct<value:string>"
    kind = f"array<struct<nodeId:string,backendDOMNodeId:bigint,ignored:boolean,role:{value},name:{value},value:{value},description:{value},childIds:array<string>,properties:array<struct<name:string,value:{value}>>>>"
    n = documents.select("page_id", F.explode(F.from_json("body", kind)).alias("n"))
    props = F.map_filter(F.map_from_entries(F.transform("n.properties", lambda p: F.struct(p["name"].alias("key"), p["value"]["value"].alias("value")))), lambda k, v: v.isNotNull() & (v != ""))
    return n.select("page_id", "n.nodeId", "n.backendDOMNodeId", F.coalesce("n.ignored", F.lit(False)).alias("ignored"), *[F.col(f"n.{c}.value").alias(c) for c in ("role", "name", "value", "description")], F.coalesce("n.childIds", F.array().cast("array<string>")).alias("childIds"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("properties"))
