"""Breadth-first crawl over a link table, one level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import urls as U
from ..sources import pages as P
from .shared import cut, set_folder


def bfs(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """node and ord (from 1) of the first `most` nodes in the order of a first-in-first-out crawl.

    edges: (src, ord, dst); seeds: (node, ord). Order by level, place of the parent and place of the link in it
    equals that of a queue. A level is one join and one anti join; the visited nodes are at most `most`, and each
    level is checkpointed.
    """
    set_folder(edges.sparkSession)
    level = seeds.groupBy("node").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most)
    level = level.select("node", F.row_number().over(W.orderBy("ord")).alias("ord")).checkpoint()
    seen, n = level, level.count()
    while n < most:
        room = most - n
        found = level.select(F.col("node").alias("src"), F.col("ord").alias("parent")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("parent", "ord")).alias("at"))
        found = found.join(seen, "node", "left_anti").orderBy("at").limit(room)
        level = found.select("node", (F.row_number().over(W.orderBy("at")) + F.lit(n)).alias("ord")).checkpoint()
        more = level.count()
        if not more:
            break
        seen, n = seen.unionByName(level), n + more
    return seen


def discover(pages: DataFrame, start: str, most: int, sitemaps: DataFrame | None = None) -> DataFrame:
    """url and ord (from 1) of the first `most` pages that a crawl from start finds.

    pages: url and html of what was fetched; a page that wasn't is found but leads nowhere. Links and form actions
    of the same origin count, without query and fragment, but for assets. The queue holds start, then the
    pages of sitemaps (ord, body), then what each page links to, in order. Links are taken from pages once, into a table
    that is checkpointed: each level joins it.
    """
    spark = pages.sparkSession
    first = spark.createDataFrame([(start,)], "url string").select(U.page_url("url").alias("node"), U.origin_of(U.page_url("url")).alias("origin"), F.lit(0).alias("ord"))
    home, origin = first.select("node", "origin").first()
    inside = lambda df: df.where((U.origin_of("dst") == origin) & ~X.is_asset("dst"))
    found = P.links(pages.select(F.lit(0).alias("page_id"), "url", "html")).select(U.page_url("url").alias("src"), "ord", U.page_url("href", "base").alias("dst"))
    seeds = first.select("node", "ord")
    if sitemaps is not None:
        listed = P.sitemap_pages(sitemaps, origin, most).where(F.col("url") != home)
        seeds = seeds.unionByName(listed.select(F.col("url").alias("node"), F.col("ord").cast("int").alias("ord")))
    return bfs(cut(inside(found)), seeds, most).withColumnRenamed("node", "url")
