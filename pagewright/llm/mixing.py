"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, lang, source). Each has a capacity: its tokens times `epochs`. From
the root down, a node's budget is shared among its children by weight; a child that can't
take its share takes its capacity, and what it leaves goes to its siblings in proportion to
their weights, since a node's budget never exceeds the capacity below it, shortages reach
an ancestor's siblings only when a whole subtree is full. A leaf's budget buys whole epochs and
then a prefix of the next one; an epoch is the order of an MD5 of seed, epoch and doc_id, so
it doesn't depend on how rows are partitioned.

Shares are rounded down to whole tokens, so fewer tokens than children of a node can stay
unspent there. Tokens are words ([^ \\t-\\r]+). Null domain, lang or source count as ''; a null
text has no tokens; rows without tokens are selected while they stand within the prefix.
Rows with equal doc_id are ordered by their token count, then taken as they come, which
can't be told apart in the result. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common as C

LEAF = ["domain", "lang", "source"]
#: Production parameters: percent of all tokens, most epochs, and weights; a name not listed weighs 1.
PERCENT, EPOCHS, SEED = 60, 2, "mix-1"
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}


def source_domain(source: Column | str = "source") -> Column:
    """The domain of a source: the first hexadecimal digit of its MD5 tells web, books and forum apart."""
    d = F.substring(F.md5(F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(""))), 1, 1)
    return F.when(d < "8", "web").when(d < "c", "books").otherwise("forum")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _big(c: Column, digits: int = 20) -> Column:
    return c.cast(T.DecimalType(digits, 0))


def share(nodes: DataFrame, level: str, parents: list[str], weights: dict[str, int]) -> DataFrame:
    """nodes (parents, level, capacity, _budget of the parent) with budget, their share of it.

    Children are taken in order of capacity by weight. Those before the first that its share
    doesn't fill take their capacity; the rest share what is left by weight.
    """
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(table[F.col(level)], F.lit(1)) if weights else F.lit(1)
    nodes = nodes.withColumn("_w", _big(weight, 10)).withColumn("_c", _big(F.col("capacity")))
    ratio = F.when(F.col("_w") > 0, F.col("capacity").cast("double") / F.col("_w").cast("double"))
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = by.orderBy(ratio.asc_nulls_last(), level)
    nodes = nodes.withColumn("_before", _big(F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    nodes = nodes.withColumn("_after", _big(F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)), 16))
    full = (F.col("_w") > 0) & (F.col("_c") * F.col("_after") <= F.col("_w") * (_big(F.col("_budget")) - F.col("_before")))
    nodes = nodes.withColumn("_full", full)
    nodes = nodes.withColumn("_taken", _big(F.coalesce(F.sum(F.when(F.col("_full"), F.col("_c"))).over(by), F.lit(0)))).withColumn("_rest", _big(F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(by), F.lit(0)), 16))
    part = F.expr("CASE WHEN _full THEN capacity WHEN _w = 0 OR _rest = 0 THEN 0L ELSE cast(_w * (cast(_budget AS decimal(20,0)) - _taken) div _rest AS bigint) END")
    return nodes.withColumn("budget", part).drop("_w", "_c", "_before", "_after", "_full", "_taken", "_rest", "_budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """leaves (LEAF, tokens, rows) with capacity and budget."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.expr(f"least(sum(tokens) * {int(percent)} div 100, sum(capacity))").alias("_budget"))
    for depth in (1, 2, 3):
        keys = LEAF[:depth]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.crossJoin(F.broadcast(total)) if depth == 1 else nodes.join(above, keys[:-1])  # total is one row
        above = share(nodes, keys[-1], keys[:-1], weights.get(keys[-1], {})).select(*keys, F.col("budget").alias("_budget"))
    return leaves.join(above, LEAF).withColumnRenamed("_budget", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, key: str = "doc_id", text: str = "text", domain: Column | None = None) -> DataFrame:
    """key, LEAF, n_tokens and copies (times taken, at least 1) of the rows that are selected.

    Token sums up to a row are found in two steps, so that no task holds a whole leaf: each leaf
    is cut into about as many buckets as a bucket has rows; sums of whole buckets, then
    sums within a bucket.
    """
    base = docs.select(F.col(key), *[F.coalesce(c, F.lit("")).alias(n) for n, c in (("domain", source_domain() if domain is None else domain), ("lang", F.col("lang")), ("source", F.col("source")))], words(text).alias("n_tokens"))
    base = C.cut(base)
    leaves = base.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = leaf_budgets(leaves, weights, percent, epochs).select(
        *LEAF,
        F.expr("CASE WHEN tokens = 0 THEN 0L ELSE budget div tokens END").alias("whole"),
        F.expr("CASE WHEN tokens = 0 THEN 0L ELSE budget % tokens END").alias("rest"),
        F.ceil(F.sqrt("rows")).cast("long").alias("buckets"),
    )
    plan = C.cut(plan)
    rows = base.join(plan, LEAF).withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("_bucket", F.expr("cast(conv(substr(_order, 1, 8), 16, 10) AS bigint) * buckets div 4294967296"))
    sums = rows.groupBy(*LEAF, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*LEAF, "_bucket").orderBy("_order", F.col(key), "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(sums, [*LEAF, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    copies = (F.col("whole") + (F.col("_upto") <= F.col("rest")).cast("long")).alias("copies")
    return rows.select(key, *LEAF, "n_tokens", copies).where("copies > 0")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.read(spark, sf_dir, "documents"))


def _level_sql(depth: int) -> str:
    keys, parents = ", ".join(LEAF[:depth]), LEAF[: depth - 1]
    name, up = LEAF[depth - 1], "total" if depth == 1 else f"b{depth - 1}"
    on = "" if depth == 1 else " USING (" + ", ".join(parents) + ")"
    part = "PARTITION BY " + (", ".join(parents) if parents else "1")
    weight = "CASE " + name + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[name].items()) + " ELSE 1 END" if WEIGHTS[name] else "1"
    return f"""
n{depth} AS (SELECT {keys}, sum(capacity) AS c, any_value(g.budget) AS b, CAST({weight} AS HUGEINT) AS w FROM (SELECT {keys}, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY {keys}) JOIN {up} g{on or ' ON true'} GROUP BY {keys}),
o{depth} AS (SELECT *, coalesce(sum(c) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa FROM n{depth} WINDOW x AS ({part} ORDER BY c::DOUBLE / w::DOUBLE, {name})),
f{depth} AS (SELECT *, c * wa <= w * (b - cb) AS ful FROM o{depth}),
b{depth} AS (SELECT {keys}, CASE WHEN ful THEN c ELSE (w * (b - coalesce(sum(c) FILTER (ful) OVER ({part}), 0))) // (sum(w) FILTER (NOT ful) OVER ({part})) END AS budget FROM f{depth}),"""


OP10_SQL = f"""
WITH base AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'books' ELSE 'forum' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, {EPOCHS} * sum(n_tokens)::HUGEINT AS capacity FROM base GROUP BY ALL),
total AS (SELECT sum(tokens)::HUGEINT * {PERCENT} // 100 AS budget FROM leaves),{"".join(_level_sql(d) for d in (1, 2, 3))}
plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM leaves JOIN b3 USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM base JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
