"""Centroid clustering: exact nearest centroids by the threshold algorithm.

For every dimension the centroids are kept sorted by their component. For a vector, each of these lists is walked outward from the vector's own
component: always the nearer of the two ends comes next. A centroid is compared exactly, with whole numbers, when a list first names it. One that no list
has named yet is at least as far in each dimension as that list's frontier, so the sum of the squared frontiers bounds its distance from below. The
walk stops when that sum strictly exceeds the best exact distance: centroids that tie have been named by then, and the smaller number wins.
Tasks do this for a batch of vectors at once; those that have stopped are left out of further steps.

Each round sends to the driver the sums of at most `clusters` cells; nothing else is gathered. The initial centroids are those of the vectors with the least
sha256 of "1:<id>". Everything is exact, so the order of rows and tasks doesn't matter.

Rows whose vector is null, has other than `size` components or holds null or non-finite ones are dropped. Rows without id are clustered, but are no initial
centroid; of rows with equal ids, each can be one, ordered by vector. With fewer rows than clusters there are as many centroids as rows with an id; without any
there is no result. Columns but id and vector are not looked at. Components are held at 2**62 (see vectors.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

CLUSTERS, ROUNDS, SCALE, SIZE = 16, 3, 64, 64
#: Vectors that are walked at once.
BATCH = 2048


class Lists:
    """The sorted lists of some centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension, place -> centroid
        self.values = np.take_along_axis(centroids.T, self.order, 1)

    def nearest(self, v: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of v, and the squared distance. counted: takes how many exact distances were needed."""
        n, k = len(v), len(self.centroids)
        v, values, centroids = V.alike(v, self.values, self.centroids)
        if v.dtype == object:  # rows that no long can hold: few, and compared in full
            d = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
            best = d.argmin(1)
            return best, d[np.arange(n), best]
        far = np.int64(V.MOST)
        best, which = np.full(n, far), np.zeros(n, np.int64)
        right = np.stack([np.searchsorted(values[d], v[:, d]) for d in range(v.shape[1])], 1)
        left = right - 1
        seen, rows = np.zeros((n, k), bool), np.arange(n)
        dims = np.arange(v.shape[1])
        steps = 0
        while len(rows):
            x, lo, hi = v[rows], left[rows], right[rows]
            below = np.where(lo >= 0, x - values[dims, np.maximum(lo, 0)], far)
            above = np.where(hi < k, values[dims, np.minimum(hi, k - 1)] - x, far)
            down = below <= above
            named = self.order[dims, np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            left[rows], right[rows] = lo - down, hi + ~down
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], named] = True
            fresh &= ~seen[rows]
            seen[rows] |= fresh
            r, c = np.nonzero(fresh)
            d = np.full((len(rows), k), far)
            d[r, c] = ((x[r] - centroids[c]) ** 2).sum(1)
            steps += len(r)
            new = d.argmin(1)  # of equal ones the smaller number
            d = d[np.arange(len(rows)), new]
            better = (d < best[rows]) | ((d == best[rows]) & (new < which[rows]))
            best[rows[better]], which[rows[better]] = d[better], new[better]
            # the next frontiers: what no list has named yet is at least so far
            lo, hi = left[rows], right[rows]
            below = np.where(lo >= 0, x - values[dims, np.maximum(lo, 0)], far)
            above = np.where(hi < k, values[dims, np.minimum(hi, k - 1)] - x, far)
            frontier = np.minimum(below, above)
            done = seen[rows].all(1)  # else no list is exhausted
            total = (np.where(done[:, None], 0, frontier) ** 2).sum(1)
            rows = rows[~done & ~(total > best[rows])]
        if counted is not None:
            counted.append(steps)
        return which, best


def _assigned(vectors: np.ndarray, lists: Lists, scale: int):
    """(first row, whole-numbered rows, centroid, squared distance) of batches of vectors; rows that need wide numbers go on their own."""
    limit = V.narrow(vectors.shape[1]) / scale
    wide = np.abs(vectors).max(1, initial=0) > limit
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            v = V.whole(vectors[some], scale)
            yield (some, v, *lists.nearest(v))


def _round(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    size = centroids.shape[1]

    def run(batches):
        lists, k = Lists(centroids), len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, object)
        for b in batches:
            for _, v, which, _ in _assigned(V.matrix(b.column(1), size), lists, scale):
                n += np.bincount(which, minlength=k)
                own = np.zeros(centroids.shape, v.dtype)
                np.add.at(own, which, v)
                sums += own
        yield V.sum_rows(n, sums)

    return V.means(rows.mapInArrow(run, V.SUMS), centroids)


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row that is kept."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    kind = dict(named.dtypes)["id"]
    named = named.where((F.size("vector") == size) & V.finite("vector"))
    drawn = named.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "id", "vector").limit(clusters).collect()
    if not drawn:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = V.whole(np.array([r.vector for r in drawn], float), scale)
    for _ in range(rounds):
        centroids = _round(named, centroids, scale)

    def run(batches):
        lists = Lists(centroids)
        for b in batches:
            for some, _, which, d in _assigned(V.matrix(b.column(1), size), lists, scale):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(which, pa.int32()), V.held(d)], names=["id", "cluster", "distance"])

    out = C.written(named.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # a row a cluster
    shas = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    held = lambda x: F.lit(min(int(x), V.LONG)).cast("long")
    return out.select(
        F.col("id").alias(key),
        "cluster",
        "distance",
        F.element_at(F.array(*(held(inertia.get(c, 0)) for c in range(len(shas)))), at).alias("cluster_inertia"),
        held(sum(inertia.values())).alias("inertia"),
        F.element_at(F.array(*map(F.lit, shas)), at).alias("centroid_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(C.read(spark, sf_dir, "embeddings"))


def _nearest_sql(centroids: str) -> str:
    return f"""SELECT v, arg_min(c, (d, c)) AS c, min(d) AS d FROM
 (SELECT x.v, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN {centroids} c ON x.i = c.i GROUP BY ALL) GROUP BY v"""


def _means_sql(centroids: str, assigned: str) -> str:
    return f"""SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM {centroids} c LEFT JOIN
 (SELECT a.c, x.i, (sum(x.x) - (sum(x.x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM {assigned} a JOIN x USING (v) GROUP BY a.c, x.i) m
 ON m.c = c.c AND m.i = c.i"""


_CTES = "".join(f",\na{n} AS MATERIALIZED ({_nearest_sql(f'c{n}')}),\nc{n + 1} AS MATERIALIZED ({_means_sql(f'c{n}', f'a{n}')})" for n in range(ROUNDS))
OP13_SQL = f"""
WITH k AS (SELECT vec_id AS v, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT v, i, CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM (SELECT v, unnest(embedding) AS c, unnest(range({SIZE})) AS i FROM k)),
f AS (SELECT v, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT v, sha256('1:' || v) AS h FROM k ORDER BY h LIMIT {CLUSTERS})),
c0 AS MATERIALIZED (SELECT f.c, x.i, x.x FROM f JOIN x USING (v)){_CTES},
z AS MATERIALIZED ({_nearest_sql(f"c{ROUNDS}")}),
s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT v AS vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM z JOIN s USING (c)
"""
