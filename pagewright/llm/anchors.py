"""Codes of vector parts by k-means over metric trees that the anchors hierarchy builds.

Vectors are cut into PARTS equal parts, each coded by the nearest of up to ENTRIES codebook entries of its position.
Tasks take their vectors in blocks. For each part position of a block a metric tree is built from the middle out: anchors are
chosen one by one, each the point that is farthest from its own anchor, and take over the points that are nearer to them
(points that the triangle inequality protects are not looked at); the anchors' balls are then joined, the closest first, up to a root,
and anchors with many points are split further in the same way. Every ball caches the sum and the count of its points. The
trees are written once, next to their vectors, to the shared folder; all rounds read them from there.

A round hands the codebooks down each tree. A ball inherits its parent's candidates and strikes those
that are farther than another one from all its points; once a single candidate is left, the ball is wholly owned, and its cached sum
and count go to that entry without a look at its points. Only leaves that are left with several compare points, exactly, with
whole numbers; ties go to the lower index. Bounds are taken with a margin over the rounding error, so a candidate that ties is never struck.

What is sent to the driver: at most ENTRIES vectors at first, then the sums of each round, one row for each component of the codebooks.

Rows whose vector is null, empty or holds null or non-finite components are dropped; so are those whose length isn't a multiple of PARTS or
differs from that of the vector with the least id. Rows with a repeated id are all coded; among the first entries, equal ids are ordered by
vector. A row without id is coded, but is no first entry. With fewer than ENTRIES vectors there are as many entries; an empty table gives no rows.
Columns but id, vector and label are not looked at. Components are held at 2**62 (see vectors.py).
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block; points of a leaf.
BLOCK, LEAF = 2048, 40


def anchors(points: np.ndarray) -> np.ndarray:
    """The anchor that owns each point: about as many anchors as the root of the number of points."""
    n = len(points)
    owner = np.zeros(n, np.int64)
    at = [points[0]]
    far = np.sqrt(((points - at[0]) ** 2).sum(1))
    while len(at) ** 2 < n:
        new = int(far.argmax())
        if far[new] == 0:
            break  # every point lies on its anchor
        half = np.sqrt(((np.array(at) - points[new]) ** 2).sum(1)) / 2
        look = np.flatnonzero(far > half[owner] * (1 - 1e-9))  # others are nearer to their anchor than to the new one
        d = np.sqrt(((points[look] - points[new]) ** 2).sum(1))
        won = d < far[look]
        won[look == new] = True
        owner[look[won]], far[look[won]] = len(at), d[won]
        at.append(points[new])
    return np.unique(owner, return_inverse=True)[1]


class Tree:
    """Balls over some points: center, radius, sum, count, first and last of its points in the order `points`, and its two children or -1."""

    def __init__(self, points: np.ndarray):
        self.points: list[int] = []
        self.rows: list[tuple] = []  # center, radius, sum, count, first, last, left, right
        exact, rough = points, points.astype(float)
        top = self._node(rough, exact, np.arange(len(points)))
        self.root = self._placed(top)
        del self._exact

    def _node(self, rough, exact, idx):
        """A ball as (center, radius, sum, count, children or None, points), built from the middle out."""
        self._exact = exact
        owner = anchors(rough[idx]) if len(idx) > LEAF else np.zeros(len(idx), np.int64)
        if owner.max() == 0:
            c = rough[idx].mean(0)
            return c, float(np.sqrt(((rough[idx] - c) ** 2).sum(1).max())), exact[idx].sum(0), len(idx), None, idx
        order = np.argsort(owner, kind="stable")
        balls = [self._node(rough, exact, part) for part in np.split(idx[order], np.flatnonzero(np.diff(owner[order])) + 1)]
        center, radius = np.array([b[0] for b in balls]), np.array([b[1] for b in balls])
        count = np.array([b[3] for b in balls], float)

        def joined(i, others):
            c = (center[i] * count[i] + center[others] * count[others, None]) / (count[i] + count[others])[:, None]
            r = np.maximum(np.sqrt(((c - center[i]) ** 2).sum(1)) + radius[i], np.sqrt(((c - center[others]) ** 2).sum(1)) + radius[others])
            return c, r

        k = len(balls)
        size = np.full((k, k), np.inf)
        for i in range(k - 1):
            size[i, i + 1 :] = joined(i, np.arange(i + 1, k))[1]
        left = np.ones(k, bool)
        for _ in range(k - 1):
            i, j = divmod(int(size.argmin()), k)
            c, r = joined(i, np.array([j]))
            balls[i] = (c[0], float(r[0]), balls[i][2] + balls[j][2], balls[i][3] + balls[j][3], (balls[i], balls[j]), None)
            center[i], radius[i], count[i], left[j] = c[0], r[0], count[i] + count[j], False
            size[j], size[:, j] = np.inf, np.inf
            others = np.flatnonzero(left)
            others = others[others != i]
            r = joined(i, others)[1] if len(others) else np.empty(0)
            size[np.minimum(i, others), np.maximum(i, others)] = r
        return balls[int(np.flatnonzero(left)[0])]

    def _placed(self, ball) -> int:
        """Lays the balls out; the stack keeps long chains from being a recursion."""
        todo, at = [(ball, -1, 0)], 0
        while todo:
            (c, r, s, n, kids, idx), parent, side = todo.pop()
            me = len(self.rows)
            self.rows.append([c, r, s, n, at, at + n, -1, -1])
            if parent >= 0:
                self.rows[parent][6 + side] = me
            if kids is None:
                self.points += idx.tolist()
                at += n
            else:  # the first child is placed next, so that a ball's points follow each other
                todo += [(kids[1], me, 1), (kids[0], me, 0)]
        return 0

    def packed(self) -> dict[str, np.ndarray]:
        columns = list(zip(*self.rows))
        return {
            "points": np.array(self.points, np.int32),
            "center": np.array(columns[0]),
            "radius": np.array(columns[1]) * (1 + 1e-9),
            "sum": np.array(columns[2]),
            **{k: np.array(c, np.int32) for k, c in zip(("count", "first", "last", "left", "right"), columns[3:])},
        }


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whose range each place belongs to, and the places."""
    n = last - first
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - (np.cumsum(n) - n)[who] + first[who]


def nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """The nearest entry of each point among those allowed, the first of equal ones."""
    points, entries = V.alike(points, entries)
    d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    if allowed is not None:
        d = np.where(allowed, d, d.max(initial=0) + 1)
    return d.argmin(1)


def owned(t: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray):
    """Balls of a tree that an entry owns (ball, entry), and the points that leaves have to assign (point, entry)."""
    e = entries.astype(float)
    square, apart = (e**2).sum(1), np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    balls, whose, loose, which = [], [], [], []
    at, open_ = np.zeros(1, np.int64), np.ones((1, len(e)), bool)
    while len(at):
        c = t["center"][at]
        value = square - 2 * c @ e.T  # squared distance of the center less its own square
        masked = np.where(open_, value, np.inf)
        best = masked.argmin(1)
        rows = np.arange(len(at))
        slack = 1e-9 * (1 + np.abs(value).max(1) + (c**2).sum(1))
        # over a ball, a candidate's squared distance less the best one's is at least that at the center, less 2 r |their distance|
        struck = value - value[rows, best][:, None] - 2 * t["radius"][at][:, None] * apart[best] > slack[:, None]
        open_ = open_ & ~struck
        alone = open_.sum(1) == 1
        balls.append(at[alone])
        whose.append(best[alone])
        leaf = ~alone & (t["left"][at] < 0)
        if leaf.any():
            who, place = _ranges(t["first"][at[leaf]].astype(np.int64), t["last"][at[leaf]].astype(np.int64))
            p = t["points"][place]
            loose.append(p)
            which.append(nearest(points[p], entries, open_[leaf][who]))
        inner = ~alone & ~leaf
        at = np.concatenate([t["left"][at[inner]], t["right"][at[inner]]]).astype(np.int64)
        open_ = np.concatenate([open_[inner], open_[inner]])
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(none + x) for x in (balls, whose, loose, which))


def _blocks(rows: DataFrame, size: int, parts: int, scale: int) -> DataFrame:
    """ids, labels, vectors and trees of blocks of rows (id, label, vector), in the shared folder."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                x = V.matrix(some.column(2), size)
                v = V.whole(x, scale)
                trees = [Tree(p).packed() for p in np.split(v, parts, axis=1)]
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([one(some.column(0)), one(some.column(1)), pa.array([pickle.dumps(v, 5)], pa.binary()), pa.array([pickle.dumps(trees, 5)], pa.binary())], names=["ids", "labels", "vectors", "trees"])

    return C.written(rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, vectors binary, trees binary"), "trees")


def _opened(b: pa.RecordBatch, row: int, parts: int):
    return np.split(pickle.loads(b.column(2)[row].as_buffer()), parts, axis=1), pickle.loads(b.column(3)[row].as_buffer())


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one assignment."""
    parts, entries, width = books.shape

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in batches:
            for row in range(b.num_rows):
                for k, (points, t) in enumerate(zip(*_opened(b, row, parts))):
                    ball, entry, point, which = owned(t, points, books[k])
                    np.add.at(n[k], entry, t["count"][ball])
                    np.add.at(n[k], which, 1)
                    own = np.zeros((entries, width), points.dtype)
                    np.add.at(own, entry, t["sum"][ball])
                    np.add.at(own, which, points[point])
                    sums[k] += own
        yield V.sum_rows(n.reshape(-1), sums.reshape(parts * entries, width))

    return V.means(blocks.select("ids", "labels", "vectors", "trees").mapInArrow(run, V.SUMS), books.reshape(-1, width)).reshape(books.shape)


def coded(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every row that is kept; code: two hex digits a part."""
    named = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = dict(named.dtypes)
    named = named.where(V.finite("vector")).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = named.where("id IS NOT NULL").orderBy("id", "vector").limit(entries).collect()
    schema = f"{key} {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        first = named.orderBy("vector").limit(1).collect()  # only rows without id, or none
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    size = len(first[0].vector)
    if any(len(r.vector) != size for r in first):
        first = named.where("id IS NOT NULL").where(F.size("vector") == size).orderBy("id", "vector").limit(entries).collect()
    start = V.whole(np.array([r.vector for r in first], float), scale)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = _blocks(named.where(F.size("vector") == size), size, parts, scale)
    for _ in range(rounds):
        books = _round(blocks, books)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                own, trees = _opened(b, row, parts)
                codes, error = np.zeros((len(own[0]), parts), np.uint8), 0
                for k, (points, t) in enumerate(zip(own, trees)):
                    ball, entry, point, which = owned(t, points, books[k])
                    who, place = _ranges(t["first"][ball].astype(np.int64), t["last"][ball].astype(np.int64))
                    codes[t["points"][place], k] = entry[who]
                    codes[point, k] = which
                    points, used = V.alike(points, books[k][codes[:, k]])
                    error = error + ((points - used) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1).flatten(), b.column(1).slice(row, 1).flatten(), pa.array([c.tobytes().hex() for c in codes]), V.held(error)], names=["id", "label", "code", "error"])

    out = C.written(blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    by = out.groupBy("label").agg(V.long_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sha = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return out.join(by, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(C.read(spark, sf_dir, "embeddings"))


def _assigned(books: str) -> str:
    """SQL of part p, vector id v, nearest entry e and its squared distance d."""
    return f"""SELECT p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM
 (SELECT x.p, x.v, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN {books} c ON x.p = c.p AND x.i = c.i GROUP BY ALL) GROUP BY p, v"""


def _updated(books: str, assigned: str) -> str:
    """SQL of the entries after one assignment: floor of the mean, or the entry as it was."""
    return f"""SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN
 (SELECT a.p, a.e, x.i, (sum(x.x) - (sum(x.x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM {assigned} a JOIN x ON x.p = a.p AND x.v = a.v GROUP BY a.p, a.e, x.i) m
 ON m.p = c.p AND m.e = c.e AND m.i = c.i"""


OP11_SQL = f"""
WITH k AS (SELECT vec_id AS v, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT v, unnest(embedding) AS c, unnest(range(len(embedding))) AS j, len(embedding) // {PARTS} AS w FROM k),
x AS MATERIALIZED (SELECT v, j // w AS p, j % w AS i, CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM u),
f AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS e FROM (SELECT v FROM k ORDER BY v LIMIT {ENTRIES})),
c0 AS MATERIALIZED (SELECT x.p, f.e, x.i, x.x FROM f JOIN x USING (v)),
a1 AS MATERIALIZED ({_assigned("c0")}),
c1 AS MATERIALIZED ({_updated("c0", "a1")}),
a2 AS MATERIALIZED ({_assigned("c1")}),
c2 AS MATERIALIZED ({_updated("c1", "a2")}),
a3 AS MATERIALIZED ({_assigned("c2")}),
r AS (SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY v)
SELECT v AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c2) AS codebooks_sha256
FROM r JOIN k USING (v)
"""
