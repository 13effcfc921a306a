"""SimHash near-duplicates: exact pairs of fingerprints by vantage-point trees.

A document's fingerprint has a bit set if more than half of its shingles' XXH64 hashes (seed 42) have it. Documents of one fingerprint are one point;
the search is over points. Two points that differ in at most `radius` (4) bits differ in at most one bit of one third of the bits, so each third has a
vantage-point tree of its own, over the Hamming distance in that third. A level of a tree parts the points by their distance to the level's
vantage point; a leaf is a shard. A point is stored in its own leaf. If a point differs from it in one bit of the third, the triangle
inequality, which holds with equality here, says that all distances differ by one: so a point also asks the leaves that lie just across the boundaries,
those that it would be in with one bit changed. Of two such points only the one that is farther from the first vantage point asks.
The number of levels follows the logarithm of the number of points, and a point asks at most half as many leaves as a third has bits.

Inside a leaf, points are ordered by their distance, over all bits, to a vantage point of the leaf, and compared only with those whose distance differs by at
most `radius`; pairs that are already joined inside the leaf are not looked at again. A leaf puts out links that span what it has joined, one for a
point at most, never all its pairs.

Leaves with more than `most` rows (many different fingerprints that agree on a third) are taken last: their points are first linked with the leaf's vantage point
where they are near it, and have the labels of the components found so far. Those with the vantage point's label needn't be compared
with each other; the others meet them, and each other, in tiles of about `most` rows. A leaf of m rows of which o are others costs o * m / most rows.

All pairs count: nothing is capped or sampled. A null or empty text, and one without words, has fingerprint zero, linked like any other. Equal doc_ids are
nodes of their own with the same id. A null doc_id has a component only if a document of its component has an id. Columns but key and text are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SEED, RADIUS, SHINGLE = 42, 4, 4
#: First bit and number of bits of the thirds.
THIRDS = ((0, 21), (21, 21), (42, 22))
#: Points that a leaf should have; rows of a leaf, or of a tile, at most; rows of a group of leaves; pairs compared at once.
LEAF, MOST, ROWS, PAIRS = 384, 20_000, 30_000, 1 << 20
#: Shingles that are turned into bits at once.
PIECE = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < k:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), PIECE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(first[at : at + PIECE], last[at : at + PIECE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fp (64 bits as a long) of every row."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            at = b.column(1)
            fp = [fingerprint(t.as_buffer().to_pybytes(), k) if t.is_valid else 0 for t in at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(key, text).mapInArrow(run, f"id {kind}, fp long")


def vantage(levels: int, bits: int, seed: int) -> np.ndarray:
    """The vantage points of a tree's levels, (levels, bits): fixed, each as far from the others' pattern as chance puts it."""
    return np.random.default_rng([20250101, seed]).integers(0, 2, (levels, bits), dtype=np.int64)


def levels_for(points: int) -> int:
    """Levels of a tree whose leaves have about LEAF points; a level of 21 bits parts points as evenly as 8.2 equal parts would."""
    return min(7, max(1, math.ceil(math.log(max(points, 1) / LEAF, 8.2))))


def placed(fp: np.ndarray, part: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's own leaf in the tree of a third, and (point, leaf) of the leaves it asks; points: the tree's vantage points."""
    first, bits = THIRDS[part]
    x = ((fp[:, None] >> (first + np.arange(bits)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
    step = 23 ** np.arange(len(points), dtype=np.int64)
    unlike = [x != v for v in points]
    own = sum(s * u.sum(1) for s, u in zip(step, unlike))
    # changing a bit brings a point nearer to the vantage points it differs from in that bit, and farther from the others
    moved = sum(s * np.where(u, -1, 1) for s, u in zip(step, unlike)) + own[:, None]
    moved = np.where(unlike[0], moved, -1)  # only toward the first vantage point
    moved.sort(1)
    new = moved >= 0
    new[:, 1:] &= moved[:, 1:] != moved[:, :-1]
    who, at = np.nonzero(new)
    return own * 3 + part, who, moved[who, at] * 3 + part


def shards(points: DataFrame, levels: int) -> DataFrame:
    """leaf, fp and asks of every row of the trees."""
    trees = [vantage(levels, bits, k) for k, (_, bits) in enumerate(THIRDS)]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                fp = b.column(0).to_numpy()[at : at + (1 << 14)]
                for k, tree in enumerate(trees):
                    own, who, asked = placed(fp.view(np.uint64), k, tree)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, asked])), pa.array(np.concatenate([fp, fp[who]])), pa.array(np.arange(len(own) + len(who)) >= len(own))], names=["leaf", "fp", "asks"])

    return points.select("fp").mapInArrow(run, "leaf long, fp long, asks boolean")


class Joined:
    """Labels of some points, joined as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins points x and y, pair by pair."""
        while True:
            a, b = self.label[x], self.label[y]
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def linked(x: np.ndarray, y: np.ndarray, joined: Joined, at_x: np.ndarray, at_y: np.ndarray, radius: int, center: np.uint64) -> None:
    """Joins all points of x and y that lie within radius; at_x, at_y: their numbers in `joined`.

    Points are ordered by their distance to the center, so that only runs whose distances differ by at most radius are compared.
    """
    if not len(x) or not len(y):
        return
    dx, dy = np.bitwise_count(x ^ center).astype(np.int64), np.bitwise_count(y ^ center).astype(np.int64)
    ox, oy = np.argsort(dx, kind="stable"), np.argsort(dy, kind="stable")
    x, y, dx, dy, at_x, at_y = x[ox], y[oy], dx[ox], dy[oy], at_x[ox], at_y[oy]
    lo = 0
    while lo < len(x):
        begin = np.searchsorted(dy, dx[lo] - radius)
        hi = min(len(x), lo + max(1, PAIRS // max(1, len(y) - begin)))
        end = np.searchsorted(dy, dx[hi - 1] + radius, "right")
        for j in range(begin, end, PAIRS):
            k = min(end, j + PAIRS)
            a, b = joined.label[at_x[lo:hi]], joined.label[at_y[j:k]]
            i, m = np.nonzero((np.bitwise_count(x[lo:hi, None] ^ y[None, j:k]) <= radius) & (a[:, None] != b[None]))
            joined.add(at_x[lo + i], at_y[j + m])
        lo = hi


def _spans(fp: np.ndarray, joined: Joined) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that span what was joined."""
    away = np.flatnonzero(joined.label != np.arange(len(fp)))
    return fp[away], fp[joined.label[away]]


def _leaves(radius: int):
    """Links of the leaves of a group (leaf, fp, asks)."""

    def run(t: pa.Table) -> pa.Table:
        leaf, fp, asks = (t.column(c).to_numpy() for c in ("leaf", "fp", "asks"))
        order = np.lexsort((fp, asks, leaf))
        leaf, fp, asks = leaf[order], fp[order].view(np.uint64), asks[order]
        cut = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for lo, hi in zip(cut, np.append(cut[1:], len(leaf))):
            mid = lo + int((~asks[lo:hi]).sum())
            if mid == lo or hi - lo < 2:
                continue
            own = fp[lo:hi]
            joined, at = Joined(hi - lo), np.arange(hi - lo)
            center, n = own[0], mid - lo
            near = np.flatnonzero(np.bitwise_count(own ^ center) <= radius)
            joined.add(np.zeros(len(near), np.int64), near)
            linked(own[:n], own[:n], joined, at[:n], at[:n], radius, center)
            linked(own[n:], own[:n], joined, at[n:], at[:n], radius, center)
            u, v = _spans(own, joined)
            us.append(u)
            vs.append(v)
        return pa.table({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    return run


def _tile(radius: int):
    """Links of a tile (fp, tile, label): pairs of rows of different labels."""

    def run(t: pa.Table) -> pa.Table:
        fp, label, side = t.column("fp").to_numpy().view(np.uint64), t.column("label").to_numpy(), t.column("tile").to_numpy()
        _, first, number = np.unique(label, return_index=True, return_inverse=True)
        joined, at = Joined(len(fp)), np.arange(len(fp))
        joined.label = first[number]  # rows of a label are joined already
        x, y = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        linked(fp[x], fp[y], joined, at[x], at[y], radius, fp[0])
        moved = first[joined.label[first] != first]
        return pa.table({"u": fp[moved].view(np.int64), "v": fp[joined.label[moved]].view(np.int64)})

    return run


def links(points: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (u, v) between fingerprints (fp, distinct) that join all that lie within radius, and no others; radius: at most 5."""
    if not 0 <= radius <= 5:  # beyond, two points needn't agree within one bit on any third
        raise ValueError("radius must be from 0 to 5")
    rows = C.written(shards(points, levels_for(points.count())), "shards")
    size = rows.groupBy("leaf").agg(F.count("*").alias("m"), F.min(F.when(~F.col("asks"), F.col("fp"))).alias("center"))
    large = C.written(size.where(F.col("m") > most).where("center IS NOT NULL"), "large-leaves")
    groups = max(1, rows.count() // ROWS)
    within = rows.join(large.select("leaf"), "leaf", "left_anti")
    found = within.groupBy(F.pmod(F.xxhash64("leaf"), F.lit(groups)).alias("group")).applyInArrow(_leaves(radius), "u long, v long")
    hot = rows.join(large, "leaf")
    star = hot.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= radius) & (F.col("fp") != F.col("center"))).select(F.col("fp").alias("u"), F.col("center").alias("v"))
    found = C.written(found.unionByName(star), "links")
    if large.isEmpty():
        return found
    labels = C.written(components(found), "labels")
    name = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_label"))
    centers = large.select("leaf", "center").join(name("center"), "center", "left").select("leaf", F.coalesce("center_label", "center").alias("center_label"))
    named = hot.select("leaf", "fp").distinct().join(name("fp"), "fp", "left").withColumn("label", F.coalesce("fp_label", "fp"))
    named = C.written(named.join(centers, "leaf").select("leaf", "fp", "label", (F.col("label") != F.col("center_label")).cast("int").alias("other")), "labelled")
    count = lambda o: F.ceil(F.sum(F.when(F.col("other") == o, 1).otherwise(0)) / (most // 2)).cast("int")
    tiles = named.groupBy("leaf").agg(count(0).alias("same"), count(1).alias("others")).where("others > 0")
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    dealt = named.join(tiles, "leaf").withColumn("tile", F.when(F.col("other") == 0, part("same")).otherwise(F.col("same") + part("others")))
    last = F.col("same") + F.col("others") - 1
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.when(F.col("other") == 0, F.col("same")).otherwise(F.lit(0)), last)))
    pair = F.struct("leaf", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"))
    return found.unionByName(dealt.groupBy(pair.alias("pair")).applyInArrow(_tile(radius), "u long, v long"))


def near_fingerprints(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (least key that links lead to) of every row."""
    rows = C.written(fingerprints(docs, k, key, text), "fingerprints")
    points = C.written(rows.groupBy("fp").agg(F.min("id").alias("first")), "points")
    joined = components(links(points, radius, most))
    grouped = points.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    of = grouped.join(least, "root").select(F.col("fp").alias("point"), "component")
    out = rows.join(of, F.col("fp") == F.col("point"), "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(C.read(spark, sf_dir, "documents"))
