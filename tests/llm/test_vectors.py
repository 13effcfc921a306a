"""Codes of vector parts and centroids against plain versions, with whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import oracle
import pytest

from pagewright.llm import anchors as A
from pagewright.llm import centroids as K
from pagewright.llm import vectors as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int, cluster int"
NAN, INF = float("nan"), float("inf")


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return d.index(min(d)), min(d)


def updated(points, which, entries):
    out = []
    for k, e in enumerate(entries):
        own = [p for p, w in zip(points, which) if w == k]
        out.append([sum(c) // len(own) for c in zip(*own)] if own else e)
    return out


def whole(x, scale):
    return [max(-V.MOST, min(V.MOST, math.floor(scale * float(c)))) for c in x]


def plain_codes(rows, entries=64, parts=16):
    kept = [(i, whole(x, 256), label) for i, x, label in rows]
    first = sorted((i, [float(np.float32(c)) for c in x]) for i, x, _ in rows if i is not None)[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole(x, 256), p) for _, x in first] for p in range(parts)]
    for n in range(3):
        which = [[nearest(cut(v, p), books[p]) for _, v, _ in kept] for p in range(parts)]
        if n < 2:
            books = [updated([cut(v, p) for _, v, _ in kept], [w for w, _ in which[p]], books[p]) for p in range(parts)]
    errors = [sum(which[p][k][1] for p in range(parts)) for k in range(len(kept))]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    most = V.LONG
    return [(i, "".join(f"{which[p][k][0]:02x}" for p in range(parts)), min(errors[k], most), min(by[label], most), sha) for k, (i, _, label) in enumerate(kept)]


def plain_clusters(rows, clusters=16):
    kept = [(i, whole(x, 64)) for i, x, _ in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), [float(np.float32(c)) for c in x]) for i, x, _ in rows if i is not None)[:clusters]
    centroids = [whole(x, 64) for _, x in first]
    for _ in range(3):
        centroids = updated([v for _, v in kept], [nearest(v, centroids)[0] for _, v in kept], centroids)
    which = [nearest(v, centroids) for _, v in kept]
    total = [sum(d for w, d in which if w == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = V.LONG
    return [(i, w, min(d, most), min(total[w], most), min(sum(total), most), sha[w]) for (i, _), (w, d) in zip(kept, which)]


def ordered(rows):
    return sorted(rows, key=repr)


def made(r, n, spread=0.4, size=64):
    """Vectors with repeats, ties and coarse components."""
    out = []
    for i in range(n):
        x = [round(r.gauss(0, spread), r.choice([1, 2, 4])) for _ in range(size)] if i % 5 or not out else r.choice(out)[1]
        out.append((r.choice([None, i, i, i, i, i // 2]), [float(np.float32(c)) for c in x], r.choice([None, 0, 1, 1, 1])))
    return out


BAD = [(3, None, 1), (1, [], 1), (2, [0.5] * 63 + [None], 1), (4, [0.5] * 63 + [NAN], 1), (5, [INF] + [0.0] * 63, 1), (6, [-INF] + [0.0] * 63, None)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, x, label, "c", 1, 2) for i, x, label in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n", [1, 5, 70, 300])
def test_against_plain_versions(spark, n):
    rows = made(random.Random(n), n)
    rows[0] = (17, *rows[0][1:])
    df = frame(spark, rows + BAD + [(0, [1.0] * 60, 1)])  # another length
    got = A.coded(df.where("vec_id > 0 OR vec_id IS NULL OR size(embedding) = 64"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(map(tuple, got.collect())) == ordered(plain_codes(rows))
    got = K.clustered(df)
    assert ordered(map(tuple, got.collect())) == ordered(plain_clusters(rows))


def test_wide_components(spark):
    """Distances, sums and codebooks beyond a long are exact; what a long can't hold is given as the largest long."""
    r = random.Random(8)
    rows = [(i, [float(np.float32(r.choice([1e30, -1e30, 4e6, -3.7e9, 1e15, 0.25]) if r.random() < 0.1 else r.gauss(0, 1))) for _ in range(64)], i % 2) for i in range(90)]
    assert ordered(map(tuple, A.coded(frame(spark, rows)).collect())) == ordered(plain_codes(rows))
    assert ordered(map(tuple, K.clustered(frame(spark, rows)).collect())) == ordered(plain_clusters(rows))


def test_nothing_kept(spark):
    for rows in (BAD, [(None, None, None)]):
        assert A.coded(frame(spark, rows)).count() == 0
        assert K.clustered(frame(spark, rows)).count() == 0
    alone = frame(spark, [(None, [0.5] * 64, 1)])  # no row has an id: one entry, no initial centroid
    assert [tuple(x)[:4] for x in A.coded(alone).collect()] == [(None, "00" * 16, 0, 0)]
    assert K.clustered(alone).count() == 0


def test_trees_and_owned_balls():
    """Balls hold their points, sums and counts; most points are assigned by balls that one entry owns; all to the nearest, the first of ties."""
    r = np.random.default_rng(4)
    for n, spread in ((1, 1), (30, 4), (500, 2), (2048, 60)):
        points = np.round(r.normal(0, spread, (n, 4)) + 40 * r.integers(0, 3, (n, 1))).astype(np.int64)
        t = A.Tree(points).packed()
        assert sorted(t["points"].tolist()) == list(range(n)) and t["count"][0] == n
        for k in range(len(t["count"])):
            own = points[t["points"][t["first"][k] : t["last"][k]]]
            assert len(own) == t["count"][k] and (own.sum(0) == t["sum"][k]).all()
            assert (np.sqrt(((own - t["center"][k]) ** 2).sum(1)) <= t["radius"][k] + 1e-6).all()
        for entries in (points[:1], points[r.integers(0, n, 64)], np.zeros((5, 4), np.int64)):
            ball, entry, point, which = A.owned(t, points, entries)
            got = np.full(n, -1)
            for b, e in zip(ball, entry):
                at = t["points"][t["first"][b] : t["last"][b]]
                assert (got[at] == -1).all()
                got[at] = e
            assert (got[point] == -1).all()
            got[point] = which
            assert (got == A.nearest(points, entries)).all()
            if len(entries) == 1:
                assert ball.tolist() == [0]
    far = np.concatenate([r.normal(c, 1, (500, 4)) for c in (0, 500, 1000)]).round().astype(np.int64)
    t = A.Tree(far).packed()
    ball, entry, point, _ = A.owned(t, far, np.array([[0] * 4, [500] * 4, [1000] * 4]))
    assert len(ball) < 20 and not len(point)


def test_walks_stop_early():
    """The walk compares few centroids where they are told apart at once, and all that tie."""
    r = np.random.default_rng(2)
    c = (1000 * np.arange(16)[:, None] + r.integers(0, 50, (16, 64))).astype(np.int64)
    v = c[r.integers(0, 16, 300)] + r.integers(-20, 20, (300, 64))
    counted = []
    which, d = K.Lists(c).nearest(v, counted)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (which == full.argmin(1)).all() and (d == full.min(1)).all() and sum(counted) < 2 * len(v)
    twice = np.concatenate([c[::-1], c])
    assert (K.Lists(twice).nearest(v)[0] == ((v[:, None] - twice[None]) ** 2).sum(2).argmin(1)).all()
    few = r.integers(-3, 4, (400, 3))
    centers = r.integers(-3, 4, (20, 3))
    assert (K.Lists(centers).nearest(few)[0] == ((few[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()


@pytest.mark.parametrize("name,query,sql", [("op11", A.op11_vector_codes, A.OP11_SQL), ("op13", K.op13_centroids, K.OP13_SQL)])
def test_matches_sql(spark, name, query, sql):
    assert oracle.of_spark(query(spark, SF)) == oracle.rows(sql, SF)
