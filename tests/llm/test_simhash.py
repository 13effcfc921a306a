import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import common as C
from pagewright.llm import simhash as X

SCHEMA = "doc_id long, text string, fp string, id int, component string, leaf int"


def brute_components(ids, fps, radius=4):
    """Least id that links lead to, by comparing all pairs."""
    at = list(range(len(fps)))
    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius).tolist():
            a, b = at[i], at[j]
            if a != b:
                at = [min(a, b) if k in (a, b) else k for k in at]
    least = {}
    for i, k in zip(ids, at):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in at]


def clusters(r, n, flips):
    """Points in dense clouds about a few centers, and some far from all."""
    centers = [r.getrandbits(64) for _ in range(4)]
    out = [r.getrandbits(64) for _ in range(n // 4)]
    for _ in range(n):
        x = r.choice(centers)
        for _ in range(r.randrange(flips)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def frame(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in dict.fromkeys(fps)], "fp long")


def groups_of(points, links):
    at = {p: p for p in points}

    def root(p):
        while at[p] != p:
            p = at[p]
        return p

    for u, v in links:
        at[max(root(u), root(v))] = min(root(u), root(v))
    return {p: root(p) for p in points}


@pytest.mark.parametrize("most,leaf", [(20_000, 384), (60, 5), (8, 20)])
def test_links_join_what_lies_within_the_radius(spark, monkeypatch, most, leaf):
    """All trees, large leaves and tiles against all pairs."""
    monkeypatch.setattr(X, "LEAF", leaf)
    fps = list(dict.fromkeys(clusters(random.Random(most), 500, 12)))
    found = X.links(frame(spark, fps), most=most).collect()
    x = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = groups_of(x, [(r.u, r.v) for r in found])
    want = brute_components(list(range(len(fps))), fps)
    by = {}
    for f, w in zip(x, want):
        by.setdefault(w, set()).add(got[f])
    assert all(len(s) == 1 for s in by.values()) and len(by) == len(set(got.values()))


def test_leaves_that_a_point_asks():
    """Two points that differ in one bit of a third: one of them asks the other's leaf; no other leaf is asked."""
    r = random.Random(5)
    for part, (first, bits) in enumerate(X.THIRDS):
        for levels in (1, 3, 7):
            tree = X.vantage(levels, bits, part)
            for _ in range(30):
                a = r.getrandbits(64)
                around = [a ^ (1 << (first + i)) for i in range(bits)]
                own, who, leaf = X.placed(np.array([a, *around], np.uint64), part, tree)
                asked = {(int(w), int(x)) for w, x in zip(who, leaf)}
                for i in range(1, bits + 1):
                    assert ((0, int(own[i])) in asked) != ((i, int(own[0])) in asked)
                assert {x for w, x in asked if w == 0} <= {int(x) for x in own[1:]}
                assert sum(w == 0 for w, _ in asked) <= bits


def test_fingerprints_against_spark(spark):
    """Bits by Spark's own XXH64 (seed 42 too), for words of any kind; texts longer than a piece as well."""
    r = random.Random(1)
    words = ["Foo", "bar", "ÄÖ", "x y", "　", "B", "\U0001f600z", "é"]
    texts = [None, "", " \t\n", "One", "one two  THREE", "a b c d", "a b c d a b c d a"] + [" ".join(r.choice(words) for _ in range(n)) for n in (5, 60, 700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    w = F.expr("filter(split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")
    df = df.withColumn("w", w).withColumn("s", F.expr("CASE WHEN size(w) = 0 THEN array() WHEN size(w) < 4 THEN array(array_join(w, ' ')) ELSE transform(sequence(0, size(w) - 4), i -> array_join(slice(w, i + 1, 4), ' ')) END"))
    df = df.withColumn("h", F.expr("transform(s, x -> xxhash64(x))"))
    want = {}
    for row in df.collect():
        want[row.doc_id] = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in row.h) > len(row.h))
    got = {x.id: x.fp % (1 << 64) for x in X.fingerprints(df).collect()}
    assert got == want and got[0] == got[1] == got[2] == 0
    long = " ".join(r.choice("abcdefgh") for _ in range(2 * X.PIECE + 77))
    one = X.fingerprint(long.encode())
    words = long.split()
    hashes = [X.xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert one == sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def test_documents_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(6)]
    rows = [(None, None), (7, None), (7, ""), (900, " "), (8, "one"), (9, "ONE"), (None, "one"), (None, "lonely words of nobody")]
    for i in range(150):
        b = list(r.choice(base))
        for _ in range(r.randrange(4)):
            b[r.randrange(len(b))] = r.choice(words)
        rows.append((1000 + i // 2, " ".join(b)))
    rows.append((5000, " ".join(r.choice(words) for _ in range(120_000))))  # over half a megabyte
    rows.append((5001, rows[-1][1] + " end"))
    df = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], SCHEMA).repartition(5)
    got = X.near_fingerprints(df, most=50).collect()
    assert len(got) == len(rows)
    fps = [X.fingerprint((t or "").encode()) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=key) == sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], want), key=key)
    by = {x.doc_id: x.component_id for x in got}
    assert by[7] == by[900] == 7 and by[9] == 8 and by[5001] == 5000
    assert X.near_fingerprints(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.links(frame(spark, fps), radius=6)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = C.read(spark, sf, "documents").collect()
    fps = [X.fingerprint((r.text or "").encode()) for r in rows]
    want = set(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], brute_components([r.doc_id for r in rows], fps)))
    got = X.op12_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)
