"""Masks as runs against masks as pixels."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import geometry, masks

SCHEMA = "item_id string, kind string, width int, height int, alpha binary"


def made(n=60):
    r = random.Random(4)
    rows = [(f"i{i}", r.choice(["button", "card"]), w := r.randrange(1, 9), h := r.randrange(1, 7), bytes(r.choice([0, 0, 10, 17, 18, 40, 56, 255]) for _ in range(w * h))) for i in range(n)]
    return rows + [("none", "card", 3, 2, None), ("zero", "card", 2, 2, bytes(4)), ("empty", "card", 0, 0, b"")]


def pixels(row):
    return [(row[0], row[1], p % row[2], p // row[2], a) for p, a in enumerate(row[4] or b"")]


def test_boxes(spark):
    rows = made()
    got = masks.boxes(masks.with_runs(spark.createDataFrame(rows, SCHEMA)))
    px = spark.createDataFrame([p for r in rows for p in pixels(r)], "item_id string, kind string, x int, y int, alpha int")
    want = geometry.alpha_boxes(px).select(*got.columns)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(got) == key(want) and got.count() > 30


def test_trims(spark):
    rows = made()
    got = {r.item_id: r for r in masks.trimmed(masks.with_runs(spark.createDataFrame(rows, SCHEMA))).collect()}
    for row in rows:
        limit = 56 if row[1] == "button" else 18
        seen = [(x, y, a) for _, _, x, y, a in pixels(row) if a >= limit]
        r = got[row[0]]
        if not seen:
            assert r.trim is None and (r.width, r.height) == row[2:4]
            continue
        x0, y0 = min(x for x, _, _ in seen), min(y for _, y, _ in seen)
        assert tuple(r.trim) == (x0, y0, max(x for x, _, _ in seen) - x0 + 1, max(y for _, y, _ in seen) - y0 + 1) and (r.width, r.height) == tuple(r.trim)[2:]
        assert sorted((s.x + k, s.y, s.alpha) for s in r.runs for k in range(s.n)) == sorted((x - x0, y - y0, a) for x, y, a in seen)


def test_cuts(spark):
    pictures = masks.with_runs(spark.createDataFrame([("a", "card", 2, 1, b"\xff\xff"), ("b", "card", 1, 1, b"\x05")], SCHEMA))
    cuts = masks.with_runs(spark.createDataFrame([("a", "card", 2, 1, b"\x00\x07"), ("c", "card", 9, 9, bytes(81))], SCHEMA))
    got = {r.item_id: [tuple(x) for x in r.runs] for r in masks.cut_out(pictures, cuts).collect()}
    assert got == {"a": [(0, 1, 1, 7)], "b": [(0, 0, 1, 5)]}
    with pytest.raises(Exception, match="differ: a"):
        masks.cut_out(pictures, cuts.withColumn("width", F.col("width") + 1)).collect()
    with pytest.raises(Exception, match="has 3 bytes"):
        masks.with_runs(spark.createDataFrame([("a", "card", 2, 2, b"123")], SCHEMA)).collect()
    wide = masks.encoded(bytes([9]) * 1_440_000, 1440, 1000)
    assert len(wide) == 1000 and wide[0]["n"] == 1440
