"""Alpha masks of items as runs: one row an item, whatever its size, in place of a row a pixel.

A mask is width, height and runs, an array of (y, x, n, alpha): n pixels from (x, y) to the right that have the same alpha. Pixels of no run are transparent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import alpha_threshold

RUNS = "array<struct<y:int,x:int,n:int,alpha:int>>"
#: Fixed value: the alpha that some pixel of an item has to reach.
FAINT = 32


def encoded(alpha: bytes, width: int, height: int) -> list[dict]:
    """The runs of a mask of one byte a pixel, row by row."""
    if len(alpha) != width * height:
        raise ValueError(f"a mask of {width} x {height} pixels has {len(alpha)} bytes")
    a = np.frombuffer(alpha, np.uint8).reshape(height, width)
    new = np.ones(a.shape, bool)
    new[:, 1:] = a[:, 1:] != a[:, :-1]
    y, x = np.nonzero(new)
    n = np.diff(np.append(y * width + x, width * height))
    v = a[y, x]
    return [{"y": int(p), "x": int(q), "n": int(m), "alpha": int(c)} for p, q, m, c in zip(y, x, n, v) if c]


def with_runs(masks: DataFrame) -> DataFrame:
    """masks (width, height, alpha: a byte a pixel, row by row) with runs in place of alpha; a null alpha has none. A mask of another size than it says is an error."""
    rest = [c for c in masks.columns if c != "alpha"]
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("y", "x", "n", "alpha")]))
    types = masks.select(*rest).schema

    def run(batches):
        for b in batches:
            w, h = b.column(rest.index("width")).to_pylist(), b.column(rest.index("height")).to_pylist()
            runs = [None if a is None else encoded(a, x, y) for a, x, y in zip(b.column(len(rest)).to_pylist(), w, h)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs, kind)], names=[*rest, "runs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields)
    return masks.select(*rest, "alpha").mapInArrow(run, f"{schema}, runs {RUNS}")


def _shown(threshold: Column) -> Column:
    return F.filter("runs", lambda r: r["alpha"] >= threshold)


def box(threshold: Column) -> Column:
    """(x0, y0, x1, y1) of the pixels that reach a threshold; null without any."""
    seen = _shown(threshold)
    at = lambda f, g: f(F.transform(seen, g))
    corners = F.struct(at(F.array_min, lambda r: r["x"]).alias("x0"), at(F.array_min, lambda r: r["y"]).alias("y0"), at(F.array_max, lambda r: r["x"] + r["n"] - 1).alias("x1"), at(F.array_max, lambda r: r["y"]).alias("y1"))
    return F.when(F.size(seen) > 0, corners)


def boxes(masks: DataFrame) -> DataFrame:
    """item_id, kind and the bounding box (x0, y0, x1, y1) of the pixels that reach their kind's threshold; faint items are dropped."""
    most = F.array_max(F.transform("runs", lambda r: r["alpha"]))
    out = masks.where(F.coalesce(most, F.lit(0)) >= FAINT).withColumn("_box", box(alpha_threshold(F.col("kind"))))
    return out.select("item_id", "kind", *[F.col("_box")[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def trimmed(masks: DataFrame) -> DataFrame:
    """masks cut to the pixels that reach their kind's threshold, the others transparent, with trim (x, y, width, height); a mask without such pixels stays as it is, with a null trim."""
    limit = alpha_threshold(F.col("kind"))
    b = F.col("_box")
    trim = F.when(b.isNotNull(), F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"] + 1).alias("width"), (b["y1"] - b["y0"] + 1).alias("height")))
    moved = F.transform(_shown(limit), lambda r: F.struct((r["y"] - b["y0"]).alias("y"), (r["x"] - b["x0"]).alias("x"), r["n"].alias("n"), r["alpha"].alias("alpha")))
    out = masks.withColumn("_box", box(limit)).withColumn("trim", trim)
    out = out.withColumn("runs", F.when(b.isNull(), F.col("runs")).otherwise(moved.cast(RUNS)))
    return out.withColumns({n: F.coalesce(F.col("trim")[n], F.col(n)) for n in ("width", "height")}).drop("_box")


def cut_out(pictures: DataFrame, masks: DataFrame) -> DataFrame:
    """pictures (item_id, width, height, runs) with the runs of their item's mask: what is transparent there is so here. Unequal sizes are an error; a picture without mask keeps its own."""
    m = masks.select("item_id", F.struct("width", "height", "runs").alias("_mask"))
    same = (F.col("_mask.width") == F.col("width")) & (F.col("_mask.height") == F.col("height"))
    told = F.concat(F.lit("sizes of a picture and its mask differ: "), F.col("item_id").cast("string"))
    runs = F.when(F.col("_mask").isNull(), F.col("runs")).when(same, F.col("_mask.runs")).otherwise(F.raise_error(told).cast(RUNS))
    return pictures.join(m, "item_id", "left").withColumn("runs", runs).drop("_mask")
