"""What the operators on vectors share: which rows count, whole numbers for components, sums that don't overflow.

A component x becomes floor(scale * x). Whole numbers beyond 2**62 are held at 2**62, and distances beyond the
largest long are given as that. Whatever could overflow a long is computed with Python's whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are held here; no long holds a distance to what is farther.
MOST = 1 << 62
LONG = (1 << 63) - 1
#: A sum goes to Spark as two parts, of which the lower has so many bits.
LOW = 31


def finite(column: str):
    """Whether a vector is there and all its components are."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column, size: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of `size` components, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python's whole numbers if a squared distance of such rows could pass a long."""
    v = np.floor(np.clip(x, -float(MOST), float(MOST)) * scale)
    if v.size and np.abs(v).max() > narrow(v.shape[-1]):
        return np.array([max(-MOST, min(MOST, int(a))) for a in v.ravel().tolist()], object).reshape(v.shape)
    return v.astype(np.int64)


def narrow(size: int) -> int:
    """Rows of `size` components up to this have squared distances, and their sums over all components, within a long."""
    return math.isqrt((1 << 60) // max(size, 1)) // 2


def alike(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as longs, or all of them with Python's whole numbers if one is."""
    return tuple(a.astype(object) for a in arrays) if any(a.dtype == object for a in arrays) else arrays


def held(distances) -> pa.Array:
    """Distances as longs."""
    return pa.array([min(int(d), LONG) for d in distances] if distances.dtype == object else distances, pa.int64())


def long_sum(column: str):
    """The sum of longs, held at the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")


SUMS = "cell int, place int, n long, high long, low long"


def sum_rows(n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS of cells that hold something; n: (cells), sums: (cells, places)."""
    at = np.flatnonzero(n)
    places = sums.shape[1]
    values = sums[at].ravel()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(at, places), pa.int32()),
            pa.array(np.tile(np.arange(places), len(at)), pa.int32()),
            pa.array(np.repeat(n[at], places), pa.int64()),
            pa.array((values >> LOW).tolist(), pa.int64()),
            pa.array((values & ((1 << LOW) - 1)).tolist(), pa.int64()),
        ],
        names=["cell", "place", "n", "high", "low"],
    )


def means(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    """before (cells, places) with each cell that rows of SUMS fill replaced by floor(sum / count). At most as many rows come as before has components."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = before.astype(object)
    for r in rows.groupBy("cell", "place").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).collect():
        out[r.cell, r.place] = ((int(r.high) << LOW) + int(r.low)) // r.n
    return out if out.size and np.abs(out).max() > narrow(out.shape[-1]) else out.astype(np.int64)
