"""Geometry of crops, radii, pixels, scroll positions and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X


def crop_rects(items: DataFrame, width: int, height: int) -> DataFrame:
    """Bounds clamped to the image (left, top, crop_width, crop_height); empty crops are dropped."""
    left, top = F.greatest(F.lit(0), F.floor("x")), F.greatest(F.lit(0), F.floor("y"))
    right, bottom = F.least(F.lit(width), F.ceil(F.col("x") + F.col("width"))), F.least(F.lit(height), F.ceil(F.col("y") + F.col("height")))
    out = items.withColumns({"left": left, "top": top, "crop_width": right - left, "crop_height": bottom - top})
    return out.where((F.col("crop_width") >= 1) & (F.col("crop_height") >= 1))


def alpha_threshold(kind: Column) -> Column:
    return F.when(kind.isin("button", "badge"), 56).otherwise(18)


def crop_padding(kind: Column) -> Column:
    """Pixels around an item's bounds: none for every kind."""
    return F.when(kind.isNotNull(), 0).otherwise(0)


def edge_insets(kind: Column) -> Column:
    """Pixels that are cut from an image's edges: the top row of buttons and badges."""
    return F.struct(F.when(kind.isin("button", "badge"), 1).otherwise(0).alias("top"), *[F.lit(0).alias(n) for n in ("right", "bottom", "left")])


def output_bounds(left: Column, top: Column, width: Column, height: Column, trim: Column, insets: Column) -> Column:
    """Where an item's image lies on the page after a trim (x, y, width, height; null for none) and edge insets.

    Insets are cut only if something is left.
    """
    w, h = F.coalesce(trim["width"], width), F.coalesce(trim["height"], height)
    inner_w, inner_h = w - insets["left"] - insets["right"], h - insets["top"] - insets["bottom"]
    cut = (inner_w > 0) & (inner_h > 0)
    by = lambda n: F.when(cut, insets[n]).otherwise(0)
    x, y = left + F.coalesce(trim["x"], F.lit(0)) + by("left"), top + F.coalesce(trim["y"], F.lit(0)) + by("top")
    return F.struct(x.alias("x"), y.alias("y"), F.when(cut, inner_w).otherwise(w).alias("width"), F.when(cut, inner_h).otherwise(h).alias("height"))


def rounded_mask(width: Column, height: Column, radii: Column, scale: int = 4) -> Column:
    """The outline of a box with rounded corners as an SVG path, `scale` times as large; null without round corners. Radii are held to half the box."""
    w, h, radii = width * scale, height * scale, X.clamped_radii(radii, width, height)
    r = {n: (radii[n]["x"] * scale, radii[n]["y"] * scale) for n in ("topLeft", "topRight", "bottomRight", "bottomLeft")}
    part = lambda letter, *v: F.concat_ws(" ", F.lit(letter), *[(x if isinstance(x, Column) else F.lit(x)).cast("long").cast("string") for x in v])
    arc = lambda n, x, y: part("A", r[n][0], r[n][1], 0, 0, 1, x, y)
    path = F.concat_ws(
        " ", part("M", r["topLeft"][0], 0), part("L", w - r["topRight"][0], 0), arc("topRight", w, r["topRight"][1]),
        part("L", w, h - r["bottomRight"][1]), arc("bottomRight", w - r["bottomRight"][0], h), part("L", r["bottomLeft"][0], h),
        arc("bottomLeft", 0, h - r["bottomLeft"][1]), part("L", 0, r["topLeft"][1]), arc("topLeft", r["topLeft"][0], 0), F.lit("Z"),
    )
    flat = [c for n in r for c in r[n]]
    return F.when(F.greatest(*flat) > 0, path)


def alpha_boxes(pixels: DataFrame) -> DataFrame:
    """Bounding box of the pixels (item_id, kind, x, y, alpha) that reach their kind's threshold; faint items are dropped."""
    seen = F.col("alpha") >= alpha_threshold(F.col("kind"))
    at = lambda f, c: f(F.when(seen, F.col(c)))
    out = pixels.groupBy("item_id", "kind").agg(F.max("alpha").alias("most"), at(F.min, "x").alias("x0"), at(F.min, "y").alias("y0"), at(F.max, "x").alias("x1"), at(F.max, "y").alias("y1"))
    return out.where("most >= 32")


def scroll_phases(most: Column, height: int) -> Column:
    """Distinct positions 0, three quarters of the view, half the way, the end; in that order."""
    return F.array_distinct(F.array(F.lit(0).cast("long"), F.least(most, F.floor(F.lit(height * 0.75 + 0.5))), F.least(most, F.floor(most * 0.5 + 0.5)), most))


def prime_positions(most: Column, height: int) -> Column:
    step = max(200, height // 4)
    return _steps(most, step)


def tile_positions(most: Column, height: int) -> Column:
    return _steps(most, height)


def _steps(most: Column, step: int) -> Column:
    inner = F.filter(F.sequence(F.lit(0).cast("long"), most, F.lit(step).cast("long")), lambda y: (y == 0) | (y < most))
    return F.when(most > 0, F.concat(inner, F.array(most))).otherwise(inner)


def frames(pages: DataFrame, phases: Column, first: int = 11, later: int = 7, step_ms: int = 180) -> DataFrame:
    """phase, frame within it, elapsed_ms and frame_id, counted through all phases of a page."""
    p = pages.select("page_id", F.posexplode(phases).alias("phase", "position"))
    f = p.select("page_id", (F.col("phase") + 1).alias("phase"), "position", F.explode(F.expr(f"sequence(0, CASE WHEN phase = 0 THEN {first} ELSE {later} END - 1)")).alias("frame"))
    n = F.row_number().over(W.partitionBy("page_id").orderBy("phase", "frame"))
    return f.withColumn("elapsed_ms", F.col("frame") * step_ms).withColumn("frame_id", F.format_string("frame-%03d", n))
