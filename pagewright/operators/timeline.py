"""Event timelines, before and after states, and state probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.elements import weighed

#: What a style may promise to change, for scores and for signals.
SCORED, SIGNALLED = "transform|opacity|filter", "transform|opacity|filter|clip-path|translate|scale|rotate"
#: The styles of a snapshot, and those of them that a change is told by.
SNAPSHOT = [
    "opacity", "transform", "filter", "clipPath", "visibility", "display", "position", "top", "left", "backgroundColor", "color", "willChange",
    "animationName", "animationDuration", "animationDelay", "animationTimingFunction", "animationIterationCount", "animationDirection",
    "animationFillMode", "animationPlayState", "transitionProperty", "transitionDuration", "transitionDelay", "transitionTimingFunction",
]
COMPARED = [
    "opacity", "transform", "filter", "clipPath", "visibility", "display", "backgroundColor", "color", "animationPlayState",
]


def first_events(events: DataFrame, by: str, order: list[str], most: int = 400) -> DataFrame:
    return events.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= most)


def with_after(before: DataFrame, after: DataFrame, keys: list[str], rank: str, fields: list[str]) -> DataFrame:
    """before with the fields of after, of whose rows with equal keys the one of highest rank counts; null where there is none."""
    last = after.groupBy(*keys).agg(F.max_by(F.struct(*fields), rank).alias("_after"))
    return before.join(last, keys, "left").withColumn("after", F.col("_after")).drop("_after")


def changes(exact: dict[str, tuple[Column, Column]], measured: dict[str, tuple[Column, Column]], present: Column) -> Column:
    """Names of the fields that differ, or by half a unit at least for measured ones; none where a side is missing."""
    found = [F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in exact.items()]
    found += [F.when(F.abs(F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))) >= 0.5, F.lit(n)) for n, (a, b) in measured.items()]
    return F.when(present, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def snapshot_changes(before: Column, after: Column) -> Column:
    """Array of (field, before, after): styles and class that differ, and bounds that differ by half a unit or more; empty where a side is missing.

    Both sides are structs of computed, bbox and attributes, as computed_snapshot, bbox_snapshot and relevant_attributes give them.
    """
    entry = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.cast("string").alias("before"), b.cast("string").alias("after"))
    found = []
    for k in COMPARED:
        a, b = before["computed"][k], after["computed"][k]
        found.append(F.when(~a.eqNullSafe(b), entry(f"computed.{k}", a, b)))
    for k in ("x", "y", "width", "height"):
        a, b = before["bbox"][k], after["bbox"][k]
        found.append(F.when(F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) >= 0.5, entry(f"bbox.{k}", a, b)))
    a, b = F.try_element_at(before["attributes"], F.lit("class")), F.try_element_at(after["attributes"], F.lit("class"))
    found.append(F.when(~a.eqNullSafe(b), entry("attributes.class", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    every = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(before.isNotNull() & after.isNotNull(), every).otherwise(F.slice(every, 1, 0))


def computed_snapshot(style: Column) -> Column:
    """The styles of a snapshot from a map of all styles; null for those that are missing."""
    return F.struct(*[F.try_element_at(style, F.lit(k)).alias(k) for k in SNAPSHOT])


def bbox_snapshot(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Bounds to two decimals, halves up."""
    return F.struct(*[(F.floor(c * 100 + F.lit(0.5)) / 100).alias(n) for n, c in (("x", x), ("y", y), ("width", width), ("height", height))])


def compact_keyframes(frames: Column) -> Column:
    """The first 12 of an array of maps, without null values, values cut at 240 characters."""
    return F.transform(F.slice(frames, 1, 12), lambda m: F.transform_values(F.map_filter(m, lambda k, v: v.isNotNull()), lambda k, v: F.substring(v, 1, 240)))


def compact_timing(timing: Column) -> Column:
    """Timing values as text; what is missing is 'null'."""
    return F.transform_values(timing, lambda k, v: F.coalesce(v, F.lit("null")))


def active_animations(animations: Column) -> Column:
    """Of an array of running animations (id, playState, currentTime, playbackRate, type, timing, keyframes) the compact form."""
    plain = ["playState", "currentTime", "playbackRate"]
    return F.transform(animations, lambda a: F.struct(F.coalesce(a["id"], F.lit("")).alias("id"), *[a[c].alias(c) for c in plain], F.coalesce(a["type"], F.lit("Animation")).alias("type"), compact_timing(a["timing"]).alias("timing"), compact_keyframes(a["keyframes"]).alias("keyframes")))


def with_active(elements: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """elements with active: whether an animation runs on them; targets: a row for each animation."""
    running = targets.select(*keys).distinct().withColumn("_running", F.lit(True))
    return elements.join(running, keys, "left").withColumn("active", F.coalesce("_running", F.lit(False))).drop("_running")


def animation_score() -> Column:
    """Needs active, animation, transition, duration, transform, opacity and will_change."""
    moving = F.rlike("will_change", F.lit(SCORED))
    return weighed([(F.col("active"), 100), (F.col("animation") != "none", 60), ((F.col("transition") != "none") & (F.col("duration") > 0), 35), (F.col("transform") != "none", 25), (F.col("opacity") != "1", 20), (moving, 12)])


def animation_signal() -> Column:
    """Needs filter and clip_path besides."""
    timed, other = F.col("duration") > 0, lambda c, usual: F.col(c) != usual
    hint = F.rlike("will_change", F.lit(SIGNALLED))
    return F.col("active") | (other("animation", "none") & timed) | (other("transition", "none") & timed) | other("transform", "none") | other("opacity", "1") | other("filter", "none") | other("clip_path", "none") | hint


def phase_totals(entries: DataFrame, most: int = 80) -> DataFrame:
    """Of each page and phase: elements before, after and changed; entries (page_id, phase, rank, after_id, changed)."""
    return entries.groupBy("page_id", "phase").agg(F.count("*").alias("before_count"), F.count("after_id").alias("after_count"), F.count_if("changed").alias("changed_count"), F.count_if(F.col("rank") <= most).alias("kept"))


def animation_summary(entries: DataFrame, events: DataFrame, most: int = 80) -> DataFrame:
    """Of each page the five measures over the first `most` entries of its phases: animated and changed selectors, running animations, elements with a transition, events."""
    kept = entries.where(F.col("rank") <= most).groupBy("page_id").agg(
        F.countDistinct("selector").alias("animated"), F.countDistinct(F.when(F.col("changed"), F.col("selector"))).alias("changed"),
        F.sum("running").alias("running"), F.count_if(F.col("transition") != "none").alias("transitions"),
    )
    heard = events.groupBy("page_id").agg(F.count("*").alias("events"))
    return kept.join(heard, "page_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def state_limit(value: int | None) -> int:
    """0 and none mean 5; otherwise between 0 and 20."""
    return min(20, max(0, value or 5))


def state_candidates(items: DataFrame, limit: int | None = None) -> DataFrame:
    """The 3 * limit best items (score, area, idx) of each page."""
    w = W.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("area").desc(), F.col("idx"))
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3 * state_limit(limit))


def novel_states(probes: DataFrame, by: str, rank: str, state: str, base: Column, usable: Column, limit: int | None = None) -> DataFrame:
    """Probes that show a state not seen before, in rank order, until limit of them are kept."""
    fresh = usable & (F.col(state) != base)
    first = F.row_number().over(W.partitionBy(by, state, fresh).orderBy(rank)) == 1
    p = probes.withColumn("_new", F.when(fresh & first, 1).otherwise(0))
    before = F.coalesce(F.sum("_new").over(W.partitionBy(by).orderBy(rank).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("_before", before).where((F.col("_new") == 1) & (F.col("_before") < state_limit(limit))).drop("_new", "_before")
