"""Keograms: time x position means of the centre row (``ew``) and centre column (``ns``).

Only slices are exploded, never whole frames; means are partial sums before the
shuffle. Where recordings are written once and read often, ``with_slices`` stores the
slices as columns, and ``sources.camera.frame_table`` reads them, so that a keogram doesn't read the pixels at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom import shared
from skyloom.functions import pixels


def with_slices(frames: DataFrame) -> DataFrame:
    """Columns ``ns, ew, px_sum, px_max`` beside the pixels."""
    px, h, w = F.col("px"), F.col("height"), F.col("width")
    return frames.withColumns({"ns": pixels.centre_column(px, h, w), "ew": pixels.centre_row(px, h, w), "px_sum": pixels.pixel_sum(px), "px_max": F.array_max(px)})


def _axis(frames: DataFrame, axis: str) -> Column:
    if axis in frames.columns:
        return F.col(axis)
    px, h, w = F.col("px"), F.col("height"), F.col("width")
    return pixels.centre_column(px, h, w) if axis == "ns" else pixels.centre_row(px, h, w)


def _means(binned: DataFrame, keys: list[str], axis: str) -> DataFrame:
    rows = binned.select(*keys, F.posexplode(_axis(binned, axis)).alias("pos", "v"))
    return rows.groupBy(*keys, "pos").agg((F.sum("v") / F.count("v")).alias("mean"))


def by_hour(frames: DataFrame, axis: str, width: float = 60.0, span: float = 3600.0) -> DataFrame:
    """``rec_id, hour, bin, pos, mean`` by clock hour; frames outside an hour's ``span`` are left out."""
    hour = F.floor(F.col("ut") / 3600) * F.lit(3600.0)
    binned = frames.withColumn("hour", hour).where((F.col("ut") >= F.col("hour")) & (F.col("ut") < F.col("hour") + span))
    return _means(binned.withColumn("bin", F.floor((F.col("ut") - F.col("hour")) / width)), ["rec_id", "hour", "bin"], axis)


def by_segment(frames: DataFrame, segments: DataFrame, axis: str, width: float = 60.0, span: float = 3600.0) -> DataFrame:
    """The same for segments (``rec_id, seg, s, e, us, ue, hour``; e excluded): frames outside the segment's hour are left out."""
    held = _in_hour(frames, segments, width, span)
    return _means(held, ["rec_id", "seg", "bin"], axis)


def both_axes(frames: DataFrame, segments: DataFrame, width: float = 60.0, span: float = 3600.0) -> DataFrame:
    """``rec_id, seg, bin, axis, pos, mean``: ``by_segment`` for ``ns`` and ``ew`` from one reading of the frames."""
    held = _in_hour(frames, segments, width, span)
    each = lambda axis: F.transform(_axis(held, axis), lambda v, i: F.struct(F.lit(axis).alias("axis"), i.alias("pos"), v.alias("v")))
    rows = held.select("rec_id", "seg", "bin", F.inline(F.concat(each("ns"), each("ew"))))
    return rows.groupBy("rec_id", "seg", "bin", "axis", "pos").agg((F.sum("v") / F.count("v")).alias("mean"))


def _in_hour(frames: DataFrame, segments: DataFrame, width: float, span: float) -> DataFrame:
    held = in_segments(frames, segments, closed=False).where((F.col("ut") >= F.col("hour")) & (F.col("ut") < F.col("hour") + span))
    return held.withColumn("bin", F.floor((F.col("ut") - F.col("hour")) / width))


def in_segments(frames: DataFrame, segments: DataFrame, closed: bool) -> DataFrame:
    """Frames with their segments' columns; a boundary frame is in both neighbours if ``closed``. Frames meet the few segments
    (``s, e`` and their times ``us, ue``) that touch their clock hour, where they are: the table of segments is broadcast up to a checked size."""
    own = [c for c in segments.columns if c != "rec_id"]
    hours = segments.withColumn("clock", F.explode(F.sequence(F.floor(F.col("us") / 3600), F.floor(F.col("ue") / 3600))))
    lists = hours.groupBy("rec_id", "clock").agg(F.collect_list(F.struct(*own)).alias("segments"))
    holds = lambda x: (x.s <= F.col("frame_idx")) & ((F.col("frame_idx") <= x.e) if closed else (F.col("frame_idx") < x.e))
    timed = frames.withColumn("clock", F.floor(F.col("ut") / 3600))
    return shared.met(timed, lists, ["rec_id", "clock"], "frame_idx").withColumn("segment", F.explode(F.filter("segments", holds))).drop("segments", "clock").select("*", "segment.*").drop("segment")


def gap_fill(means: DataFrame, n_bins: int, height: int) -> DataFrame:
    """Every bin and position of each hour: bins without frames are null (not zero)."""
    hours = means.select("rec_id", "hour").distinct()
    every = hours.select("rec_id", "hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    every = every.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return every.join(means, ["rec_id", "hour", "bin", "pos"], "left")


def by_count(frames: DataFrame, axis: str, per_bin: DataFrame) -> DataFrame:
    """``rec_id, bin, pos, mean`` of each ``frames_per_bin`` frames; the last bin is a mean of what it has."""
    binned = shared.met(frames, per_bin.select("rec_id", "frames_per_bin"), ["rec_id"], "frame_idx").withColumn("bin", F.floor(F.col("frame_idx") / F.col("frames_per_bin")))
    return _means(binned, ["rec_id", "bin"], axis)


def rough(frames: DataFrame, axis: str, sample_interval: int, per_bin: DataFrame) -> DataFrame:
    """The first ``frames_per_bin`` of each ``sample_interval`` frames, by recording; the last block is left out."""
    if per_bin.where(F.col("frames_per_bin") >= sample_interval).limit(1).count():
        raise ValueError("a bin must have fewer frames than the sample interval")
    n = frames.groupBy("rec_id").agg((F.ceil(F.count("*") / sample_interval) - 1).alias("blocks"))
    idx = F.col("frame_idx")
    limits = per_bin.select("rec_id", "frames_per_bin").join(n, "rec_id")
    heads = shared.met(frames, limits, ["rec_id"], "frame_idx").where((F.pmod(idx, F.lit(sample_interval)) < F.col("frames_per_bin")) & (F.floor(idx / sample_interval) < F.col("blocks")))
    return _means(heads.withColumn("bin", F.floor(idx / sample_interval)), ["rec_id", "bin"], axis)


def axis_ticks(ranges: DataFrame, step: float = 1 / 6) -> DataFrame:
    """``rec_id, seq, tick, label`` on an axis from ``a`` to ``b`` hours: the ends, and steps
    between that aren't within a fifth of a step of them. An axis over midnight has its ends only."""
    from skyloom.functions.timefmt import tick_label

    a, b = F.col("a"), F.col("b")
    first = F.ceil(a / step) * F.lit(step)
    count = F.ceil((b - first) / step).cast("long")
    steps = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))), lambda i: first + i * step)).otherwise(F.array().cast("array<double>"))
    n = F.size("steps")
    trimmed = F.filter(F.col("steps"), lambda x, i: ~(((i == 0) & (F.abs(x - a) < step / 5)) | ((i == n - 1) & (F.abs(b - x) < step / 5))))
    every = ranges.withColumn("steps", steps).select("rec_id", F.posexplode(F.concat(F.array(a), trimmed, F.array(b))).alias("seq", "tick"))
    return every.withColumn("label", tick_label(F.col("tick")))
