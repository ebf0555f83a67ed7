"""Binned frames for videos: means of pixel stacks, times and labels."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom import shared
from skyloom.functions import pixels, timefmt
from skyloom.operators.keogram import in_segments

KEYS = ["rec_id", "seg", "bin"]


def bins(frames: DataFrame, segments: DataFrame, bin_size: int | None = None, stride: int | None = None, closed: bool = True) -> DataFrame:
    """Frames with ``seg, bin``: ``bin_size`` each, or the first ``bin_size`` of each ``stride``. Where ``bin_size`` isn't
    given, the segments have both as columns."""
    if stride is not None and bin_size > stride:
        raise ValueError("a bin must not be larger than the stride")
    if bin_size is not None:
        segments = segments.withColumns({"bin_size": F.lit(bin_size), "stride": F.lit(stride or bin_size)})
    held = in_segments(frames, segments, closed)
    at = F.col("frame_idx") - F.col("s")
    return held.where(F.pmod(at, F.col("stride")) < F.col("bin_size")).withColumn("bin", F.floor(at / F.col("stride")))


def mean_frames(binned: DataFrame) -> DataFrame:
    """``rec_id, seg, bin, px array<double>``: the elementwise means of whole frames, summed as vectors before the shuffle."""
    vector = array_to_vector(F.col("px").cast("array<double>"))
    means = binned.select(*KEYS, vector.alias("v")).groupBy(*KEYS).agg(Summarizer.mean(F.col("v")).alias("mean"))
    return means.select(*KEYS, vector_to_array("mean").alias("px"))


def pixel_means(binned: DataFrame) -> DataFrame:
    """``rec_id, seg, bin, pos, px_mean``; only a bin's mean is exploded."""
    return mean_frames(binned).select(*KEYS, F.posexplode("px").alias("pos", "px_mean"))


def times(binned: DataFrame) -> DataFrame:
    """``rec_id, seg, bin, n_frames, t_mean, label``; reads no pixels."""
    found = binned.select(*KEYS, "ut").groupBy(*KEYS).agg(F.count("*").alias("n_frames"), F.avg("ut").alias("t_mean"))
    return found.withColumn("label", timefmt.label(F.col("t_mean")))


def gray_frames(frames: DataFrame, norms: DataFrame, kind: str = "log", keys: list[str] | None = None) -> DataFrame:
    """``rec_id, frame_idx`` (or other ``keys``) and ``gray array<int>``; a gray frame's three colours are equal."""
    level = F.transform("px", lambda v: pixels.gray(pixels.normalise(v.cast("double"), F.col("vmin"), F.col("vmax"), kind)))
    keys = keys or ["rec_id", "frame_idx"]
    return shared.met(frames, norms.select("rec_id", "vmin", "vmax"), ["rec_id"], keys[-1]).select(*keys, level.alias("gray"))


def rgb_frames(grays: DataFrame) -> DataFrame:
    """With ``rgb binary`` for ``gray``: three equal bytes a pixel, truncated from the colour map's 0 to 1, without alpha."""
    return grays.withColumn("rgb", pixels.as_bytes(pixels.rgb(F.col("gray")))).drop("gray")


def rgb_video(binned: DataFrame, norms: DataFrame, kind: str = "log") -> DataFrame:
    """``rec_id, seg, bin, n_frames, t_mean, label, rgb``: what a video's frames show."""
    return times(binned).join(rgb_frames(gray_frames(mean_frames(binned), norms, kind, KEYS)), KEYS)
