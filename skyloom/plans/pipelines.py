"""Whole jobs: raw files to recordings, videos between times, hourly videos with keograms, whole-file keograms.

Every job is one plan over all recordings of its frames, with limits and parameters for each. What comes to the driver
is one line with a problem, never frames.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import shared
from skyloom.functions import timefmt
from skyloom.functions.timefmt import assert_utc
from skyloom.operators import keogram, norm, timeaxis, video
from skyloom.sources import camera, raw, sinks


@dataclass
class Result:
    """``norms`` and ``plan`` (speed, frame rate, bin size, stride) by recording; ``times`` and ``pixels`` of the ``binned`` frames; ``keograms``."""

    norms: DataFrame
    plan: DataFrame | None = None
    times: DataFrame | None = None
    pixels: DataFrame | None = None
    keograms: DataFrame | None = None
    binned: DataFrame | None = None

    def video(self) -> DataFrame:
        """The video's frames in colour, for ``sources.sinks.write_video``."""
        return video.rgb_video(self.binned, self.norms)


def _bounds(frames: DataFrame, start: datetime | None, stop: datetime | None) -> DataFrame:
    """``rec_id, start, stop``, null where not given."""
    assert_utc(start, "start")
    assert_utc(stop, "stop")
    moment = lambda m: F.lit(None if m is None else m.timestamp()).cast("double")
    return frames.select("rec_id").distinct().select("rec_id", moment(start).alias("start"), moment(stop).alias("stop"))


def _segments(slim: DataFrame, bounds: DataFrame) -> DataFrame:
    given = bounds.select("rec_id", F.col("start").alias("from"), F.col("stop").alias("to"))
    ranges = timeaxis.time_range(slim).join(given, "rec_id", "left")
    return timeaxis.hour_segments(slim, ranges.select("rec_id", F.coalesce("from", "start").alias("start"), F.coalesce("to", "stop").alias("stop")))


def _require(plan: DataFrame) -> None:
    bad = plan.where(F.col("problem").isNotNull()).first()
    if bad:
        raise ValueError(f"{bad['rec_id']}: {bad['problem']}")


def videos(frames: DataFrame, start: datetime | None = None, stop: datetime | None = None, bin_size: int | None = None, speed: float | None = None, rate: float | None = None, norms: DataFrame | None = None) -> Result:
    """Binned frames of each hour; a frame on a boundary is in both hours. Exactly two of bin size, speed and frame rate are given."""
    bounds, slim = _bounds(frames, start, stop), frames.select("rec_id", "frame_idx", "ut")
    plan = timeaxis.parameters(timeaxis.native_dt(slim), speed, rate, bin_size).drop("problem").withColumn("stride", F.col("bin_size"))
    norms = norm.norm_between(frames, 1.0, bounds, 0.1, 99.9) if norms is None else norms
    plan = shared.written(plan)
    binned = video.bins(frames, shared.written(_segments(slim, bounds).join(plan.select("rec_id", "bin_size", "stride"), "rec_id")))
    return Result(norms, plan, video.times(binned), video.pixel_means(binned), binned=binned)


def hourly(
    frames: DataFrame, start: datetime | None = None, stop: datetime | None = None, bin_size: int | None = 5, speed: float | None = 15.0, rate: float | None = None, output_hz: float | None = None,
    bin_seconds: float = 1.0, lookahead: int = 500, norms: DataFrame | None = None, strict: bool = True,
) -> Result:
    """Binned frames and keograms of each hour, a boundary frame in the later one only. Recordings whose bins
    would be larger than their stride fail the job, or, unless ``strict``, are left out."""
    bounds, slim = _bounds(frames, start, stop), frames.select("rec_id", "frame_idx", "ut")
    plan = shared.written(timeaxis.parameters(timeaxis.native_dt(slim), speed, rate, bin_size, output_hz))
    if strict:
        _require(plan)
    norms = norm.norm_between(frames, 1.0, bounds, 0.1, 99.9) if norms is None else norms
    sound = plan.where(F.col("problem").isNull()).select("rec_id", "bin_size", "stride")
    # segments and plan are solved once; what follows reads the frames only
    segments = shared.written(timeaxis.clock_hours(slim, _segments(slim, bounds), lookahead).join(sound, "rec_id"))
    binned = video.bins(frames, segments.drop("hour"), closed=False)
    return Result(norms, plan, video.times(binned), video.pixel_means(binned), keogram.both_axes(frames, segments.drop("bin_size", "stride"), bin_seconds), binned)


def whole_keogram(frames: DataFrame, axis: str, bin_seconds: float | None = None, norms: DataFrame | None = None) -> Result:
    """The keogram of all frames in bins of about ``bin_seconds`` (by default of a frame), and limits sampled each second."""
    per = timeaxis.count_bins(timeaxis.time_range(frames.select("rec_id", "frame_idx", "ut")), bin_seconds)
    return Result(norm.norm(frames, 1.0) if norms is None else norms, keograms=keogram.by_count(frames, axis, per))


def rough_keogram(frames: DataFrame, axis: str, bin_seconds: float, sample_interval: int) -> Result:
    """The keogram of the first frames of each ``sample_interval``, and limits sampled each 60 s."""
    per = timeaxis.count_bins(timeaxis.time_range(frames.select("rec_id", "frame_idx", "ut")), bin_seconds)
    return Result(norm.norm(frames, 60.0), keograms=keogram.rough(frames, axis, sample_interval, per))


def raw_to_recording(spark: SparkSession, folder: str, out: str, user: dict | None = None, override: dict | None = None, suffix: str = raw.SUFFIX, split_bytes: int | None = None) -> DataFrame:
    """Raw files below ``folder``, however deep and large, with their companions, as one recording table ``out``, by recording. Files without
    companions, two files of one name and recordings that are there already fail it before anything is written. Returns what was written (``raw_ranges``)."""
    files = camera.listing(spark, folder, "*")
    camera.require_companions(files, suffix)
    stems = files.where(F.col("path").endswith(suffix)).groupBy(timefmt.stem(F.col("path")).alias("rec_id")).agg(F.count("*").alias("n"))
    if twice := stems.where("n > 1").first():
        raise ValueError(f"{twice['n']} raw files are named {twice['rec_id']}")
    sinks.write_recording(raw.frames(spark, folder, user=user, override=override, suffix=suffix, split_bytes=split_bytes).drop("path"), out)
    return camera.raw_ranges(spark.read.parquet(out))
