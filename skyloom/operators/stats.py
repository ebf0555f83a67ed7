"""Brightness and motion statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import pixels, timefmt
from skyloom.operators.timeaxis import differences


def frame_stats(frames: DataFrame) -> DataFrame:
    """``rec_id, frame_idx, px_max, px_sum, n_px, px_mean``: narrow rows, no shuffle."""
    px = F.col("px")
    found = frames.select("rec_id", "frame_idx", F.array_max(px).alias("px_max"), pixels.pixel_sum(px).alias("px_sum"), F.size(px).cast("long").alias("n_px"))
    return found.withColumn("px_mean", F.try_divide("px_sum", "n_px"))


def recording_stats(stats: DataFrame) -> DataFrame:
    """``frame_count, max_brightness, mean_brightness, brightness_std`` (population, of frame
    means) and ``motion`` (mean absolute difference of consecutive frame means; null for one frame)."""
    motion = differences(stats, "px_mean", "d").groupBy("rec_id").agg(F.avg(F.abs("d")).alias("motion"))
    found = stats.groupBy("rec_id").agg(
        F.count("*").alias("frame_count"), F.greatest(F.max("px_max"), F.lit(0)).cast("double").alias("max_brightness"),
        F.try_divide(F.sum("px_sum"), F.sum("n_px")).alias("mean_brightness"), F.stddev_pop("px_mean").alias("brightness_std"),
    )
    return found.join(motion, "rec_id", "left")


def mid_date(frames: DataFrame) -> DataFrame:
    """``rec_id, date``: the day of the frame in the middle."""
    n = frames.groupBy("rec_id").agg(F.floor(F.count("*") / 2).alias("frame_idx"))
    return frames.select("rec_id", "frame_idx", "ut").join(n, ["rec_id", "frame_idx"]).select("rec_id", timefmt.utc(F.col("ut"), "yyyy-MM-dd").alias("date"))
