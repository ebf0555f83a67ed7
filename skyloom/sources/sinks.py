"""Sinks: recording tables, names of results, and gray PNG files of small matrices."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import pixels, timefmt
from skyloom.operators.keogram import with_slices


def write_recording(frames: DataFrame, path: str, slices: bool = True, group_bytes: int | None = None) -> None:
    """A new recording table, by recording and in the order of time, so that time
    ranges skip row groups (of ``group_bytes``, if given), and its zones (``operators.zones``). An existing one isn't overwritten."""
    from skyloom.operators import zones

    rows = with_slices(frames.withColumn("px", pixels.checked(F.col("px")))) if slices else frames
    order = ["rec_id", "ut", "frame_idx"]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("rec_id")
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    spark = frames.sparkSession
    zones.build(spark, path).write.parquet(f"{path}/{zones.INDEX}")


def write_video(frames: DataFrame, path: str) -> None:
    """A new table of a video's frames (``operators.video.rgb_video``), by recording and segment, each in its order."""
    frames.repartition("rec_id", "seg").sortWithinPartitions("rec_id", "seg", "bin").write.mode("errorifexists").partitionBy("rec_id", "seg").parquet(path)


def video_name(stem, start, stop) -> F.Column:
    """``<stem>_<HH-MM-SS>_<HH-MM-SS>.mp4`` of a segment's times."""
    return F.concat(F.concat_ws("_", stem, timefmt.utc(start, "HH-mm-ss"), timefmt.utc(stop, "HH-mm-ss")), F.lit(".mp4"))


def hourly_name(path, ut, ordinal, suffix: str) -> F.Column:
    """``<CamSer>_<yyyymmdd>_<segment>`` and a suffix."""
    return F.concat(F.concat_ws("_", timefmt.camera_of(path), timefmt.utc(ut, "yyyyMMdd"), ordinal.cast("string")), F.lit(suffix))


def png(rows: list[bytes]) -> bytes:
    """A gray 8-bit PNG of rows of equal length."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")
