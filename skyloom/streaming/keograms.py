"""Hour keograms of frames as they arrive, by Structured Streaming.

Means are kept as sums and counts in the state store, so that the order of arrival
doesn't matter. With a watermark, closed bins are emitted once (``append``); a bounded
input read to its end needs the last bins, too, and so takes ``complete``. Bins of so many frames each, whatever their
numbers, are in ``ordered``. What batches write, they write once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.keogram import _axis


def means(stream: DataFrame, axis: str, width: float = 60.0, late: str | None = None, span: float = 3600.0) -> DataFrame:
    """``rec_id, start, pos, mean``; frames later than ``late`` are left out if it's given, and frames beyond an hour's first ``span`` seconds."""
    hour = F.floor(F.col("ut") / 3600) * F.lit(3600.0)
    rows = stream.where((F.col("ut") >= hour) & (F.col("ut") < hour + span)).withColumn("ts", F.timestamp_seconds("ut"))
    if late:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", f"{width} seconds")
    found = rows.select("rec_id", window.alias("w"), F.posexplode(_axis(rows, axis)).alias("pos", "v"), *(["ts"] if late else []))
    return found.groupBy("rec_id", "w", "pos").agg((F.sum("v") / F.count("v")).alias("mean")).select("rec_id", (F.unix_micros("w.start") / F.lit(1e6)).alias("start"), "pos", "mean")


def count_means(stream: DataFrame, axis: str, per_bin: int) -> DataFrame:
    """``rec_id, bin, pos, mean`` of each ``per_bin`` frames by their number, whatever the order of arrival; the last bin is a mean of what it has."""
    rows = stream.select("rec_id", F.floor(F.col("frame_idx") / per_bin).alias("bin"), F.posexplode(_axis(stream, axis)).alias("pos", "v"))
    return rows.groupBy("rec_id", "bin", "pos").agg((F.sum("v") / F.count("v")).alias("mean"))


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each micro-batch: one that is run again, after a stop between its write and its commit, takes its own folder's place."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return write


def results(spark: SparkSession, out: str, schema, mode: str = "append") -> DataFrame:
    """What ``write_batch`` wrote: all batches, or of a ``complete`` table the last one."""
    rows = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*").withColumn("batch", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("long"))
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """All of the input there is, as one table. After a failure, the same call goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink or write_batch(out)).start().awaitTermination()
    return results(stream.sparkSession, out, stream.schema, mode)


def frame_stream(spark: SparkSession, glob: str, schema, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return shape(spark.readStream.schema(schema).parquet(glob))
