"""Batches: the lines of a manifest, all recordings in one plan, and a status for each line.

A line that fails (bad cells, no file, unusable frames) gets its error and doesn't keep the others from running.
Statuses are appended to a log, so that nothing is lost and the next run takes up what isn't processed yet;
``status`` has the last word on each line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import shared
from skyloom.operators import manifest, norm
from skyloom.plans.pipelines import hourly
from skyloom.sources import camera

LINE = ["date", "start_time", "cam_ser"]
LOG = "date string, start_time string, cam_ser string, path string, processed boolean, error string, at timestamp"


def status(spark: SparkSession, folder: str) -> DataFrame:
    """``date, start_time, cam_ser, path, processed, error`` of each line that was ever run."""
    log = spark.read.schema(LOG).parquet(f"{folder}/log")
    last = log.groupBy(*LINE).agg(F.max_by(F.struct("path", "processed", "error"), "at").alias("last"))
    return last.select(*LINE, "last.*")


def _left(lines: DataFrame, folder: str) -> DataFrame:
    """Lines that no earlier run processed."""
    spark = lines.sparkSession
    spark.createDataFrame([], LOG).write.mode("append").parquet(f"{folder}/log")
    done = status(spark, folder).where("processed").alias("d")
    same = " and ".join(f"l.{c} <=> d.{c}" for c in LINE)
    return lines.alias("l").join(done, F.expr(same), "left_anti")


def run(sheet: DataFrame, listing: DataFrame, folder: str, suffix: str = ".parquet", output_hz: float | None = 1.0, **options) -> DataFrame:
    """Hourly results of the sheet's lines that aren't processed, below ``folder`` (``times``, ``pixels``, ``keograms``, ``norms``, each
    by run), and the status of all lines. A line's start counts for its limits only. Options go to ``hourly``."""
    spark = sheet.sparkSession
    lines = _left(manifest.pending(manifest.coerce(sheet)), folder)
    lines = manifest.locate(lines, listing, suffix).select(*LINE, "path", "error", manifest.start_of(F.col("day"), F.col("start_sec")).alias("start"))
    place = f"{folder}/runs/{uuid.uuid4().hex}"
    lines.write.parquet(f"{place}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{place}/lines")
    good = lines.where("error = ''")
    # one path for each line of the sheet at most
    paths = [r[0] for r in good.select("path").distinct().toLocalIterator()]
    outcome = good.select(*LINE, F.lit("no frames").alias("problem")).limit(0)
    if paths:
        files = shared.written(camera.footers(spark, *paths))
        footers = files.groupBy(F.col("place").alias("path")).agg(F.sum("n").alias("in_footers"), F.min("problem").alias("unread"))
        stored = camera.written_rows(spark, *paths).select(F.col("place").alias("path"), F.col("n").alias("stored"))
        unread = stored.join(footers, "path", "left").withColumn("n", F.coalesce("stored", "in_footers"))
        frames = camera.frame_table(spark, *paths, by_path=True)
        # a file may fail beyond its footer, in any column: what was read is held against what there is
        seen = frames.groupBy(F.col("rec_id").alias("path")).agg(F.least(*[F.count(c) for c in frames.columns]).alias("seen"))
        unread = unread.join(seen, "path", "left").select("path", F.coalesce("unread", F.when(F.coalesce("seen", F.lit(0)) < F.col("n"), F.format_string("only %d of %d frames can be read", F.coalesce("seen", F.lit(0)), "n"))).alias("unread"))
        unread = shared.written(unread.where("unread is not null"))
        frames = frames.join(F.broadcast(unread.select(F.col("path").alias("rec_id"))), "rec_id", "left_anti")
        bounds = good.select(F.to_json(F.struct(*LINE)).alias("line"), "path", "start")
        per_line = shared.met(frames, bounds.select("line", F.col("path").alias("rec_id")), ["rec_id"], "frame_idx").withColumn("rec_id", F.col("line")).drop("line")
        norms = norm.norm_between(per_line, 1.0, bounds.select(F.col("line").alias("rec_id"), "start", F.lit(None).cast("double").alias("stop")))
        norms.write.parquet(f"{place}/norms")
        found = hourly(frames, output_hz=output_hz, norms=norms, strict=False, **options)
        found.plan.write.parquet(f"{place}/plan")
        plan, norms = (spark.read.parquet(f"{place}/{name}") for name in ("plan", "norms"))
        lit = bounds.join(norms, bounds["line"] == norms["rec_id"]).select(F.col("path").alias("rec_id")).distinct()
        for name in ("times", "pixels", "keograms"):
            getattr(found, name).join(lit, "rec_id", "left_semi").write.parquet(f"{place}/{name}")
        dark = bounds.join(norms.select(F.col("rec_id").alias("line"), F.lit(True).alias("bright")), "line", "left")
        judged = dark.join(plan.select(F.col("rec_id").alias("path"), "dt", "problem"), "path", "left").join(unread, "path", "left")
        why = F.coalesce("unread", "problem", F.when(F.col("dt").isNull(), F.lit("no frames")).when(F.col("bright").isNull(), F.lit("no pixel above zero in the sampled frames")))
        outcome = judged.select(F.from_json("line", "date string, start_time string, cam_ser string").alias("line"), why.alias("problem")).select("line.*", "problem").where("problem is not null")
    said = lines.alias("l").join(outcome.alias("o"), F.expr(" and ".join(f"l.{c} <=> o.{c}" for c in LINE)), "left")
    error = F.when(F.col("error") != "", F.col("error")).otherwise(F.coalesce("problem", F.lit("")))
    log = said.select(*[F.col(f"l.{c}") for c in LINE], "path", (error == "").alias("processed"), error.alias("error"), F.current_timestamp().alias("at"))
    log.write.mode("append").parquet(f"{folder}/log")
    return status(spark, folder)
