"""Manifests: cells as typed values, what is left to do, which file belongs to a line, and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import timefmt


def with_status(sheet: DataFrame) -> DataFrame:
    """``processed`` and ``error`` exist, without nulls."""
    for c in ("processed", "error"):
        if c not in sheet.columns:
            sheet = sheet.withColumn(c, F.lit(None).cast("string"))
    return sheet.withColumn("processed", timefmt.truthy(F.col("processed").cast("string"))).withColumn("error", F.coalesce("error", F.lit("")))


def coerce(sheet: DataFrame) -> DataFrame:
    """With ``day date``, ``start_sec int``, ``cam string`` and in ``error`` which cell is bad; errors of earlier runs are forgotten."""
    typed = with_status(sheet).withColumns({"day": timefmt.to_date(F.col("date")), "start_sec": timefmt.to_seconds(F.col("start_time")), "cam": timefmt.cam_ser(F.col("cam_ser"))})
    bad = F.when(F.col("day").isNull(), F.lit("bad date")).when(F.col("start_sec").isNull() & ~timefmt.is_blank(F.col("start_time")), F.lit("bad time"))
    return typed.withColumn("error", F.coalesce(bad, F.lit("")))


def start_of(day, seconds) -> F.Column:
    """Unix seconds of a day and a second of it; null where no time was given."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) * F.lit(86400.0) + seconds


def pending(sheet: DataFrame) -> DataFrame:
    return sheet.where(~F.col("processed"))


def files_by_folder(listing: DataFrame, suffix: str = ".h5") -> DataFrame:
    """``day, cam, path, n_files`` of each folder ``.../HDF/<day>/<cam>/``; path is null unless there is one."""
    part = lambda i: F.regexp_extract("path", r"/HDF/(\d{4}-\d\d-\d\d)/([^/]+)/[^/]+$", i)
    found = listing.where(F.col("path").endswith(suffix)).select(part(1).alias("folder"), part(2).alias("cam"), "path").where("folder <> ''")
    return found.groupBy(F.col("folder").try_cast("date").alias("day"), "cam").agg(F.count("*").alias("n_files"), F.min("path").alias("path")).withColumn("path", F.when(F.col("n_files") == 1, F.col("path")))


def locate(lines: DataFrame, listing: DataFrame, suffix: str = ".h5") -> DataFrame:
    """Lines with their file's ``path``; no file, or several, is an error of the line."""
    found = lines.join(files_by_folder(listing, suffix), ["day", "cam"], "left")
    missing = F.when(F.coalesce("n_files", F.lit(0)) == 0, F.lit("no file")).when(F.col("n_files") > 1, F.lit("several files"))
    return found.withColumn("error", F.when(F.col("error") != "", F.col("error")).otherwise(F.coalesce(missing, F.lit("")))).drop("n_files")


def prune(listing: DataFrame, folders: list[str]) -> DataFrame:
    """Paths with none of ``folders`` among their parents, at any depth."""
    parents = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return listing.where(~F.arrays_overlap(parents, F.array(*[F.lit(f) for f in folders]))) if folders else listing


def undone(recordings: DataFrame, results: DataFrame, suffix: str = ".png") -> DataFrame:
    """Recordings without a result of their stem."""
    done = results.where(F.col("path").endswith(suffix)).select(timefmt.stem(F.col("path")).alias("stem")).distinct()
    return recordings.withColumn("stem", timefmt.stem(F.col("path"))).join(done, "stem", "left_anti")
