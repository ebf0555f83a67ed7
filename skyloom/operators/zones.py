"""Nearest frames of a stored recording by a skip index.

A zone is a row group of a recording's files, which ``sources.sinks.write_recording`` sorts by time: its first and last time and frame, as
the files' footers have them. A key outside of all zones, or between two, needs no frame at all; one inside
a zone needs that zone's times only. So a lookup reads as many row groups as keys fall into, whatever the recording's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom import shared
from skyloom.operators import timeaxis
from skyloom.sources.camera import as_path
from skyloom.sources.raw import opened

ZONES = "rec_id string, path string, grp int, n long, first_idx long, last_idx long, first_t double, last_t double"
#: Keys of a zone that one task looks up; more are cut into pieces.
KEYS = 1_000_000
#: Where a recording keeps its zones; readers of its frames pass over it.
INDEX = "_zones"


@dataclass
class Lookup:
    """``found``: the keys with ``idx`` (and ``at``); ``opened``: the zones that were read."""

    found: DataFrame
    opened: DataFrame


def build(spark: SparkSession, path: str) -> DataFrame:
    """The zones of a recording table, from its files' footers, a file a row."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                store, at = opened(name)
                with store.open_input_file(at) as data:
                    meta = pq.ParquetFile(data).metadata
                    for i in range(meta.num_row_groups):
                        group = meta.row_group(i)
                        stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema in ("frame_idx", "ut")}
                        if group.num_rows:
                            rows.append((name, i, group.num_rows, stats["frame_idx"].min, stats["frame_idx"].max, stats["ut"].min, stats["ut"].max))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["path", "grp", "n", "first_idx", "last_idx", "first_t", "last_t"]).astype({"grp": np.int32}), preserve_index=False)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").load(path).select(as_path(F.col("path")).alias("path"))
    found = files.where(~F.col("path").contains(f"/{INDEX}/")).mapInArrow(footers, ZONES.replace("rec_id string, ", ""))
    name = F.call_function("url_decode", F.replace(F.regexp_extract("path", "/rec_id=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    return found.select(name.alias("rec_id"), *found.columns)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The zones that were written with a recording."""
    return spark.read.schema(ZONES).parquet(f"{path}/{INDEX}")


def time_range(zones: DataFrame) -> DataFrame:
    """``rec_id, n, start, stop`` as ``timeaxis.time_range``, from the zones alone."""
    return zones.groupBy("rec_id").agg(F.sum("n").alias("n"), F.min_by("first_t", "first_idx").alias("start"), F.max_by("last_t", "last_idx").alias("stop"))


def nearest(zones: DataFrame, keys: DataFrame, whole_seconds: bool = False, with_time: bool = False) -> Lookup:
    """``timeaxis.nearest`` for the frames that ``zones`` are of: keys meet the first zone that ends at or after them, and the one before."""
    others = [c for c in keys.columns if c not in ("rec_id", "key")]
    order = Window.partitionBy("rec_id").orderBy("first_idx")
    # a line for each row group of a recording, with the end of the one before
    lines = zones.withColumns({"zone": (F.row_number().over(order) - 1).cast("long"), "before": F.lag(F.struct(F.col("last_idx").alias("frame_idx"), F.col("last_t").alias("t"))).over(order)})
    lines = shared.written(lines)
    sought = keys.withColumn("t", F.floor("key").cast("double") if whole_seconds else F.col("key")).withColumn("_asked", F.monotonically_increasing_id())
    sought = shared.written(sought)
    ends = lines.select("rec_id", F.col("zone").alias("frame_idx"), F.col("last_t").alias("ut"))
    met = timeaxis.around(ends, sought.select("rec_id", F.col("t").alias("key"), "_asked"))
    met = met.select("_asked", F.col("r.frame_idx").alias("zone"), F.col("l.frame_idx").alias("left_zone"))
    placed = shared.written(sought.join(met, "_asked").withColumn("zone", F.coalesce("zone", "left_zone")).drop("left_zone"))
    zoned = placed.join(lines, ["rec_id", "zone"], "left")
    inside = (F.col("first_t") < F.col("t")) & (F.col("t") <= F.col("last_t"))
    here = shared.written(zoned.where(inside).select("_asked", "t", "path", "grp", "n"))
    often = here.groupBy("path", "grp").agg(F.count("*").alias("keys"), F.first("n").alias("n"))
    opened_zones = shared.written(often.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("keys") - 1) / KEYS)))))
    pieces = here.join(often.select("path", "grp", (F.floor((F.col("keys") - 1) / KEYS) + 1).alias("pieces")), ["path", "grp"]).withColumn("piece", F.pmod(F.xxhash64("_asked"), F.col("pieces")))

    def read(name: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        store, at = opened(name[0])
        with store.open_input_file(at) as data:
            group = pq.ParquetFile(data).read_row_group(int(name[1]), columns=["frame_idx", "ut"])
        idx, ut, t = group["frame_idx"].to_numpy(), group["ut"].to_numpy(), lot["t"].to_numpy()
        right = np.searchsorted(ut, t, side="left")  # within the zone: one frame is before t, and one at it or after
        one = np.where(np.abs(ut[right - 1] - t) <= np.abs(ut[right] - t), right - 1, right)
        return pd.DataFrame({"_asked": lot["_asked"], "idx": idx[one], "at": ut[one]})

    read_out = pieces.groupBy("path", "grp", "piece").applyInPandas(read, "_asked long, idx long, at double")
    left, right = F.col("before"), F.struct(F.col("first_idx").alias("frame_idx"), F.col("first_t").alias("t"))
    last = F.struct(F.col("last_idx").alias("frame_idx"), F.col("last_t").alias("t"))
    nearer = F.when(F.abs(F.col("before.t") - F.col("t")) <= F.abs(F.col("first_t") - F.col("t")), left).otherwise(right)
    one = F.when(F.col("last_t") < F.col("t"), last).when(F.col("before").isNull(), right).otherwise(nearer)
    between = zoned.where(F.coalesce(~inside, F.lit(True))).withColumn("one", one).select("_asked", F.coalesce("one.frame_idx", F.lit(0).cast("long")).alias("idx"), F.col("one.t").alias("at"))
    found = sought.join(read_out.unionByName(between), "_asked")
    return Lookup(found.select("rec_id", "key", *others, "idx", *(["at"] if with_time else [])), opened_zones)
