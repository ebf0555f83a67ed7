"""Readers: raw camera files with their companions, frame tables, acquisition logs, manifests, listings."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom import schema
from skyloom.functions import timefmt
from skyloom.operators.keogram import with_slices
from skyloom.sources import raw

COMPANIONS = (".xml", ".nmea")


def listing(spark: SparkSession, folder: str, suffix: str = ".h5", prune: list[str] | None = None) -> DataFrame:
    """``path`` of files below a folder, whatever the store; contents aren't read."""
    from skyloom.operators.manifest import prune as without

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select(as_path(F.col("path")).alias("path"))
    return without(found, prune or [])


def as_path(path: Column) -> Column:
    """Local paths begin in one way, whichever reader names them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the recording tables below ``.../HDF/<day>/<camera>/``: folders ``<stem>.parquet``, as ``sinks.write_recording`` makes them."""
    table = F.regexp_extract("path", r"^(.*/HDF/\d{4}-\d\d-\d\d/[^/]+/[^/]+\.parquet)/", 1)
    return listing(spark, folder, ".parquet").select(table.alias("path")).where("path <> ''").distinct()


def single(paths: DataFrame) -> str:
    """The one path of a folder's listing."""
    found = [r[0] for r in paths.limit(2).collect()]
    if not found:
        raise FileNotFoundError("no file matches")
    if len(found) > 1:
        raise ValueError("more than one file matches")
    return found[0]


def volume(names: DataFrame, key: str) -> str:
    """The one ``name`` that holds ``key``, whatever the case."""
    return single(names.where(F.lower("name").contains(key.lower())).select("name"))


def frame_table(spark: SparkSession, *paths: str, by_path: bool = False) -> DataFrame:
    """Recording tables; pixels are read only where they're used, and slices where they were stored: of tables without them they're computed, if others
    have them. With ``by_path`` a table is one recording, named by its path, and files that can't be read are left out; ``footers`` says what a table should have."""
    if len(paths) == 1 and not by_path:
        stored = spark.read.parquet(paths[0]).columns
        kinds = StructType([*schema.FRAME.fields, *[f for f in schema.SLICES.fields if f.name in stored]])
        return spark.read.schema(kinds).parquet(*paths)
    known = {as_local(p): p for p in paths}
    sliced = {known[r["place"]] for r in footers(spark, *paths).groupBy("place").agg(F.min("sliced").alias("all")).where(F.col("all")).toLocalIterator() if r["place"] in known}
    parts = []
    for own, slices in ((sliced, True), (set(paths) - sliced, False)):
        if own:
            fields = [*[f for f in schema.FRAME.fields if f.name != "rec_id" or not by_path], *(schema.SLICES.fields if slices else [])]
            reader = spark.read.schema(StructType(fields))
            if by_path:
                rows = reader.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").parquet(*sorted(own)).withColumn("rec_id", table_of(F.col("_metadata.file_path")))
            else:
                rows = functools.reduce(DataFrame.unionByName, [reader.parquet(p) for p in sorted(own)])
            parts.append(rows if slices or not sliced else with_slices(rows))
    return functools.reduce(DataFrame.unionByName, parts)


def as_local(path: str) -> str:
    return re.sub("^(file:)?/+", "file:/", path).rstrip("/") if re.match("(file:)?/", path) else path.rstrip("/")


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """``place, file, n, sliced, problem`` of the tables' files, from their footers, a file a row: the table's path, its rows, whether it has slices, and why it can't be
    read. Spark passes over files of no bytes: ``written_rows`` knows of theirs."""
    places = [as_local(p) for p in paths]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                n, sliced, problem = None, None, None
                try:
                    store, at = raw.opened(file)
                    with store.open_input_file(at) as data:
                        meta = pq.ParquetFile(data)
                        n, sliced = meta.metadata.num_rows, set(schema.SLICES.names) <= set(meta.schema_arrow.names)
                except Exception as e:  # noqa: BLE001  what is wrong with a file is its problem, not the job's
                    problem = f"{file.rsplit('/', 1)[-1]} can't be read: {type(e).__name__}"
                rows.append((next((p for p in places if file.startswith(f"{p}/")), None), file, n, sliced, problem))
            kinds = {"place": pa.string(), "file": pa.string(), "n": pa.int64(), "sliced": pa.bool_(), "problem": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select(as_path(F.col("path")).alias("file"))
    return files.mapInArrow(read, "place string, file string, n long, sliced boolean, problem string")


def written_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """``place, n`` of the tables: the rows that were written, as their zones (``operators.zones``) say; null where there are none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for place in batch.column(0).to_pylist():
                store, at = raw.opened(f"{place}/_zones")
                try:
                    held = [x.path for x in store.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet")]
                    found.append(sum(pc.sum(pq.ParquetFile(store.open_input_file(x)).read(columns=["n"])["n"]).as_py() or 0 for x in held))
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["place", "n"])

    return spark.createDataFrame([(as_local(p),) for p in paths], "place string").repartition(min(len(paths), 200)).mapInArrow(read, "place string, n long")


def table_of(path: Column) -> Column:
    """The recording table that a file is in, as ``recordings`` names it."""
    return F.regexp_extract(as_path(path), r"^(.*?\.parquet)/", 1)


def missing_companions(files: DataFrame, suffix: str = ".DMCdata") -> DataFrame:
    """``path, missing``: raw files without their metadata or position file."""
    lone = files.where(F.col("path").endswith(suffix)).select("path", F.explode(F.array(*[F.lit(c) for c in COMPANIONS])).alias("missing"))
    wanted = lone.withColumn("want", F.concat(F.expr(f"substring(path, 1, length(path) - {len(suffix)})"), "missing"))
    return wanted.join(files.select(F.col("path").alias("want")), "want", "left_anti").select("path", "missing")


def require_companions(files: DataFrame, suffix: str = ".DMCdata") -> None:
    if bad := missing_companions(files, suffix).first():
        raise FileNotFoundError(f"{bad['path']} has no {bad['missing']} file")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of whole text files."""
    return spark.read.option("wholetext", "true").text(path).select(as_path(F.col("_metadata.file_path")).alias("path"), "value")


def xml_params(files: DataFrame) -> DataFrame:
    """``path, horiz_pixels, vert_pixels, binning, kinetic_sec`` of camera metadata (``path, value``)."""
    number = lambda tag: F.regexp_extract("value", rf"<{tag}[^>]*>\s*([-+.\deE]+)\s*</{tag}>", 1).try_cast("double")
    return files.select("path", *[number(tag).cast(kind).alias(name) for tag, name, kind in (("horizpixels", "horiz_pixels", "int"), ("vertpixels", "vert_pixels", "int"), ("binning", "binning", "int"), ("kineticrate", "kinetic_sec", "double"))])


def nmea_start(files: DataFrame) -> DataFrame:
    """``path, start_utc``: the time of the first valid GPRMC sentence of a text (``path, value``), in Unix seconds."""
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    part = F.split("line", ",")
    sentences = lines.where(F.col("line").rlike(r"^\$GPRMC,\d{6}") & (F.get(part, F.lit(2)) == "A"))
    moment = F.try_to_timestamp(F.concat(F.get(part, F.lit(9)), F.substring(F.get(part, F.lit(1)), 1, 6), F.lit("+0000")), F.lit("ddMMyyHHmmssZ"))
    return sentences.groupBy("path").agg(F.min_by(F.unix_micros(moment) / F.lit(1e6), "pos").alias("start_utc"))


def with_params(files: DataFrame, xml: DataFrame, nmea: DataFrame, user: dict | None = None, override: dict | None = None) -> DataFrame:
    """Raw files (``path, content``) with the columns of ``schema.CAMERA``: what the companions of the same stem say
    (``xml_params``, ``nmea_start``) goes over ``user`` and ``schema.CAMERA_DEFAULTS``, and ``override`` over all.
    Files without what has no default have nulls."""
    stem = timefmt.with_suffix(F.col("path"), "")
    said = files.withColumn("stem", stem).join(xml.withColumn("stem", stem).drop("path"), "stem", "left").join(nmea.withColumn("stem", stem).drop("path"), "stem", "left")
    given, kinds = {**schema.CAMERA_DEFAULTS, **(user or {})}, {f.name: f.dataType for f in schema.CAMERA}
    value = lambda c: F.coalesce(F.lit((override or {}).get(c)).cast(kinds[c]), *([F.col(c)] if c in said.columns else []), F.lit(given.get(c)).cast(kinds[c]))
    return said.select("path", "content", *[value(c).alias(c) for c in kinds])


def raw_frames(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """``rec_id, frame_idx, raw_idx, ut, height, width, px`` of raw files in rows (``path, content`` and the columns of
    ``schema.CAMERA``): each frame's pixels (unsigned, 16 bits, little end first) binned as the camera did, then its header bytes. A header of four
    bytes or more holds the frame's raw number (two 16-bit words, the high one first), from which frames may be missing; without one, numbers
    count from 1. Raw frame 1 is at ``start_utc``. Frames are transposed, then turned counter-clockwise
    by ``rot_ccw`` degrees (whole quarters), flipped up-down, and flipped left-right, as far as asked for. A last frame that isn't whole is left out.
    Files without a parameter that has no default fail with their name.

    A file is a row here, for files that some other source has loaded; ``sources.raw.frames`` reads stored ones by ranges.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                params = raw.with_defaults(row["path"], {}, {}, {c: row[c] for c in schema.CAMERA.names})
                size = raw.frame_shape(params)[2]
                data = np.frombuffer(row["content"] or b"", np.uint8)
                frames = data[: len(data) // size * size].reshape(-1, size)
                step = max(1, batch_bytes // size)
                for s in range(0, len(frames), step):
                    yield raw.batch_of("", row["path"], frames[s : s + step], s, params)

    found = files.select("path", "content", *schema.CAMERA.names).mapInArrow(decode, raw.COLUMNS)
    return found.select(timefmt.stem(F.col("path")).alias("rec_id"), *[c for c in found.columns if c not in ("path", "rec_id")])


def raw_ranges(frames: DataFrame) -> DataFrame:
    """``rec_id, first_raw, last_raw, n``: the raw numbers that recordings cover, without reading pixels."""
    return frames.groupBy("rec_id").agg(F.min("raw_idx").alias("first_raw"), F.max("raw_idx").alias("last_raw"), F.count("*").alias("n"))


def log_start(lines: DataFrame) -> DataFrame:
    """``path, start, problem`` for log lines (``path, pos, line``): the time at the
    start of the first line that says that acquisition started (at most six digits of a second)."""
    said = F.col("line").contains("Acquisition started")
    first = lines.groupBy("path").agg(F.min_by(F.when(said, F.col("line")), F.when(said, F.col("pos"))).alias("line"))
    stamp = F.regexp_extract(F.coalesce("line", F.lit("")), r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+)", 1)
    start = F.when(F.length(stamp) <= 26, F.regexp_replace(stamp, "T", " ").try_cast("timestamp_ntz"))
    problem = F.when(F.col("line").isNull(), F.lit("no start line")).when(stamp == "", F.lit("no time")).when(start.isNull(), F.lit("bad time"))
    return first.select("path", start.alias("start"), problem.alias("problem"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV; all cells are text until they're coerced."""
    return spark.read.option("header", "true").schema(schema.MANIFEST).option("enforceSchema", "false").csv(path)
