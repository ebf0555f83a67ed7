"""Schemas, and the views over the driver's tables that stand in for recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

FRAME = StructType([StructField("rec_id", StringType()), StructField("frame_idx", LongType()), StructField("ut", DoubleType()), StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("px", ArrayType(IntegerType()))])
CAMERA = StructType([
    StructField("header_bytes", IntegerType()), StructField("horiz_pixels", IntegerType()), StructField("vert_pixels", IntegerType()), StructField("binning", IntegerType()),
    StructField("kinetic_sec", DoubleType()), StructField("start_utc", DoubleType()), StructField("rot_ccw", IntegerType()), StructField("transpose", BooleanType()), StructField("flip_ud", BooleanType()), StructField("flip_lr", BooleanType()),
])
CAMERA_DEFAULTS = {"header_bytes": 4, "binning": 1, "rot_ccw": 0, "transpose": False, "flip_ud": False, "flip_lr": False}
#: Columns that ``operators.keogram.with_slices`` adds to frames.
SLICES = StructType([StructField("ns", ArrayType(IntegerType())), StructField("ew", ArrayType(IntegerType())), StructField("px_sum", LongType()), StructField("px_max", IntegerType())])
MANIFEST = StructType([StructField(c, StringType()) for c in ("date", "start_time", "cam_ser", "processed", "error")])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_frames(embeddings: DataFrame) -> DataFrame:
    """64 floats are an 8 x 8 frame of positive integers; one frame each 7.5 s."""
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 1000).cast("int"))
    return embeddings.select(F.lit("sky").alias("rec_id"), F.col("vec_id").cast("long").alias("frame_idx"), (F.lit(1704067200.0) + F.col("vec_id") * F.lit(7.5)).alias("ut"), F.lit(8).alias("height"), F.lit(8).alias("width"), px.alias("px"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_frames(read(spark, sf_dir, "embeddings"))


def epoch(ts) -> F.Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular time axis for each event type: ``rec_id, frame_idx, ut, bright``."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("rec_id"), "event_id", epoch("ts").alias("ut"), F.floor(F.col("value") * 100).cast("int").alias("bright"))
    # numbers within a day, and the frames of the days before: a day is a task, not a recording
    events = events.withColumn("day", F.floor(F.col("ut") / 86400))
    days = events.groupBy("rec_id", "day").agg(F.count("*").alias("n"))
    before = days.select("rec_id", "day", (F.sum("n").over(Window.partitionBy("rec_id").orderBy("day")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("rec_id", "day").orderBy("ut", "event_id")) - 1
    numbered = events.withColumn("inside", inside).join(before, ["rec_id", "day"])
    return numbered.select("rec_id", "ut", "bright", (F.col("inside") + F.col("before")).cast("long").alias("frame_idx"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet as people type it, derived from ``events``: padded, blank and bad cells."""
    n, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    return read(spark, sf_dir, "events").select(
        n.alias("line"),
        F.when(n % 11 == 0, F.lit("n/a")).when(n % 5 == 0, F.concat(F.lit(" "), day, F.lit(" "))).otherwise(day).alias("date"),
        F.when(n % 7 == 0, F.lit("")).when(n % 13 == 0, F.lit("noon")).otherwise(F.date_format("ts", "HH:mm:ss")).alias("start_time"),
        F.when(n % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("cam_ser"),
        F.when(n % 4 == 0, F.lit("TRUE")).when(n % 4 == 1, F.lit("")).alias("processed"), F.lit(None).cast("string").alias("error"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of recordings, derived from ``events``: most folders hold one file, some none or several."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, sf_dir, "events").where("event_id % 6 <> 0").select(F.concat(F.lit("/data/HDF/"), day, F.lit("/"), F.col("user_id").cast("string"), F.lit("/CamSer"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 1, F.lit(".png")).otherwise(F.lit(".h5"))).alias("path"))


def raw_files(spark: SparkSession, sf_dir: str, per: int = 10, gap: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw camera files of ``per`` frames each, derived from ``embeddings``, with their metadata and position texts: 4 x 16 frames of
    an 8 x 32 sensor binned by 2, with headers that count on from file to file, and skip ``gap`` numbers after each 50 frames. Files are in three folders."""
    from skyloom.functions import pixels

    idx = F.col("frame_idx")
    one = frames(spark, sf_dir).select((idx + 70_000 + F.floor(idx / 50) * gap).alias("raw"), F.floor(idx / per).alias("file"), "px")
    head = F.array(F.floor(F.col("raw") / 65536).cast("int"), (F.col("raw") % 65536).cast("int"))
    name = F.concat(F.lit("/raw/"), (F.col("file") % 3).cast("string"), F.lit("/x_CamSer"), F.lpad(F.col("file").cast("string"), 6, "0"))
    grouped = one.select("file", F.struct("raw", F.concat("px", head).alias("words")).alias("frame")).groupBy("file").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    files = grouped.select(F.concat(name, F.lit(".DMCdata")).alias("path"), pixels.as_unsigned_16(F.flatten("frames.words")).alias("content"))
    xml = grouped.select(F.concat(name, F.lit(".xml")).alias("path"), F.lit("<p><horizpixels>32</horizpixels><vertpixels>8</vertpixels><binning>2</binning><kineticrate>0.5</kineticrate></p>").alias("value"))
    nmea = grouped.select(F.concat(name, F.lit(".nmea")).alias("path"), F.lit("$GPGGA,1\n$GPRMC,070000,V,,,,,,,110413\n$GPRMC,070001,A,65.1,N,147.4,W,0,0,110413,,*1\n").alias("value"))
    return files, xml, nmea


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition logs, one for each user, derived from ``events``."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(F.col("event_type") == "click", F.lit(" Acquisition started")).otherwise(F.lit(" idle"))
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("pos"), F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("# ")).otherwise(F.lit("")), stamp, said).alias("line"))
