"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the line, word and block rules of these operators use it.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch, where the session doesn't say: batches of 10,000 rows hold too much of long texts.
BATCH_BYTES = 4 << 20

#: Keys more common than one in so many rows are cut into pieces.
HOT_KEYS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the session names none, a
    temporary one serves a single machine (as in tests); a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Where the folders that are being written are noted, if anywhere.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that are written meanwhile, for ``clean``."""
    folders: list[str] = []
    token = _noted.set(folders)
    try:
        yield folders
    finally:
        _noted.reset(token)


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _noted.get() is not None:
        _noted.get().append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, fixes values that
    depend on partitioning, and gives the next plan real sizes to choose joins by.
    What is written stays, but for what is noted in a ``scratch`` and given to ``clean``.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders. Results that still read them must be written before."""
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, on both sides of a worker, unless it sets a size itself.
    Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], often: str, total: int, spread_by: list[str]) -> DataFrame:
    """The inner join on ``keys``, which aren't null and of which ``right`` has each once, with ``often``: how many of
    the ``total`` rows of ``left`` have it at most. A key that more than one in ``HOT_KEYS`` rows have is cut into pieces, over
    which its rows are dealt by ``spread_by``; there are less than ``HOT_KEYS`` such keys, so that they can be broadcast."""
    most = max(1, total // HOT_KEYS)
    pieces = F.ceil(F.col(often) / most)
    hot = right.where(F.col(often) > most).select(*keys, pieces.alias("pieces"))
    dealt = F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*spread_by), F.col("pieces")))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("piece", dealt).drop("pieces")
    right = right.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(pieces, F.lit(1).cast("long")) - 1)))
    return left.join(right, [*keys, "piece"]).drop("piece")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
