"""What driver and executors share: a folder for tables between steps, and small tables that may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow lines is broadcast.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which a cluster has to name; a single machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written once into the shared folder and read from there: a lost executor costs a re-read."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, bool]:
    """A table written once, to be broadcast if it has few rows, and whether it has."""
    kept = written(df)
    few = kept.count() <= (BROADCAST_ROWS if rows is None else rows)
    return (F.broadcast(kept) if few else kept), few


#: Pieces that the rows of a common key are dealt to where the other side is no small table.
SALTS = 64


def met(rows: DataFrame, lines: DataFrame, keys: list[str], spread_by: str, rows_at_most: int | None = None) -> DataFrame:
    """The inner join of wide ``rows`` with narrow ``lines``, of which a key has few: ``lines`` are broadcast if they're a small table, so that
    no row is moved. Else they're copied to pieces, over which a key's rows are dealt by the whole number ``spread_by``."""
    lines, few = small(lines, rows_at_most)
    if few:
        return rows.join(lines, keys)
    salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.col(spread_by).cast("long"), F.lit(SALTS))).join(salted, [*keys, "salt"]).drop("salt")
