"""Uniform shuffle of a corpus into shards of exact sizes (law ``rows``).

1. Every row gets a number that is written down once, so that retries see the same.
   Runs of those numbers are the source groups.
2. A hypergeometric communication matrix is drawn: how many rows each source
   group hands to each shard, given the group's rows and the shard's seats. Seats
   differ by one row at most, so the shards' sizes are exact, not just expected.
3. Within a group the rows are permuted by a pseudo-random key; their ranks are
   cut by the matrix into shards. Within a shard they are permuted again, which
   gives the slots.

Ranks never put a whole group or shard into one task: a group is dealt by the
key's leading bits into sub-buckets of ``BUCKET_ROWS`` rows at most on average,
counts per sub-bucket give each one's first rank, and only a sub-bucket is sorted.
Keys are hashes of row numbers, so copies, ties and hot values spread evenly.

The matrix has ``SOURCE_GROUPS`` x shards cells at most, whatever the input's
size; it is the only thing drawn on the driver, by one law at every size. Everything else is DataFrame
operations. Null texts count as empty; long texts and repeated rows are rows like any
other. An empty table gives no rows. Extra columns ride along in ``shard_rows``; those
of a result's name are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, read

N_SHARDS = 24
#: Source groups of the matrix at most.
SOURCE_GROUPS = 1024
#: Rows sorted at once, on average.
BUCKET_ROWS = 250_000


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each group hands to each shard, as a uniform shuffle of all rows
    would deal them: one multivariate hypergeometric draw after the other."""
    total = sum(sizes)
    seats = np.array([total // n_shards + (k < total % n_shards) for k in range(n_shards)], dtype=np.int64)
    random = np.random.default_rng(seed)
    out = np.zeros((len(sizes), n_shards), dtype=np.int64)
    for i, size in enumerate(sizes):
        left, rest = size, int(seats.sum())
        for k in range(n_shards):  # one shard after the other, each from what is left
            rest -= int(seats[k])
            out[i, k] = _hypergeometric(random, int(seats[k]), rest, left)
            left -= int(out[i, k])
        seats -= out[i]
    return out


def _hypergeometric(random: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn``, by inversion around the mode. Probabilities come from the ratios of
    neighbours, exact to double precision whatever the counts' size; the window reaches to
    where they are below 1e-20 of the mode's."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    n, p = good + bad, good / (good + bad)
    reach = 16 + int(9.5 * (drawn * p * (1 - p) * (n - drawn) / (n - 1)) ** 0.5)
    while True:
        up = np.arange(mode, min(high, mode + reach), dtype=float)
        down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
        above = np.cumprod((good - up) / (up + 1) * ((drawn - up) / (bad - drawn + up + 1)))
        below = np.cumprod(down / (good - down + 1) * ((bad - drawn + down) / (drawn - down + 1)))
        if all(not len(side) or side[-1] < 1e-20 or len(side) == most for side, most in ((above, high - mode), (below, mode - low))):
            break
        reach *= 2
    mass = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    at = int(np.searchsorted(mass, random.random() * mass[-1], side="right"))
    return mode - len(below) + min(at, len(mass) - 1)


def _random_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("row"))


def _ranked(df: DataFrame, group: str, seed: int, buckets: int) -> DataFrame:
    """``rank``: a row's place, from 0, in the order of its random key within ``group``."""
    df = df.withColumn("key", _random_key(seed)).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 33), F.lit(buckets)))
    counts = df.groupBy(group, "bucket").count()
    # one line per group and sub-bucket: a small table, grouped by group
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(group).orderBy("bucket")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("key", "row")) - 1
    return df.withColumn("inside", inside).join(before, [group, "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "bucket", "key")


def _literal_table(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    """A small table as one literal, exploded by Spark."""
    kind = "array<struct<grp:long,shard:int,low:long,high:long>>"
    data = json.dumps([dict(zip(("grp", "shard", "low", "high"), map(int, r))) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), kind)))


def shard_rows(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = 0) -> DataFrame:
    """All columns of ``rows`` with ``shard int`` and ``slot long``."""
    spark = rows.sparkSession
    inner = {"row", "grp", "shard", "slot", "rank", "key", "bucket", "inside", "before", "count"}
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    safe = {c: f"given_{i}" for i, c in enumerate(given)} if inner & set(given) else {c: c for c in given}
    numbered = materialise(rows.select(*[F.col(f"`{c}`").alias(safe[c]) for c in given], F.monotonically_increasing_id().alias("row")))

    # source groups: partitions of the writing job, folded where there are more than SOURCE_GROUPS
    sliced = numbered.withColumn("grp", F.pmod(F.shiftrightunsigned("row", 33), F.lit(SOURCE_GROUPS)))
    sizes = {r[0]: r[1] for r in sliced.groupBy("grp").count().collect()}
    total = sum(sizes.values())
    groups = sorted(sizes)
    matrix = communication_matrix([sizes[g] for g in groups], n_shards, seed)
    cells = []
    for g, line in zip(groups, matrix):
        high = np.cumsum(line)
        cells += [(g, k, h - n, h) for k, (n, h) in enumerate(zip(line, high)) if n]
    per = lambda n: max(1, -(-total // (max(1, n) * BUCKET_ROWS)))

    dealt = _ranked(sliced, "grp", 2 * seed + 1, per(len(groups)))
    # at most SOURCE_GROUPS * n_shards cells; a group's line is one array, so that the join adds no rows
    lines = _literal_table(spark, cells).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard"))).alias("line"))
    pick = F.filter("line", lambda c: (c.low <= F.col("rank")) & (F.col("rank") < c.high))[0].shard
    dealt = dealt.join(F.broadcast(lines), "grp").withColumn("shard", pick).drop("line", "rank", "grp")
    out = _ranked(dealt, "shard", 2 * seed + 2, per(n_shards)).withColumnRenamed("rank", "slot")
    return out.select(*[F.col(safe[c]).alias(c) for c in given], F.col("shard"), F.col("slot").cast("long"))


def digest(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_rows(rows, n_shards).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
