"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the order by distance is the order by cosine.
A table hashes a vector by ``floor((a . x + b) / width)`` for ``hashes`` Gaussian
directions ``a``. A query visits, in each of the tables, its own bucket and then
perturbed ones, in the order of the estimated success: the sum of squared distances
to the bucket borders crossed. Candidates of all tables are merged and ranked by
their exact cosine in double precision.

How it is spread out: table rows are dealt by bucket into parts of ``PART_ROWS`` on average, and
each part meets the probes for it, of which there are about as many however large the table is.
Within a part only the buckets that a query visits are multiplied with it. A part that holds more
than ``LARGE`` times the average (a common bucket) is cut by rows, and its probes go to every cut;
where a part has more than ``QUERY_BLOCK`` probes, they come in blocks. No bucket or set of
queries has to fit into one task. Equal vectors are equally near,
so that at most ``k + 1`` of them, the ones with the smallest ids, can be among a
query's ``k`` nearest and its own: the others needn't be hashed, and a vector that a third of
all rows hold fills no bucket.

A query that has found fewer than ``k`` rows in its buckets (small tables, rare lengths, outliers)
goes on to visit all rows of its length, so that it gets all candidates if they are fewer.

Every row is indexed; the directions come from a seed, not from data. Vectors that are null or
zero or hold null or non-finite components take no part, nor do rows with a null id.
Vectors meet only those of their own length. Rows with one id count as one candidate (its nearest vector). An
empty table gives no rows. Extra columns are ignored.

Where vectors have no near neighbours (independent random directions), half of all
rows have to be visited for a recall of 0.9; ``hashes`` and ``probes`` are set for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, read

TABLES, HASHES, WIDTH, PROBES = 4, 5, 1.1, 350
QUERY_EVERY, K = 50, 5
#: Table rows of a part, and probes that meet them at once, on average; parts ``LARGE`` times as large are cut.
PART_ROWS, QUERY_BLOCK, LARGE = 20_000, 8192, 4
#: Scores that a task holds at once.
CELLS = 2_000_000
#: Scores within this of the last place are computed anew, in one fixed order of summing.
NEAR = 1e-9


def directions(table: int, dim: int, hashes: int, width: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([seed, table, dim])
    return random.standard_normal((dim, hashes)), random.uniform(0, width, hashes)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cell coordinates."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def probe_cells(place: np.ndarray, probes: int, reach: int = 3) -> np.ndarray:
    """The cells that queries at ``place`` (queries x hashes, in widths) visit:
    queries x probes x hashes, nearest first by the sum of squared border distances."""
    hashes = place.shape[1]
    own = np.floor(place)
    steps = np.arange(-reach, reach + 1)
    inside = place - own
    # squared distance to the border that must be crossed for each step
    cost = np.where(steps > 0, steps - inside[..., None], np.where(steps < 0, inside[..., None] - steps - 1, 0.0)) ** 2
    best = np.zeros((len(place), 1))
    moves = np.zeros((len(place), 1, 0), np.int64)
    for i in range(hashes):  # grow the sets hash by hash, keeping the nearest ones
        score = (best[:, :, None] + cost[:, i, None, :]).reshape(len(place), -1)
        n = min(probes, score.shape[1])
        chosen = np.argpartition(score, n - 1, axis=1)[:, :n]
        best = np.take_along_axis(score, chosen, 1)
        before = np.take_along_axis(moves, (chosen // len(steps))[..., None].repeat(moves.shape[2], 2), 1) if i else np.zeros((*chosen.shape, 0), np.int64)
        moves = np.concatenate([before, steps[chosen % len(steps)][..., None]], axis=2)
    order = np.argsort(best, axis=1, kind="stable")
    return own[:, None, :].astype(np.int64) + np.take_along_axis(moves, order[..., None].repeat(hashes, 2), 1)


def usable(vectors: Column) -> Column:
    x = F.transform(vectors, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def best_of(query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the pairs that can be among a query's ``k`` best."""
    order = np.lexsort((-score, query))
    names, first, size = np.unique(query[order], return_index=True, return_counts=True)
    last = score[order[first + np.minimum(size, k) - 1]]
    return order[score[order] >= np.repeat(last, size) - NEAR]


def visited(rows: pd.DataFrame, probes: pd.DataFrame, k: int) -> pd.DataFrame:
    """``query_id, vec_id, score``: each query's ``k`` best among the rows of its buckets."""
    rows = rows.sort_values("bucket", kind="stable")
    names, starts = np.unique(rows["bucket"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(rows))
    raw, ids = _matrix(rows["embedding"]), rows["vec_id"].to_numpy()
    raw_q, ids_q = _matrix(probes["embedding"]), probes["query_id"].to_numpy()
    x, q = unit(raw), unit(raw_q)
    wanted = np.concatenate([np.asarray(b) for b in probes["buckets"]])
    asking = np.repeat(np.arange(len(probes)), [len(b) for b in probes["buckets"]])
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    there = names[at] == wanted
    at, asking = at[there], asking[there]
    order = np.argsort(at, kind="stable")
    at, asking = at[order], asking[order]
    pairs, held = [np.zeros((3, 0))], 0
    for bucket, visitors in zip(np.unique(at), np.split(asking, np.flatnonzero(np.diff(at)) + 1)):
        for s in range(starts[bucket], ends[bucket], CELLS // 256):
            e = min(ends[bucket], s + CELLS // 256)
            for v in range(0, len(visitors), max(1, CELLS // (e - s))):
                mine = visitors[v : v + max(1, CELLS // (e - s))]
                score = q[mine] @ x[s:e].T
                score[ids_q[mine][:, None] == ids[None, s:e]] = -2
                floor = np.partition(score, -k, axis=1)[:, -k] if e - s > k else np.full(len(mine), -1.5)
                i, j = np.nonzero(score >= np.maximum(floor - NEAR, -1.5)[:, None])
                pairs.append(np.stack([mine[i], j + s, score[i, j]]))
                held += len(i)
        if held > CELLS:
            every = np.concatenate(pairs, axis=1)
            pairs = [every[:, best_of(every[0], every[2], k)]]
            held = 0
    every = np.concatenate(pairs, axis=1)
    every = every[:, best_of(every[0], every[2], k)] if every.shape[1] else every
    asked, row = every[:2].astype(np.int64)
    out = [np.zeros(0)]
    for s in range(0, len(row), 100_000):
        out.append(cosine(raw_q[asked[s : s + 100_000]], raw[row[s : s + 100_000]]))
    return pd.DataFrame({"query_id": ids_q[asked], "vec_id": ids[row], "score": np.concatenate(out)})


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` (``vec_id, embedding``)
    the ``k`` nearest found among ``vectors`` but the row with its own id."""

    def clean(df: DataFrame) -> DataFrame:
        double = F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), double)

    # the smallest k + 1 ids of equal vectors; their rank is limited before the shuffle, too
    first = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = clean(vectors).distinct().withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    distinct = materialise(distinct)
    n = distinct.count()
    asked = materialise(clean(queries).distinct())
    n_asked = asked.count()
    parts = max(1, -(-n // PART_ROWS))
    # a query has at most so many probes of a table: parts get fewer of all, the more there are
    blocks = max(1, round(n_asked * min(1, probes / parts) / QUERY_BLOCK))

    def lengths(lot: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        for dim, own in lot.groupby(lot["embedding"].map(len)):
            yield dim, own, unit(_matrix(own["embedding"]))

    def hashed(lots: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
        for lot in lots:
            for dim, own, x in lengths(lot):
                for t in range(tables):
                    a, b = directions(t, dim, hashes, width)
                    bucket = bucket_ids(np.floor((x @ a + b) / width))
                    key = pd.DataFrame({"tbl": t, "dim": dim, "part": bucket % parts})
                    yield key.assign(bucket=bucket, vec_id=own["vec_id"].to_numpy(), embedding=own["embedding"].to_numpy()) if whole else key

    def probed(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            for dim, own, x in lengths(lot):
                ids, vectors = own["vec_id"].to_numpy(), own["embedding"].to_numpy()
                for t in range(tables):
                    a, b = directions(t, dim, hashes, width)
                    for s in range(0, len(x), 256):
                        buckets = bucket_ids(probe_cells((x[s : s + 256] @ a + b) / width, probes))
                        part, lines = buckets % parts, []
                        for i in range(len(buckets)):
                            for p in np.unique(part[i]):
                                lines.append((t, dim, int(p), int(ids[s + i]), vectors[s + i], buckets[i][part[i] == p]))
                        yield pd.DataFrame(lines, columns=["tbl", "dim", "part", "query_id", "embedding", "buckets"])

    def meet(rows: pd.DataFrame, probes_: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(probes_):
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
        return visited(rows, probes_, k)

    key = ["tbl", "dim", "part", "block", "cut"]
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    def nearest(table: DataFrame, asking: DataFrame, blocks: int) -> DataFrame:
        """Rows and probes with ``tbl, dim, part, cuts`` meet, and the results are merged."""
        table = table.withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).withColumn("block", numbers(F.lit(blocks)))
        asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long")).withColumn("cut", numbers(F.col("cuts")))
        met = table.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
        # k rows at most from each table and part, and those equal to the last
        merged = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    place = "tbl int, dim int, part long"
    table = distinct.mapInPandas(lambda lots: hashed(lots, True), f"{place}, bucket long, vec_id long, embedding array<double>")
    # the few parts that are large: not more than rows / (LARGE * PART_ROWS) a table
    sizes = distinct.mapInPandas(lambda lots: hashed(lots, False), place).groupBy("tbl", "dim", "part").count()
    large = materialise(sizes.where(F.col("count") > LARGE * PART_ROWS).select("tbl", "dim", "part", F.ceil(F.col("count") / PART_ROWS).alias("cuts")))
    with_cuts = lambda df: df.join(large, ["tbl", "dim", "part"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
    asking = asked.mapInPandas(probed, f"{place}, query_id long, embedding array<double>, buckets array<long>")
    found = materialise(nearest(with_cuts(table), with_cuts(asking), blocks))

    enough = found.where(F.col("rank") == k).select("query_id")
    short = materialise(asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"))
    n_short = short.count()
    if not n_short:
        return found
    # all rows in parts, and these queries in blocks: one bucket holds every row of a length
    one = lambda df: df.select(F.lit(-1).alias("tbl"), F.size("embedding").alias("dim"), "*")
    rows = one(distinct).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumns({"cuts": F.lit(1).cast("long"), "bucket": F.lit(0).cast("long")})
    every = one(short).withColumnRenamed("vec_id", "query_id").withColumn("part", numbers(F.lit(parts))).withColumns({"cuts": F.lit(1).cast("long"), "buckets": F.array(F.lit(0).cast("long"))})
    rest = nearest(rows, every, max(1, round(n_short / QUERY_BLOCK)))
    return found.join(enough, "query_id", "left_semi").unionByName(rest)


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, pair by pair, each summed in the same order."""
    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (queries, rows))
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
