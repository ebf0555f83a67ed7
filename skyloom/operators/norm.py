"""Brightness limits from pixel histograms of sampled frames."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from skyloom import shared
from skyloom.operators.timeaxis import nearest, time_range


def sample_index(ranges: DataFrame, interval: float) -> DataFrame:
    """``rec_id, k, frame_idx``: evenly spaced frames of ``rec_id, s, e, start, stop``,
    both ends among them, truncated to whole indexes; too many give some twice."""
    n = F.expr(f"cast((stop - start) / {float(interval)}D as bigint)")
    some = ranges.withColumn("n_samples", n).where("n_samples > 0")
    k, a, b, m = F.col("k"), F.col("s"), F.col("e"), F.col("n_samples")
    even = F.floor(k * ((b - a) / F.greatest(m - 1, F.lit(1))) + a)
    return some.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), m - 1))).select("rec_id", "k", F.when((k == m - 1) & (m > 1), b).otherwise(even).cast("long").alias("frame_idx"))


def times_sampled(frames: DataFrame, ranges: DataFrame, interval: float) -> DataFrame:
    """The frames that ``sample_index`` would choose, where they are, with ``times``: how often. A frame's places in the sample are found by
    arithmetic, so that no sample meets the frames; only the ranges do."""
    n = F.expr(f"cast((stop - start) / {float(interval)}D as bigint)")
    lines = ranges.withColumn("n_samples", n).where("n_samples > 0").select("rec_id", F.col("s").alias("first_s"), F.col("e").alias("last_e"), "n_samples")
    i, a, b, m = F.col("frame_idx"), F.col("first_s"), F.col("last_e"), F.col("n_samples")
    step = (b - a) / F.greatest(m - 1, F.lit(1))
    near = F.floor((i - a) / F.nullif(step, F.lit(0.0)))
    at = lambda k: F.when((k == m - 1) & (m > 1), b).otherwise(F.floor(k * step + a))
    some = F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2 + F.ceil(1 / F.nullif(step, F.lit(0.0))), m - 1)), lambda k: at(k) == i)
    times = F.when(step == 0, F.when(i == a, m).otherwise(0)).otherwise(F.size(some))
    held = shared.met(frames, lines, ["rec_id"], "frame_idx").where(i.between(a, b))
    return held.withColumn("times", times.cast("long")).where("times > 0").drop("first_s", "last_e", "n_samples")


#: Values of a pixel; histograms that a task holds at once.
VALUES, HELD = 65_536, 64


def pixel_counts(frames: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """``keys, v, n`` of the pixels above zero of each key's frames (``px``, as often as ``times`` says). A task counts its own frames into dense vectors, batch
    by batch, and only what it counted of each value is moved; fails where values aren't unsigned 16-bit ones."""
    kinds = {f.name: f for f in frames.select(*keys).schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, own in held.items():
                some = np.flatnonzero(own[1:]) + 1
                names = [pa.array([x] * len(some), kind) for x, kind in zip(key, named)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(some, pa.int32()), pa.array(own[some])], names=[*keys, "v", "n"])
            held.clear()

        named: list[pa.DataType] = []
        for batch in batches:
            named = [batch.schema.field(c).type for c in keys]
            px = batch.column("px")
            sizes = pc.fill_null(pc.list_value_length(px), 0).to_numpy(zero_copy_only=False)
            values, ends = pc.list_flatten(px).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            if len(values) and not (0 <= values.min() and values.max() < VALUES):
                raise ValueError("pixels must be 16-bit unsigned")
            often = batch.column(times).to_numpy(zero_copy_only=False) if times else None
            rows = list(zip(*[batch.column(c).to_pylist() for c in keys]))
            starts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)] if rows else [0]
            for s, e in zip(starts, starts[1:]):
                weights = None if often is None else np.repeat(often[s:e], sizes[s:e]).astype(float)
                own = held.setdefault(rows[s], np.zeros(VALUES, np.int64))
                own += np.bincount(values[ends[s] : ends[e]].astype(np.int64), weights, VALUES).astype(np.int64)
            if len(held) > HELD:
                yield from out()
        yield from out()

    schema = StructType([*[kinds[c] for c in keys], StructField("v", IntegerType()), StructField("n", LongType())])
    return summed(frames.select(*keys, "px", *([times] if times else [])).mapInArrow(count, schema), keys)


def summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def pixel_histogram(frames: DataFrame, times: str | None = None) -> DataFrame:
    """``rec_id, v, n`` of pixels above zero; fails where they aren't unsigned 16-bit values."""
    return pixel_counts(frames, ["rec_id"], times)


@dataclass
class Tree:
    """Histograms of dyadic ranges of frames: ``counts`` (``rec_id, level, node, v, n``) of frames from ``node * leaf * 2 ** level`` on, up to ``levels``."""

    counts: DataFrame
    leaf: int
    levels: int


def histogram_tree(frames: DataFrame, leaf: int = 64) -> Tree:
    """One pass over the pixels, for the limits of any ranges of frames; each level adds up the one below."""
    keys = ["rec_id", "level", "node"]
    base = shared.written(pixel_counts(frames.withColumns({"level": F.lit(0), "node": F.floor(F.col("frame_idx") / leaf)}), keys))
    levels = max(0, int(base.agg(F.max("node")).first()[0] or 0).bit_length())
    every = [base]
    for level in range(1, levels + 1):
        every.append(summed(every[-1].withColumns({"level": F.lit(level), "node": F.floor(F.col("node") / 2)}), keys))
    return Tree(shared.written(functools.reduce(DataFrame.unionByName, every)), leaf, levels)


def range_histograms(tree: Tree, frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rec_id, name, v, n`` of the frames from ``s`` to ``e`` (both in) of ``ranges`` (``rec_id, name, s, e``): from two stored nodes a level at most, and the
    pixels of less than two leaves of frames at the ends."""
    keys = ["rec_id", "name"]
    low, high = F.ceil(F.col("s") / tree.leaf), F.floor((F.col("e") + 1) / tree.leaf)
    inner = ranges.withColumns({"low": low, "high": F.greatest(low, high)}).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(tree.levels))))
    width = F.pow(F.lit(2.0), F.col("level"))
    inner = inner.withColumns({"l": F.ceil(F.col("low") / width), "r": F.floor(F.col("high") / width)}).where("l < r")
    ends = F.filter(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)), lambda x: x.isNotNull())
    nodes = F.when(F.col("level") == tree.levels, F.sequence("l", F.col("r") - 1)).otherwise(ends)
    taken = inner.select("rec_id", "name", "level", F.explode(F.array_distinct(nodes)).alias("node"))
    whole = shared.met(tree.counts, taken, ["rec_id", "level", "node"], "v").select(*keys, "v", "n")
    lines = ranges.groupBy("rec_id").agg(F.collect_list(F.struct("name", "s", "e")).alias("ranges"))
    i, first, last = F.col("frame_idx"), lambda x: F.ceil(x.s / tree.leaf) * tree.leaf, lambda x: F.floor((x.e + 1) / tree.leaf) * tree.leaf
    at_end = lambda x: i.between(x.s, x.e) & ((i < first(x)) | (i >= last(x)))
    edges = shared.met(frames, lines, ["rec_id"], "frame_idx").withColumn("name", F.explode(F.transform(F.filter("ranges", at_end), lambda x: x["name"])))
    return summed(whole.unionByName(pixel_counts(edges, keys)), keys)


def cumulative(histogram: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """With ``cum``: pixels up to each value (at most 65,535 lines a recording, or other ``keys``)."""
    return histogram.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))


def _percentile(p: float) -> Column:
    """The smallest value that a share ``p`` of the pixels doesn't pass; 0 for p = 0."""
    return F.lit(0) if p == 0 else F.min(F.when(F.col("cum") >= F.col("total") * p / 100, F.col("v")))


def limits(histogram: DataFrame, low: float = 1, high: float = 99, linear: bool = False, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """``rec_id`` (or other ``keys``), ``vmin, vmax, kind``. Recordings without bright pixels give no line; see ``require``."""
    cdf = cumulative(histogram, keys).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    found = cdf.groupBy(*keys).agg(_percentile(low).cast("double").alias("vmin"), _percentile(high).cast("double").alias("vmax"))
    return found.withColumn("vmin", F.col("vmin") if linear else F.greatest("vmin", F.lit(1e-6))).withColumn("kind", F.lit("linear" if linear else "log"))


def norm(frames: DataFrame, interval: float, low: float = 1, high: float = 99, linear: bool = False) -> DataFrame:
    """Limits of the frames sampled each ``interval`` seconds over whole recordings, from the first frame to the last."""
    ranges = time_range(frames.select("rec_id", "frame_idx", "ut")).withColumn("s", F.lit(0).cast("long")).withColumn("e", F.col("n") - 1)
    return _of_sample(frames, ranges, interval, low, high, linear)


def norm_between(frames: DataFrame, interval: float, bounds: DataFrame | None = None, low: float = 1, high: float = 99, linear: bool = False) -> DataFrame:
    """Limits of the frames sampled between two times of each recording (``rec_id, start, stop`` of ``bounds``, by default
    and where null its first and last frame's), both looked up as whole seconds, so that the frames of the last part of a second may be left out."""
    slim = frames.select("rec_id", "frame_idx", "ut")
    ranges = time_range(slim)
    if bounds is not None:
        given = bounds.select("rec_id", F.col("start").alias("from"), F.col("stop").alias("to"))
        ranges = ranges.join(given, "rec_id", "left").select("rec_id", F.coalesce("from", "start").alias("start"), F.coalesce("to", "stop").alias("stop"))
    ends = ranges.select("rec_id", F.inline(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("key")) for c in ("start", "stop")])))
    found = nearest(slim, ends, whole_seconds=True, with_time=True)
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    ranges = found.groupBy("rec_id").agg(of("start", "idx").alias("s"), of("stop", "idx").alias("e"), of("start", "at").alias("start"), of("stop", "at").alias("stop"))
    return _of_sample(frames, ranges, interval, low, high, linear)


def _of_sample(frames: DataFrame, ranges: DataFrame, interval: float, low: float, high: float, linear: bool) -> DataFrame:
    return limits(pixel_histogram(times_sampled(frames, ranges, interval), "times"), low, high, linear)


def require(found: DataFrame) -> tuple[float, float, str]:
    """The limits of a single recording; fails if no pixel is above zero."""
    row = found.first()
    if row is None:
        raise ValueError("no pixel above zero in the sampled frames")
    return row["vmin"], row["vmax"], row["kind"]
