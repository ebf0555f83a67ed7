"""Time axis: differences, nearest frames, hour segments and the parameters that follow from a frame period.

Windows are over narrow rows, by recording and block of ``BLOCK`` frames; a block gets
the row it needs of its neighbour, so that one long recording isn't one task. A
recording's times are taken to ascend with its frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom import shared

BLOCK = 1_000_000


def differences(frames: DataFrame, value: str = "ut", out: str = "diff") -> DataFrame:
    """``rec_id, frame_idx, out``: value less the one before; the first frame has none and is left out."""
    rows = frames.select("rec_id", "frame_idx", F.col(value).alias("v"))
    block = F.floor(F.col("frame_idx") / BLOCK)
    # the last frame of a block is in the next one, too, as its predecessor
    spread = F.when(F.pmod(F.col("frame_idx"), F.lit(BLOCK)) == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.withColumn("block", F.explode(spread))
    before = F.lag("v").over(Window.partitionBy("rec_id", "block").orderBy("frame_idx"))
    return rows.withColumn(out, F.col("v") - before).where(F.col(out).isNotNull()).select("rec_id", "frame_idx", out)


def runs(frames: DataFrame, number: str = "raw_idx") -> DataFrame:
    """``rec_id, run, first_raw, last_raw, n``: stretches of a recording whose frames' own numbers follow each other by one, in order.
    A block's breaks are counted in its task, and those of the blocks before are carried on to it."""
    block = F.floor(F.col("frame_idx") / BLOCK)
    steps = differences(frames, number).select("rec_id", "frame_idx", (F.col("diff") != 1).cast("long").alias("breaks"))
    rows = frames.select("rec_id", "frame_idx", F.col(number).alias("number"), block.alias("block")).join(steps, ["rec_id", "frame_idx"], "left").fillna(0, ["breaks"])
    # one line for each block of a recording
    blocks = rows.groupBy("rec_id", "block").agg(F.sum("breaks").alias("own"))
    carried = blocks.select("rec_id", "block", (F.sum("own").over(Window.partitionBy("rec_id").orderBy("block")) - F.col("own")).alias("carried"))
    inside = F.sum("breaks").over(Window.partitionBy("rec_id", "block").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    named = rows.withColumn("inside", inside).join(carried, ["rec_id", "block"]).withColumn("run", F.col("inside") + F.col("carried"))
    return named.groupBy("rec_id", "run").agg(F.min("number").alias("first_raw"), F.max("number").alias("last_raw"), F.count("*").alias("n"))


def dropped(found: DataFrame) -> DataFrame:
    """``rec_id, after_raw, missing``: the frames that are missing between ``runs``."""
    following = F.lead("first_raw").over(Window.partitionBy("rec_id").orderBy("run"))
    return found.select("rec_id", F.col("last_raw").alias("after_raw"), (following - F.col("last_raw") - 1).alias("missing")).where("missing is not null")


def native_dt(frames: DataFrame) -> DataFrame:
    """``rec_id, dt``: the exact median of the differences, the mean of the two in the middle if they're even in number."""
    every = differences(frames).select("rec_id", "frame_idx", F.col("diff").alias("value"))
    middle = every.groupBy("rec_id").agg(F.count("*").alias("n")).select("rec_id", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank")).distinct()
    return select_ranks(every, middle).groupBy("rec_id").agg(F.avg("value").alias("dt"))


#: Digits of a double, the highest first, of 16 bits each.
DIGITS = ("d0", "d1", "d2", "d3")


def select_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rec_id, rank, value``: the values (doubles) of ``rows`` (``rec_id, frame_idx, value``) that have a ``rank``, from 0, in ascending order. By radix selection: each of four
    passes counts, of the values that begin with the digits found so far, the next digit, which has 65,536 values at most. No recording's values are sorted or gathered."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(2).to_numpy().view(np.int64)
            # in the order of doubles: negative ones turned over, others above them
            ordered = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
            parts = [pa.array(((ordered >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF)).astype(np.int32)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(len(batch)) % shared.SALTS, pa.int64()), *parts], names=["rec_id", "salt", *DIGITS])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = np.zeros(len(batch), np.uint64)
            for c in DIGITS:
                ordered = ordered << np.uint64(16) | batch.column(c).to_numpy().astype(np.uint64)
            bits = ordered.view(np.int64)
            out = np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), batch.column("rank"), pa.array(out)], names=["rec_id", "rank", "value"])

    whole = shared.written(rows.select("rec_id", "frame_idx", (F.col("value") + F.lit(0.0)).alias("value")).mapInArrow(digits, f"rec_id string, salt long, {', '.join(f'{c} int' for c in DIGITS)}"))
    sought = ranks.select("rec_id", "rank", F.col("rank").alias("left"))
    for i, digit in enumerate(DIGITS):
        known = ["rec_id", *DIGITS[:i]]
        # a rank's line goes to the pieces that a recording's values are dealt to
        pieces = sought.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shared.SALTS - 1).cast("long"))))
        counts = whole.join(pieces, [*known, "salt"]).groupBy(*known, "rank", "left", digit).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("rec_id", "rank").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        sought = found.select(*known, digit, "rank", (F.col("left") - F.col("before")).alias("left"))
    return sought.select("rec_id", "rank", *DIGITS).mapInArrow(values, "rec_id string, rank long, value double")


def around(frames: DataFrame, keys: DataFrame, whole_seconds: bool = False) -> DataFrame:
    """``keys`` (``rec_id, key`` and others) with ``t`` (what is looked up) and ``l, r struct<frame_idx,t>``: the last frame before it and the first at it or after; null where there is none.

    A key goes to the last block that begins before it, which has the first frame of the next block, too. In a block,
    one sorted sweep each way over frames and keys together; no pair is formed.
    """
    others = [c for c in keys.columns if c not in ("rec_id", "key")]
    block = F.floor(F.col("frame_idx") / BLOCK)
    slim = frames.select("rec_id", F.col("ut").alias("t"), "frame_idx")
    # one entry for each BLOCK frames of a recording
    begins = slim.where(F.pmod(F.col("frame_idx"), F.lit(BLOCK)) == 0).groupBy("rec_id").agg(F.collect_list("t").alias("begins"))
    first = F.pmod(F.col("frame_idx"), F.lit(BLOCK)) == 0
    times = slim.withColumn("kind", F.lit(1)).withColumn("block", F.explode(F.when(first & (F.col("frame_idx") > 0), F.array(block - 1, block)).otherwise(F.array(block))))
    sought = keys.select("rec_id", (F.floor("key").cast("double") if whole_seconds else F.col("key")).alias("t"), F.lit(0).alias("kind"), "key", *others).join(begins, "rec_id", "left")
    before = F.size(F.filter(F.coalesce("begins", F.array().cast("array<double>")), lambda b: b < F.col("t")))
    sought = sought.withColumn("block", F.greatest(before - 1, F.lit(0)).cast("long")).drop("begins")
    both = times.unionByName(sought, allowMissingColumns=True)
    seen = F.when(F.col("kind") == 1, F.struct("frame_idx", "t"))
    sweep = lambda *order: Window.partitionBy("rec_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.last(seen, ignorenulls=True).over(sweep("t", "kind", "frame_idx"))
    right = F.last(seen, ignorenulls=True).over(sweep(F.desc("t"), F.desc("kind"), F.desc("frame_idx")))
    return both.withColumn("l", left).withColumn("r", right).where(F.col("kind") == 0).select("rec_id", "key", "t", *others, "l", "r")


def nearest(frames: DataFrame, keys: DataFrame, whole_seconds: bool = False, with_time: bool = False) -> DataFrame:
    """``keys`` (``rec_id, key`` and others) with ``idx``: the frame nearest in time.
    Of two equally near the left; of equal times the first at the key's own time, the
    last on its left; keys outside take the end. Recordings without frames give 0. ``at`` is its time."""
    others = [c for c in keys.columns if c not in ("rec_id", "key")]
    found = around(frames, keys, whole_seconds)
    nearer = F.when(F.abs(F.col("l.t") - F.col("t")) <= F.abs(F.col("r.t") - F.col("t")), F.col("l")).otherwise(F.col("r"))
    one = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).otherwise(nearer)
    found = found.withColumn("one", one).withColumns({"idx": F.coalesce("one.frame_idx", F.lit(0).cast("long")), "at": F.col("one.t")})
    return found.select("rec_id", "key", *others, "idx", *(["at"] if with_time else []))


def hour_boundaries(ranges: DataFrame) -> DataFrame:
    """``rec_id, seq, boundary`` for ``rec_id, start, stop``: start unless it's in an
    hour's first second, each hour from there before stop, then stop."""
    start, stop = F.col("start"), F.col("stop")
    on_hour = F.floor(F.pmod(start, F.lit(3600.0))) == 0
    first = F.when(on_hour, start).otherwise(F.floor(start / 3600) * F.lit(3600.0) + 3600)
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((stop - first) / 3600)))
    hours = F.filter(F.transform(steps, lambda i: first + i * 3600), lambda x: x < stop)
    every = F.concat(F.when(on_hour, F.array().cast("array<double>")).otherwise(F.array(start)), hours, F.array(stop))
    return ranges.select("rec_id", F.posexplode(every).alias("seq", "boundary"))


def time_range(frames: DataFrame) -> DataFrame:
    """``rec_id, n, start, stop``: by position, not by value."""
    return frames.groupBy("rec_id").agg(F.count("*").alias("n"), F.min_by("ut", "frame_idx").alias("start"), F.max_by("ut", "frame_idx").alias("stop"))


def hour_segments(frames: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``rec_id, seg, s, e, us, ue``: neighbouring boundaries' nearest frames and their times, between ``start``
    and ``stop`` of ``ranges`` (by default of the recordings)."""
    keys = hour_boundaries(time_range(frames) if ranges is None else ranges).withColumnRenamed("boundary", "key")
    return segments_of(nearest(frames, keys, with_time=True))


def segments_of(found: DataFrame) -> DataFrame:
    """The same of boundaries (``rec_id, seq``) that were looked up (``idx, at``)."""
    order = Window.partitionBy("rec_id").orderBy("seq")
    pairs = found.select("rec_id", F.col("seq").alias("seg"), F.col("idx").alias("s"), F.lead("idx").over(order).alias("e"), F.col("at").alias("us"), F.lead("at").over(order).alias("ue"))
    return pairs.where(F.col("e").isNotNull())


def clock_hours(frames: DataFrame, segments: DataFrame, lookahead: int = 500) -> DataFrame:
    """Segments with ``hour``: the clock hour of the frame ``lookahead`` after the first, or of the last one."""
    n = time_range(frames).select("rec_id", "n")
    at = segments.join(n, "rec_id").withColumn("frame_idx", F.least(F.col("s") + lookahead, F.col("n") - 1))
    return at.join(frames.select("rec_id", "frame_idx", "ut"), ["rec_id", "frame_idx"]).withColumn("hour", F.floor(F.col("ut") / 3600) * F.lit(3600.0)).drop("frame_idx", "n", "ut")


def fps(dt: Column, bin_size: Column, speed: Column) -> Column:
    return speed / (dt * bin_size)


def bin_size(dt: Column, rate: Column, speed: Column) -> Column:
    """Half-even, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround(speed / (rate * dt)).cast("long"))


def stride(dt: Column, hz: Column) -> Column:
    """Frames from one shown to the next."""
    return F.greatest(F.lit(1).cast("long"), F.bround((1 / hz) / dt).cast("long"))


def parameters(dts: DataFrame, speed: float | None = None, rate: float | None = None, size: int | None = None, hz: float | None = None) -> DataFrame:
    """``rec_id, dt, speed, fps, bin_size, stride, problem`` of each recording from its frame period: exactly two of
    speed, frame rate and bin size are given. With an output rate ``hz`` the stride follows from it, and the frame rate is
    ``hz * speed``; without one it's 1. A bin larger than the stride is a problem."""
    if sum(x is not None for x in (speed, rate, size)) != 2:
        raise ValueError("give exactly two of speed, frame rate and bin size")
    dt = F.col("dt")
    v, f, n = (None if x is None else F.lit(float(x)) for x in (speed, rate, size))
    bins = bin_size(dt, f, v) if size is None else F.lit(int(size)).cast("long")
    v = f * dt * n if v is None else v
    f = fps(dt, n, v) if f is None else f
    if hz is not None:
        f = F.lit(float(hz)) * v
    step = F.lit(1).cast("long") if hz is None else stride(dt, F.lit(float(hz)))
    found = dts.select("rec_id", "dt", v.alias("speed"), f.alias("fps"), bins.alias("bin_size"), step.alias("stride"))
    return found.withColumn("problem", F.when(F.col("bin_size") > F.col("stride"), F.lit("a bin must not be larger than the stride")))


def count_bins(ranges: DataFrame, width: float | None) -> DataFrame:
    """``rec_id, n_bins, frames_per_bin`` for recordings cut by counts; without a width each frame is a bin."""
    n = F.col("n")
    if width is None:
        return ranges.select("rec_id", n.alias("n_bins"), F.lit(1).cast("long").alias("frames_per_bin"))
    wished = F.greatest(F.lit(1).cast("long"), F.expr(f"cast((stop - start) / {float(width)}D as bigint)"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(n / wished))
    return ranges.select("rec_id", F.ceil(n / per).cast("long").alias("n_bins"), per.cast("long").alias("frames_per_bin"))


def hour_bins(width: float | None, dt: float | None = None, span: float = 3600.0) -> int:
    """Bins of an hour; the frame period serves where no width is given."""
    width = dt if width is None else width
    if width is None:
        raise ValueError("give a bin width or a frame period")
    return -int(-span // width)
