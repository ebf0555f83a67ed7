"""Bins of so many frames each, in the order of time, of frames that arrive in any order.

Which bin a frame is in depends on how many came before it, not on its number: frames wait in the state until the watermark has passed
them, and are then taken in their order. A bin's sums are kept until it's full. An end mark, later than any frame, lets go what still
waits, and the bin that isn't full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.operators.keogram import _axis
from skyloom.streaming.keograms import run_to_end

#: The end mark's time, in Unix seconds: of the year 2255.
END = 9_000_000_000.0
#: A watermark, in milliseconds, that only end marks bring about.
PAST = (END - 366 * 86400) * 1000
SLIM = "rec_id string, frame_idx long, ut double, v array<int>"
MEANS = "rec_id string, bin long, pos int, mean double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bins(StatefulProcessor):
    """Means of each ``per_bin`` slices of a recording."""

    def __init__(self, per_bin: int):
        self.per_bin = per_bin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ut double, frame_idx long", "v array<int>")
        self.open = handle.getValueState("open", "bin long, n long, total array<long>, ut double, frame_idx long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.open.get()[3:] if self.open.exists() else (float("-inf"), -1)
        latest = None
        for lot in rows:
            for frame_idx, ut, v in zip(lot["frame_idx"], lot["ut"], lot["v"]):
                if (ut, frame_idx) > last:  # else it's late, or here for the second time
                    self.waiting.updateValue((float(ut), int(frame_idx)), ([int(x) for x in v],))
                    latest = ut if latest is None else max(latest, ut)
        if latest is not None:
            self.handle.registerTimer(int(min(latest * 1000, PAST)) + 1)
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def _release(self, rec_id: str, watermark: int) -> pd.DataFrame:
        free = sorted(k for k in self.waiting.keys() if min(k[0] * 1000, PAST) <= watermark)
        number, n, total, ut, frame_idx = self.open.get() if self.open.exists() else (0, 0, [], float("-inf"), -1)
        total, out = list(total), []

        def close() -> None:
            out.extend((rec_id, number, pos, x / n) for pos, x in enumerate(total))

        for at in free:
            v = self.waiting.getValue(at)[0]
            self.waiting.removeKey(at)
            ut, frame_idx = at
            if ut == END:
                if n:
                    close()
                number, n, total = number + (n > 0), 0, []
                continue
            total, n = ([a + b for a, b in zip(total, v)] if n else list(v)), n + 1
            if n == self.per_bin:
                close()
                number, n, total = number + 1, 0, []
        if free:
            self.open.update((number, n, total, ut, frame_idx))
        return pd.DataFrame(out, columns=["rec_id", "bin", "pos", "mean"])

    def close(self) -> None:
        pass


def bins(stream: DataFrame, ends: DataFrame, axis: str, per_bin: int, late: str) -> DataFrame:
    """``rec_id, bin, pos, mean`` of a stream of frames and one of end marks (``SLIM``). Frames more than ``late`` behind the latest are left out.
    Needs the RocksDB state store, see ``run``."""
    slim = stream.select("rec_id", "frame_idx", "ut", _axis(stream, axis).alias("v")).unionByName(ends)
    timed = slim.withColumn("ts", F.timestamp_millis((F.col("ut") * 1000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("rec_id").transformWithStateInPandas(Bins(per_bin), MEANS, "Append", "EventTime")


def run(stream: DataFrame, folder: str, axis: str, per_bin: int, late: str, ended: DataFrame | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Reads all of the input there is. If it's over, ``ended`` has its recordings (``rec_id``), whose ends are marked then, to get the last bins, too.
    ``folder`` holds the results, the checkpoint and the marks; the same call goes on where it was left."""
    spark, marks = stream.sparkSession, f"{folder}/ends"
    spark.createDataFrame([], SLIM).write.mode("append").parquet(marks)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        once = lambda: run_to_end(bins(stream, spark.readStream.schema(SLIM).parquet(marks), axis, per_bin, late), f"{folder}/out", f"{folder}/state", "append", sink)
        found = once()
        if ended is not None:
            mark = ended.select("rec_id", F.lit(0).cast("long").alias("frame_idx"), F.lit(END).alias("ut"), F.array().cast("array<int>").alias("v"))
            mark.write.mode("append").parquet(marks)
            found = once()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return found
