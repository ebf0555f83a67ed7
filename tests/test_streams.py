"""Streams: bins in the order of time, and sinks that write a batch once."""

import random
from collections import defaultdict

import pytest

from skyloom import schema
from skyloom.operators import keogram
from skyloom.streaming import keograms, ordered

SF = "/root/testdata/sf0.001"


def recordings(n):
    """Two recordings with dropped frames: rows, and the means of each seven."""
    r = random.Random(n)
    rows = [(rec, i, 1000.0 + i * 0.5 + (0.25 if rec == "b" else 0), 2, 3, [r.randrange(100) for _ in range(6)]) for rec in "ab" for i in range(n) if i % 11 != 5]
    want = {}
    for rec in "ab":
        own = [x for x in rows if x[0] == rec]
        for b in range(0, len(own), 7):
            lot = [x[5][3:6] for x in own[b : b + 7]]
            want |= {(rec, b // 7, pos): sum(v[pos] for v in lot) / len(lot) for pos in range(3)}
    return rows, want


def streamed(spark, folder, lots):
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, schema.FRAME).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema.FRAME).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("lots", [1, 3])
def test_bins_of_any_arrival_are_the_batch_bins(spark, tmp_path, lots):
    rows, want = recordings(60)
    step = -(-len(rows) // lots)
    # out of order within 20 s: shuffled stretches of time, dealt to batches
    r = random.Random(lots)
    shuffled = sorted(rows, key=lambda x: x[2] + r.uniform(0, 9))
    stream = streamed(spark, tmp_path, [shuffled[i : i + step] for i in range(0, len(rows), step)])
    known = ordered.run(stream, str(tmp_path), "ew", 7, "20 seconds")
    assert {(x.rec_id, x.bin, x.pos) for x in known.collect()} < set(want)
    ended = spark.createDataFrame([("a",), ("b",)], "rec_id string")
    found = ordered.run(stream, str(tmp_path), "ew", 7, "20 seconds", ended).collect()
    assert len(found) == len(want) and {(x.rec_id, x.bin, x.pos): x.mean for x in found} == pytest.approx(want)


def test_a_stopped_batch_is_written_once(spark, tmp_path):
    """Stops between a batch's write and its commit, and goes on from the checkpoint."""
    rows, want = recordings(40)
    stream = streamed(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :]])
    calls = defaultdict(int)

    def sink(batch, n):
        keograms.write_batch(f"{tmp_path}/out")(batch, n)
        calls[n] += 1
        if n < 2 and calls[n] == 1:
            raise RuntimeError("stopped")

    ended = spark.createDataFrame([("a",), ("b",)], "rec_id string")
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            ordered.run(stream, str(tmp_path), "ew", 7, "100 seconds", ended, sink)
    found = ordered.run(stream, str(tmp_path), "ew", 7, "100 seconds", ended, sink).collect()
    assert calls[0] == 2 and calls[1] == 2
    assert len(found) == len(want) and {(x.rec_id, x.bin, x.pos): x.mean for x in found} == pytest.approx(want)


def test_an_hour_stream_goes_on_after_a_stop(spark, tmp_path):
    frames = schema.frames(spark, SF)
    for i in range(3):
        frames.where(f"frame_idx div 200 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    means, failed = keograms.means(stream, "ew", late="10 minutes", span=1800.0), []

    def sink(batch, n):
        keograms.write_batch(f"{tmp_path}/out")(batch, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        keograms.run_to_end(means, f"{tmp_path}/out", f"{tmp_path}/state", "append", sink)
    out = keograms.run_to_end(means, f"{tmp_path}/out", f"{tmp_path}/state", "append", sink).collect()
    want = {(x.rec_id, x.hour + 60 * x.bin, x.pos): x.mean for x in keogram.by_hour(frames, "ew", span=1800.0).collect()}
    got = {(x.rec_id, x.start, x.pos): x.mean for x in out}
    # the frames are in an hour's first half, in parts: the span leaves some out
    assert len(out) == len(got) > 0 and all(want[k] == pytest.approx(v) for k, v in got.items())
    assert any(x.ut % 3600 >= 1800 for x in frames.select("ut").collect())
