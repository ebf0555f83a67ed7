"""What shall hold at scale: no pixels in an exchange, no rows of pixels, lookups that read what they need, broken files."""

import glob
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import schema, shared
from skyloom.operators import fold, keogram, norm, timeaxis, video, zones
from skyloom.plans import batch, pipelines
from skyloom.sources import camera, sinks

SF = "/root/testdata/sf0.001"


def moved(df):
    """Columns that the plan's exchanges hold."""
    said = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {c for m in re.finditer(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", said) for c in re.findall(r"(\w+)#", m[1])}


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield
    spark.conf.unset(key)


def test_folds_move_states_only(spark, no_auto_broadcast):
    found = fold.apply(schema.frames(spark, SF), fold.Motion(), ["px"])
    assert moved(found) == {"rec_id", "block", "first", "state"}


def test_pixels_stay_where_they_are(spark, tmp_path, no_auto_broadcast):
    sinks.write_recording(schema.frames(spark, SF), str(tmp_path / "r.parquet"), slices=False)
    frames = spark.read.parquet(str(tmp_path / "r.parquet"))
    found = pipelines.hourly(frames, output_hz=0.01, bin_seconds=60.0, lookahead=10)
    per = timeaxis.count_bins(timeaxis.time_range(frames), 100.0)
    plans = [found.times, found.norms, found.keograms, norm.norm(frames, 60.0), norm.pixel_histogram(frames), keogram.by_count(frames, "ew", per), keogram.rough(frames, "ns", 20, per), video.gray_frames(frames, found.norms)]
    for df in plans:
        columns = moved(df)
        assert "px" not in columns and "rec_id" in columns or df is plans[-1]
    assert not moved(plans[-1]) & {"px", "gray"}
    said = norm.pixel_histogram(frames)._jdf.queryExecution().toString()
    assert "Generate" not in said and "MapInArrow" in said


@pytest.mark.parametrize("limit", [0, 10**6])
def test_small_and_salted_joins_are_one(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
    frames = schema.frames(spark, SF)
    slim = frames.select("rec_id", "frame_idx", "ut")
    got = keogram.by_segment(frames, timeaxis.clock_hours(slim, timeaxis.hour_segments(slim), 10), "ew").collect()
    want = {}
    for x in frames.collect():
        if x.frame_idx < 499:  # the last one isn't shown
            want.setdefault((int((x.ut - 1704067200) // 3600), int(x.ut % 3600 // 60)), []).append(x.px[32:40])
    assert {(x.seg, x.bin, x.pos): x.mean for x in got} == pytest.approx({(*k, pos): np.mean([v[pos] for v in lot]) for k, lot in want.items() for pos in range(8)})
    assert norm.norm(frames, 60.0).first() == norm.limits(norm.pixel_histogram(frames.join(norm.sample_index(timeaxis.time_range(frames).selectExpr("*", "0L as s", "n - 1 as e"), 60.0), ["rec_id", "frame_idx"]))).first()


@pytest.mark.parametrize("interval", [0.01, 0.3, 1.0, 7.5, 13.0, 3000.0, 10**6])
def test_sampled_frames_by_arithmetic(spark, interval):
    frames = spark.range(97).select(F.lit("a").alias("rec_id"), F.col("id").alias("frame_idx"), (F.col("id") * 0.37).alias("ut"), F.array(F.lit(1)).alias("px"))
    ranges = spark.createDataFrame([("a", 3, 95, 1.11, 35.15)], "rec_id string, s long, e long, start double, stop double")
    want = {x.frame_idx: x["count"] for x in norm.sample_index(ranges, interval).groupBy("frame_idx").count().collect()}
    assert {x.frame_idx: x.times for x in norm.times_sampled(frames, ranges, interval).collect()} == want


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_any_range_from_the_tree(spark, leaf):
    r = random.Random(leaf)
    rows = [(rec, i, float(i), 1, 3, [r.choice([0, 5, 300, 65535]) for _ in range(3)]) for rec, n in (("a", 101), ("b", 7)) for i in range(n)]
    frames = spark.createDataFrame(rows, schema.FRAME).repartition(3)
    tree = norm.histogram_tree(frames, leaf)
    ranges = [("a", k, *sorted((r.randrange(101), r.randrange(101)))) for k in range(25)] + [("b", 0, 0, 6), ("b", 1, 3, 3), ("a", 99, 0, 100)]
    got = {}
    for x in norm.range_histograms(tree, frames, spark.createDataFrame(ranges, "rec_id string, name long, s long, e long")).collect():
        got[x.rec_id, x.name, x.v] = x.n
    want = {}
    for rec, name, s, e in ranges:
        for row in rows:
            if row[0] == rec and s <= row[1] <= e:
                for v in row[5]:
                    if v:
                        want[rec, name, v] = want.get((rec, name, v), 0) + 1
    assert got == want
    with pytest.raises(Exception, match="pixels must be 16-bit unsigned"):
        norm.pixel_histogram(frames.withColumn("px", F.array(F.lit(65536)))).collect()


def test_ranks_by_radix_selection(spark):
    r = random.Random(3)
    values = {"a": [r.uniform(-1e9, 1e9) for _ in range(200)] + [0.0, -0.0, 1e-300, -1e-300, 7.5, 7.5], "b": [1.5], "c": [0.1] * 50 + [0.1000000001] * 51}
    rows = [(rec, i, v) for rec, own in values.items() for i, v in enumerate(own)]
    ranks = [("a", k) for k in (0, 1, 100, 102, 103, 205)] + [("b", 0), ("c", 49), ("c", 50), ("c", 100)]
    df = spark.createDataFrame(rows, "rec_id string, frame_idx long, value double").repartition(4)
    found = timeaxis.select_ranks(df, spark.createDataFrame(ranks, "rec_id string, rank long"))
    assert {(x.rec_id, x["rank"]): x.value for x in found.collect()} == {(rec, k): sorted(values[rec])[k] for rec, k in ranks}


def test_lookups_read_the_zones_of_their_keys(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for rec, n in (("a/b c", 4000), ("b", 1), ("c", 900)):
        t = 1000.0
        for i in range(n):
            t += r.choice([0.0, 0.5, 0.5, 40.0 if i % 97 == 0 else 0.25])
            rows.append((rec, i, t))
    frames = spark.createDataFrame(rows, "rec_id string, frame_idx long, ut double")
    sinks.write_recording(frames.repartition(3), str(tmp_path / "r"), slices=False, group_bytes=256)
    held = zones.stored(spark, str(tmp_path / "r"))
    assert held.count() > 30 and held.agg(F.sum("n")).first()[0] == len(rows)
    assert spark.read.parquet(str(tmp_path / "r")).count() == len(rows)
    assert {tuple(x) for x in zones.time_range(held).collect()} == {tuple(x) for x in timeaxis.time_range(frames).collect()}
    times = [t for _, _, t in rows]
    keys = [(rec, r.choice([r.choice(times), r.uniform(900, max(times) + 50)]), k) for rec in ("a/b c", "b", "c", "none") for k in range(60)]
    keys = spark.createDataFrame(keys, "rec_id string, key double, nr long")
    for whole in (False, True):
        plain = lambda df: sorted(map(tuple, df.select("rec_id", "nr", "key", "idx", "at").collect()), key=repr)
        assert plain(zones.nearest(held, keys, whole, True).found) == plain(timeaxis.nearest(frames, keys, whole, True))
    few = zones.nearest(held, keys.where("rec_id = 'a/b c' and nr < 3"))
    assert few.found.count() == 3 and few.opened.agg(F.count("*")).first()[0] <= 3 and (few.opened.agg(F.sum("n")).first()[0] or 0) < 1000


def test_a_broken_recording_is_an_error_of_its_line(spark, tmp_path):
    def recording(cam, slices=True):
        rows = [(cam, i, 1704067200.0 + i * 0.1, 2, 2, [100, 200, 100, i % 7]) for i in range(400)]
        place = f"{tmp_path}/HDF/2024-01-01/{cam}/CamSer{cam}.parquet"
        frames = spark.createDataFrame(rows, schema.FRAME).repartition(4)
        if slices:  # in four files
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            sinks.write_recording(frames, place, group_bytes=1024)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        else:
            frames.write.partitionBy("rec_id").parquet(place)
        return sorted(glob.glob(f"{place}/rec_id=*/part-*.parquet"))

    for cam in "123456":
        files = recording(cam, cam != "2")
        if cam == "1":  # the first path has no readable footer
            open(files[0], "wb").write(b"no parquet")
        if cam == "4":  # pages are broken, the footer isn't
            data = bytearray(open(files[0], "rb").read())
            data[4:200] = b"\xff" * 196
            open(files[0], "wb").write(bytes(data))
        if cam == "5":
            open(files[-1], "wb").write(b"")
    sheet = spark.createDataFrame([("2024-01-01", None, c, None, None) for c in "123456"], schema.MANIFEST)
    batch.run(sheet, camera.recordings(spark, str(tmp_path)), f"{tmp_path}/out", bin_seconds=1.0)
    said = {x.cam_ser: (x.processed, x.error) for x in batch.status(spark, f"{tmp_path}/out").collect()}
    assert {c for c, x in said.items() if x[0]} == {"2", "3", "6"}
    assert "can't be read" in said["1"][1] and "frames can be read" in said["4"][1] and "frames can be read" in said["5"][1]
    keograms = spark.read.parquet(*glob.glob(f"{tmp_path}/out/runs/*/keograms"))
    bins = {x.rec_id[-9]: x["count"] for x in keograms.groupBy("rec_id").count().collect()}
    assert bins["2"] == bins["3"] == bins["6"] > 0 and len(bins) == 3


def test_any_frame_of_a_container_from_one_chunk(spark):
    from skyloom.operators import container

    r = np.random.default_rng(2)
    for n, width in ((1, 5), (9, 70_000), (4, 1)):
        frames = (r.integers(0, 256, (n, width)) * (r.random((n, width)) < 0.01)).astype(np.uint8)
        assert (container.decode(container.encode(frames), n) == frames).all()
    rows = [(rec, seg, b, bytes(r.integers(0, 256, 12).astype(np.uint8))) for rec in "ab" for seg in (0, 1) for b in range(seg, 50, 1 + seg)]
    video_frames = spark.createDataFrame(rows, "rec_id string, seg int, bin long, rgb binary").repartition(5)
    packed = container.pack(video_frames, 8).cache()
    plain = lambda df: sorted((x.rec_id, x.seg, x.bin, bytes(x.rgb)) for x in df.collect())
    assert plain(container.unpack(packed)) == sorted(rows)
    # the seek table: chunks follow each other
    for (rec, seg), lot in {k: sorted((x.chunk, x.at, x.bytes) for x in packed.collect() if (x.rec_id, x.seg) == k) for k in {x[:2] for x in rows}}.items():
        assert [at for _, at, _ in lot] == [0, *np.cumsum([n for *_, n in lot])[:-1].tolist()], (rec, seg)
    # with all chunks but one broken, that one's frames can be read
    broken = packed.withColumn("data", F.when((F.col("rec_id") == "b") & (F.col("seg") == 1) & (F.col("chunk") == 2), F.col("data")).otherwise(F.lit(b"x")))
    wanted = spark.createDataFrame([("b", 1, 17), ("b", 1, 23), ("b", 1, 18)], "rec_id string, seg int, bin long")
    assert plain(container.unpack(broken, wanted)) == [x for x in sorted(rows) if x[:3] in {("b", 1, 17), ("b", 1, 23)}]
