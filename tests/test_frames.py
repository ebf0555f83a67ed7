"""Frame queries against DuckDB, guards, and the same result whatever the partitions."""

import bisect
import glob
import os

import duckdb
import pytest

from skyloom import queries, schema
from skyloom.functions import timefmt
from skyloom.operators import fold, keogram, norm, timeaxis
from skyloom.plans import pipelines
from skyloom.sources import camera, sinks
from skyloom.streaming import keograms

SF = "/root/testdata/sf0.001"


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_oracle(spark, duck, name):
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(plain([r[c] for c in names])) for r in df.collect()) == sorted(repr(plain(list(r))) for r in found.fetchall())


@pytest.mark.parametrize("block", [1_000_000, 2, 1])
def test_nearest_ties_and_ends(spark, monkeypatch, block):
    monkeypatch.setattr(timeaxis, "BLOCK", block)
    ut = [1.0, 1.0, 3.0, 3.0, 5.0]
    frames = spark.createDataFrame([("a", i, t) for i, t in enumerate(ut)], "rec_id string, frame_idx long, ut double")
    keys = spark.createDataFrame([("a", k) for k in (0.0, 1.0, 2.0, 2.5, 3.0, 4.0, 9.0)] + [("b", 1.0)], "rec_id string, key double")
    got = {(r.rec_id, r.key): r.idx for r in timeaxis.nearest(frames, keys).collect()}
    assert [got["a", k] for k in (0.0, 1.0, 2.0, 2.5, 3.0, 4.0, 9.0)] == [0, 0, 1, 2, 2, 3, 4] and got["b", 1.0] == 0


@pytest.mark.parametrize("block", [1_000_000, 17])
def test_every_tick_is_looked_up(spark, monkeypatch, block):
    monkeypatch.setattr(timeaxis, "BLOCK", block)
    axes = {}
    for r in schema.ticks(spark, SF).collect():
        axes.setdefault(r.rec_id, {})[r.frame_idx] = r.ut
    want = {}
    for rec, axis in axes.items():
        ut = [axis[i] for i in range(len(axis))]
        for asked, t in enumerate(ut):
            key = t + (asked % 7) * 60.5 - 100
            at = bisect.bisect_left(ut, key)
            want[rec, asked] = 0 if at == 0 else len(ut) - 1 if at == len(ut) else at - 1 if abs(ut[at - 1] - key) <= abs(ut[at] - key) else at
    got = queries.QUERIES["nearest_frame"](spark, SF).collect()
    assert len(got) == len(want) and {(r.rec_id, r.asked): r.idx for r in got} == want


def test_blocks_and_partitions(spark, monkeypatch):
    frames = schema.frames(spark, SF)
    whole = sorted(tuple(r) for r in timeaxis.differences(frames).collect())
    monkeypatch.setattr(timeaxis, "BLOCK", 7)
    assert sorted(tuple(r) for r in timeaxis.differences(frames.repartition(16)).collect()) == whole and len(whole) == frames.count() - 1


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        pipelines.hourly(schema.frames(spark, SF), output_hz=1.0)
    with pytest.raises(ValueError):
        timeaxis.hour_bins(None)
    with pytest.raises(ValueError):
        keogram.rough(schema.frames(spark, SF), "ew", 5, spark.createDataFrame([("sky", 5)], "rec_id string, frames_per_bin long"))
    with pytest.raises(ValueError):
        timeaxis.parameters(schema.frames(spark, SF), speed=1.0)
    dark = spark.createDataFrame([("a", 0, 0.0, 1, 2, [0, 0]), ("a", 1, 9.0, 1, 2, [0, 0])], schema.FRAME)
    with pytest.raises(ValueError):
        norm.require(norm.norm(dark, 1.0))
    with pytest.raises(ValueError):
        timefmt.assert_utc(__import__("datetime").datetime(2024, 1, 1))
    with pytest.raises(FileNotFoundError):
        camera.single(spark.createDataFrame([], "path string"))
    assert sinks.png([b"\0\1", b"\2\3"]).startswith(b"\x89PNG")
    sinks.write_recording(dark, f"{tmp_path}/rec")
    assert spark.read.parquet(f"{tmp_path}/rec").count() == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_recording(dark, f"{tmp_path}/rec")
    with pytest.raises(Exception, match="16-bit"):
        norm.pixel_histogram(spark.createDataFrame([("a", 0, 0.0, 1, 1, [70_000])], schema.FRAME)).count()


def test_stored_slices_are_read_without_pixels(spark, tmp_path, capsys):
    frames = schema.frames(spark, SF)
    sinks.write_recording(frames, f"{tmp_path}/rec.parquet")
    stored = camera.frame_table(spark, f"{tmp_path}/rec.parquet")
    for axis in ("ew", "ns"):
        found = keogram.by_hour(stored, axis)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, keogram.by_hour(frames, axis).collect()))
        found.explain("formatted")
        (schema_read,) = [x for x in capsys.readouterr().out.split("\n") if x.startswith("ReadSchema")]
        assert axis in schema_read and "px:" not in schema_read


def test_exact_median_of_differences(spark):
    import random
    import statistics

    r = random.Random(1)
    axes = {"a": [1.0] * 300 + [r.random() for _ in range(300)], "b": [r.expovariate(1) for _ in range(5000)], "c": [2.0], "d": [r.choice([0.5, 1.0]) for _ in range(4000)], "e": [1.0, 3.0]}
    rows = []
    for name, steps in axes.items():
        t = 0.0
        for i, step in enumerate([0.0, *steps]):
            t += step
            rows.append((name, i, t))
    times = {n: [t for m, _, t in rows if m == n] for n in axes}
    want = {n: statistics.median(b - a for a, b in zip(t, t[1:])) for n, t in times.items()}
    got = {x.rec_id: x.dt for x in timeaxis.native_dt(spark.createDataFrame(rows, "rec_id string, frame_idx long, ut double")).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_hour_bins():
    assert timeaxis.hour_bins(None, 7.5) == 480 and timeaxis.hour_bins(7.0) == 515


def test_videos_are_written_by_segment(spark, tmp_path):
    found = pipelines.videos(schema.frames(spark, SF), bin_size=5, speed=15.0)
    sinks.write_video(found.video(), f"{tmp_path}/video")
    rows = spark.read.parquet(f"{tmp_path}/video").collect()
    assert len(rows) == found.times.count() and all(len(x.rgb) == 192 and x.rgb[0] == x.rgb[1] == x.rgb[2] for x in rows)
    assert len(glob.glob(f"{tmp_path}/video/rec_id=sky/seg=*")) == len({x.seg for x in rows})


def test_parameters_per_recording(spark):
    dts = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 3.0)], "rec_id string, dt double")
    got = {x.rec_id: x for x in timeaxis.parameters(dts, speed=15.0, size=5, hz=1.0).collect()}
    assert {n: (x.stride, x.fps, x.bin_size, x.problem is None) for n, x in got.items()} == {"a": (10, 15.0, 5, True), "b": (2, 15.0, 5, False), "c": (1, 15.0, 5, False)}
    assert {x.rec_id: x.speed for x in timeaxis.parameters(dts, rate=30.0, size=5).collect()} == pytest.approx({"a": 15.0, "b": 75.0, "c": 450.0})
    got = {x.rec_id: x.bin_size for x in timeaxis.parameters(dts, speed=15.0, rate=10.0).collect()}
    assert got == {n: max(1, round(15 / (10 * dt))) for n, dt in (("a", 0.1), ("b", 0.5), ("c", 3.0))}


@pytest.mark.parametrize("rot, transpose, ud, lr, header", [(0, False, False, False, 4), (90, True, False, True, 4), (270, False, True, False, 0), (180, True, True, True, 6)])
def test_raw_files_become_a_recording(spark, tmp_path, rot, transpose, ud, lr, header):
    import numpy as np

    r = np.random.default_rng(rot)
    px = r.integers(0, 65536, (7, 4, 6)).astype("<u2")
    first = 402_209
    for name in ("one", "two"):
        heads = [np.array([(first + i) >> 16, (first + i) & 0xFFFF, 9], "<u2").tobytes()[:header] for i in range(7)]
        (tmp_path / f"{name}.DMCdata").write_bytes(b"".join(f.tobytes() + h for f, h in zip(px, heads)) + b"cut")
        (tmp_path / f"{name}.xml").write_text("<a><horizpixels>12</horizpixels><vertpixels> 8 </vertpixels><binning>2</binning><kineticrate>0.25</kineticrate></a>")
        (tmp_path / f"{name}.nmea").write_text("$GPRMC,bad\n$GPRMC,070000.00,A,1,N,1,W,0,0,110413,,*1\n")
    user = {"header_bytes": header, "rot_ccw": rot, "transpose": transpose, "flip_ud": ud, "flip_lr": lr, "kinetic_sec": 99.0}
    said = pipelines.raw_to_recording(spark, str(tmp_path), f"{tmp_path}/rec.parquet", user, {"start_utc": 1000.0})
    begin = first if header >= 4 else 1
    assert sorted(map(tuple, said.collect())) == [(n, begin, begin + 6, 7) for n in ("one", "two")]
    want = px.transpose(0, 2, 1) if transpose else px
    want = np.rot90(want, rot // 90, axes=(1, 2))
    want = want[:, ::-1] if ud else want
    want = want[:, :, ::-1] if lr else want
    for x in camera.frame_table(spark, f"{tmp_path}/rec.parquet").where("rec_id = 'two'").collect():
        assert (x.height, x.width) == want.shape[1:] and x.px == want[x.frame_idx].reshape(-1).tolist() and x.ut == 1000.0 + (begin + x.frame_idx - 1) * 0.25
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        pipelines.raw_to_recording(spark, str(tmp_path), f"{tmp_path}/rec.parquet", user)
    (tmp_path / "one.nmea").unlink()
    with pytest.raises(FileNotFoundError):
        pipelines.raw_to_recording(spark, str(tmp_path), f"{tmp_path}/other.parquet", user)


def test_companions_listing_and_volume(spark, tmp_path):
    for name in ("a/x.h5", "a/output/y.h5", "b/output/c/z.h5", "b/w.h5", "b/w.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    stems = lambda df: {x.path.split("/")[-1] for x in df.collect()}
    assert stems(camera.listing(spark, str(tmp_path))) == {"x.h5", "y.h5", "z.h5", "w.h5"}
    assert stems(camera.listing(spark, str(tmp_path), prune=["output"])) == {"x.h5", "w.h5"}
    names = spark.createDataFrame([("DATA One",), ("other",), ("One more",)], "name string")
    assert camera.volume(names, "data") == "DATA One"
    for bad, error in (("one", ValueError), ("none", FileNotFoundError)):
        with pytest.raises(error):
            camera.volume(names, bad)
    files = spark.createDataFrame([("/a.DMCdata",), ("/a.xml",), ("/a.nmea",), ("/b.DMCdata",), ("/b.xml",)], "path string")
    assert [tuple(x) for x in camera.missing_companions(files).collect()] == [("/b.DMCdata", ".nmea")]


def test_batch_runs_retries_and_says_what_failed(spark, tmp_path):
    from skyloom.plans import __main__ as cli
    from skyloom.plans import batch

    def recording(day, cam, step=0.1, level=100, n=200):
        rows = [(f"{day}-{cam}", i, 1704067200.0 + i * step, 2, 2, [level, level * 2, level, level]) for i in range(n)]
        sinks.write_recording(spark.createDataFrame(rows, schema.FRAME), f"{tmp_path}/HDF/{day}/{cam}/CamSer{cam}.parquet")

    recording("2024-01-01", "1")
    recording("2024-01-01", "2", level=0)
    recording("2024-01-01", "3", step=30.0)
    sheet = tmp_path / "sheet.csv"
    lines = ["2024-01-01,,1", "2024-01-01,00:00:05,1.0", "2024-01-01,,2", "2024-01-01,,3", "2024-01-01,,4", "not a day,,1", "2024-01-01,noon,1", "2024-01-02,,9"]
    sheet.write_text("\n".join(["date,start_time,cam_ser,processed,error", *[f"{x},,old error" for x in lines], "2024-01-01,,5,yes,"]) + "\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    old = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    __import__("time").tzset()
    try:
        cli.main(str(sheet), str(tmp_path), f"{tmp_path}/out")
        said = {(x.date, x.start_time, x.cam_ser): (x.processed, x.error) for x in batch.status(spark, f"{tmp_path}/out").collect()}
        assert said == {
            ("2024-01-01", None, "1"): (True, ""), ("2024-01-01", "00:00:05", "1.0"): (True, ""), ("2024-01-01", None, "2"): (False, "no pixel above zero in the sampled frames"),
            ("2024-01-01", None, "3"): (False, "a bin must not be larger than the stride"), ("2024-01-01", None, "4"): (False, "no file"), ("not a day", None, "1"): (False, "bad date"),
            ("2024-01-01", "noon", "1"): (False, "bad time"), ("2024-01-02", None, "9"): (False, "no file"),
        }
        recording("2024-01-02", "9")
        cli.main(str(sheet), str(tmp_path), f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        os.environ.pop("TZ") if old is None else os.environ.update(TZ=old)
        __import__("time").tzset()
    said = {(x.date, x.start_time, x.cam_ser): x.processed for x in batch.status(spark, f"{tmp_path}/out").collect()}
    assert len(said) == 8 and {k for k, v in said.items() if v} == {("2024-01-01", None, "1"), ("2024-01-01", "00:00:05", "1.0"), ("2024-01-02", None, "9")}
    times = spark.read.parquet(*glob.glob(f"{tmp_path}/out/runs/*/times"))
    # what is processed isn't run again: 199 frames up to the last, five of each ten in a bin
    assert {(x.rec_id.split("HDF/")[1], x["count"]) for x in times.groupBy("rec_id").count().collect()} == {(f"{d}/CamSer{d[-1]}.parquet", 20) for d in ("2024-01-01/1", "2024-01-02/9")}


def test_a_fold_is_the_same_in_blocks(spark):
    frames = schema.frames(spark, SF)
    whole = fold.apply(frames, fold.Motion(), ["px"]).collect()
    for block in (1, 7):
        got = fold.apply(frames.repartition(5), fold.Motion(), ["px"], block).collect()
        assert [(x.rec_id, x.n) for x in got] == [(x.rec_id, x.n) for x in whole] and got[0].motion == pytest.approx(whole[0].motion)
    one = fold.apply(frames.where("frame_idx = 0"), fold.Motion()).first()
    assert one.n == 1 and one.motion is None


def test_stream_with_watermark_emits_closed_bins(spark, tmp_path):
    frames = schema.frames(spark, SF)
    for i in range(3):
        frames.where(f"frame_idx div 200 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = keograms.run_to_end(keograms.means(stream, "ew", late="10 minutes", span=1800.0), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    want = {(x.rec_id, x.hour + 60 * x.bin, x.pos): x.mean for x in keogram.by_hour(frames, "ew", span=1800.0).collect()}
    got = {(x.rec_id, x.start, x.pos): x.mean for x in out.collect()}
    assert 0 < len(got) <= len(want) and all(want[k] == pytest.approx(v) for k, v in got.items())
