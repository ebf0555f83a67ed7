"""Raw files read by byte ranges."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import schema
from skyloom.operators import timeaxis
from skyloom.plans import pipelines
from skyloom.sources import camera, raw

XML = "<a><horizpixels>6</horizpixels><vertpixels>4</vertpixels><kineticrate>0.5</kineticrate></a>"
NMEA = "$GPRMC,070000.00,A,1,N,1,W,0,0,110413,,*1\n"


def stored(folder, name, numbers, seed=0, header=4, tail=b""):
    px = np.random.default_rng(seed).integers(0, 65536, (len(numbers), 4, 6)).astype("<u2")
    at = folder / f"{name}.DMCdata"
    at.parent.mkdir(parents=True, exist_ok=True)
    heads = [np.array([n >> 16, n & 0xFFFF, 7], "<u2").tobytes()[:header] for n in numbers]
    at.write_bytes(b"".join(f.tobytes() + h for f, h in zip(px, heads)) + tail)
    at.with_suffix(".xml").write_text(XML)
    at.with_suffix(".nmea").write_text(NMEA)
    return px


NUMBERS = [*range(70_000, 70_040), *range(70_043, 70_060), *range(70_100, 70_111)]


@pytest.mark.parametrize("split", [10, 52, 53, 500, 1 << 20])
def test_ranges_are_the_whole(spark, tmp_path, split):
    px = {"a": stored(tmp_path, "a", NUMBERS, 1, tail=b"cut"), "b": stored(tmp_path / "deep" / "er", "b", range(1, 4), 2), "none": stored(tmp_path / "deep", "none", [], 3)}
    found = raw.frames(spark, str(tmp_path), split_bytes=split)
    rows = found.collect()
    assert found.rdd.getNumPartitions() == sum(max(1, -(-n // split)) for n in (68 * 52 + 3, 3 * 52, 0))
    assert len(rows) == 71
    for x in rows:
        number = NUMBERS[x.frame_idx] if x.rec_id == "a" else x.frame_idx + 1
        assert x.raw_idx == number and x.ut == 1365663600 + (number - 1) * 0.5 and x.px == px[x.rec_id][x.frame_idx].reshape(-1).tolist()
    slim = raw.frames(spark, str(tmp_path), split_bytes=split, pixels=False).collect()
    assert sorted((x.rec_id, x.frame_idx, x.raw_idx, x.ut, x.height, x.width) for x in slim) == sorted((x.rec_id, x.frame_idx, x.raw_idx, x.ut, x.height, x.width) for x in rows)
    for low, high in ((70_039, 70_043), (70_041, 70_042), (70_060, 70_200), (0, 1)):
        got = raw.frames(spark, str(tmp_path), split_bytes=split, first_raw=low, last_raw=high).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(x) for x in rows if low <= x.raw_idx <= high)
    start, stop = 1365663600 + 70_005 * 0.5, 1365663600 + 70_050 * 0.5 + 0.1
    got = raw.frames(spark, str(tmp_path), split_bytes=split, start=start, stop=stop).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(x) for x in rows if start <= x.ut <= stop)


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)

    def size(self):
        return len(self.getbuffer())


def test_a_range_reads_only_its_bytes(tmp_path, monkeypatch):
    stored(tmp_path, "a", range(70_000, 71_000), 1)
    data = (tmp_path / "a.DMCdata").read_bytes()
    seen = []

    class Store:
        def __init__(self, real):
            self.real = real

        def open_input_file(self, path):
            seen.append(Counting(data))
            return seen[-1]

        def __getattr__(self, name):
            return getattr(self.real, name)

    real = raw.opened
    monkeypatch.setattr(raw, "opened", lambda path: (Store(real(path)[0]), real(path)[1]))
    path = f"{tmp_path}/a.DMCdata"
    read = lambda start, stop, **options: sum(len(b) for b in raw.RawReader({"path": path, **options}).read(raw.Range(path, start, stop)))
    assert read(5200, 10400) == 100 and seen[-1].taken == 5200
    assert read(5201, 10401) == 100 and seen[-1].taken == 5200
    assert read(0, len(data), first_raw="70500", last_raw="70502") == 3 and seen[-1].taken < 3 * 52 + 4 * 48
    assert read(0, 5200, first_raw="70500") == 0 and seen[-1].taken < 4 * 12
    assert read(0, len(data), pixels="false") == 1000 and seen[-1].taken == 4000


def test_filters_become_bounds(spark, tmp_path):
    stored(tmp_path, "a", NUMBERS, 1)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        got = raw.frames(spark, str(tmp_path), split_bytes=200).where((F.col("raw_idx") > 70_010) & (F.col("raw_idx") <= 70_043) & (F.col("rec_id") == "a")).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(x.raw_idx for x in got) == [n for n in NUMBERS if 70_010 < n <= 70_043]
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    reader = raw.PushingReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([GreaterThan(("raw_idx",), 70_010), LessThanOrEqual(("raw_idx",), 70_043)]))) == 2
    assert reader.raw == [70_010, 70_043]


def test_bad_companions_are_named(spark, tmp_path):
    stored(tmp_path, "a", [1], 1)
    (tmp_path / "a.xml").write_text("<a><horizpixels>6</horizpixels></a>")
    with pytest.raises(Exception, match="a.DMCdata: its metadata doesn't give vert_pixels, kinetic_sec"):
        raw.frames(spark, str(tmp_path)).collect()
    assert raw.frames(spark, str(tmp_path), user={"vert_pixels": 4}, override={"kinetic_sec": 2.0}).first().ut == 1365663600
    (tmp_path / "a.nmea").unlink()
    with pytest.raises(Exception, match="a.DMCdata has no .nmea file"):
        raw.frames(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no .other file below"):
        raw.frames(spark, str(tmp_path), suffix=".other").collect()
    given = {**schema.CAMERA_DEFAULTS, "horiz_pixels": 2, "vert_pixels": 2, "kinetic_sec": None, "start_utc": 0.0}
    files = spark.createDataFrame([("/x.DMCdata", bytearray(12))], "path string, content binary").select("*", *[F.lit(given[f.name]).cast(f.dataType).alias(f.name) for f in schema.CAMERA])
    with pytest.raises(Exception, match="/x.DMCdata: its metadata doesn't give kinetic_sec"):
        camera.raw_frames(files).collect()


@pytest.mark.parametrize("block", [3, 10**6])
def test_runs_and_dropped_frames(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(timeaxis, "BLOCK", block)
    stored(tmp_path / "x", "a", NUMBERS, 1)
    stored(tmp_path, "b", [5], 2)
    pipelines.raw_to_recording(spark, str(tmp_path), f"{tmp_path}/rec.parquet", split_bytes=300)
    assert spark.read.parquet(f"{tmp_path}/rec.parquet").count() == 69
    found = timeaxis.runs(raw.frames(spark, str(tmp_path), pixels=False).repartition(4))
    assert sorted(map(tuple, found.collect())) == [("a", 0, 70_000, 70_039, 40), ("a", 1, 70_043, 70_059, 17), ("a", 2, 70_100, 70_110, 11), ("b", 0, 5, 5, 1)]
    assert sorted(map(tuple, timeaxis.dropped(found).collect())) == [("a", 70_039, 3), ("a", 70_059, 40)]
    stored(tmp_path / "y", "a", [9], 2)
    with pytest.raises(ValueError, match="2 raw files are named a"):
        pipelines.raw_to_recording(spark, str(tmp_path), f"{tmp_path}/other.parquet")
