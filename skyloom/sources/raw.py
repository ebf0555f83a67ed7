"""Raw camera files as a Spark data source that cuts each file into byte ranges.

``spark.read.format("camera_raw").load(folder)`` has a row for each frame of the raw files below a folder, however deep, after
``spark.dataSource.register(RawSource)`` (``frames`` does both). A file of any size is read by as many tasks as it has ranges: a frame belongs to
the range in which its first byte lies, so that nothing has to be known of a file to plan it but its length. A task reads the
file's companions, then its frames in lots of a bounded size.

A frame is its pixels, then its header, which holds its raw number if it has four bytes or more. Raw numbers ascend in a file, so that with bounds
(``first_raw``, ``last_raw``, or ``start``, ``stop`` in Unix seconds, both ends in) a task finds the frames it needs by bisection over the headers of its range and
reads no pixels of others. The bounds are options, and filters on ``raw_idx`` and ``ut`` become such bounds where the session pushes filters to
Python sources. With ``pixels`` false only headers are read and ``px`` is null.

Files without a companion, and those whose companions don't give what has no default, fail with their name.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from skyloom import schema

SUFFIX = ".DMCdata"
COLUMNS = "rec_id string, path string, frame_idx long, raw_idx long, ut double, height int, width int, px array<int>"
XML_TAGS = {"horiz_pixels": "horizpixels", "vert_pixels": "vertpixels", "binning": "binning", "kinetic_sec": "kineticrate"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's store, and the path in it, whatever characters it has."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):/*([^/]*)(.*)", path, re.S)
    if not m or m[1] == "file":
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    store, base = pafs.FileSystem.from_uri(f"{m[1]}://{m[2]}/")
    return store, f"{base.rstrip('/')}/{m[3].lstrip('/')}"


def companion_params(xml: str, nmea: str) -> dict:
    """What the texts beside a raw file say, as ``camera.xml_params`` and ``camera.nmea_start`` read them."""
    said = {}
    for name, tag in XML_TAGS.items():
        if m := re.search(rf"<{tag}[^>]*>\s*([-+.\deE]+)\s*</{tag}>", xml):
            said[name] = float(m[1]) if name == "kinetic_sec" else int(float(m[1]))
    for line in re.split("\r?\n", nmea):
        parts = line.split(",")
        if re.match(r"\$GPRMC,\d{6}", line) and len(parts) > 9 and parts[2] == "A":
            with contextlib.suppress(ValueError):
                said["start_utc"] = datetime.strptime(parts[9] + parts[1][:6], "%d%m%y%H%M%S").replace(tzinfo=timezone.utc).timestamp()
            break
    return said


def with_defaults(path: str, said: dict, user: dict, override: dict) -> dict:
    """All of ``schema.CAMERA``; fails where something is missing."""
    found = {**schema.CAMERA_DEFAULTS, **user, **said, **override}
    if missing := [c for c in schema.CAMERA.names if found.get(c) is None]:
        raise ValueError(f"{path}: its metadata doesn't give {', '.join(missing)}")
    return found


def frame_shape(params: dict) -> tuple[int, int, int]:
    """Height and width as stored, and the bytes of a frame."""
    h, w = params["vert_pixels"] // params["binning"], params["horiz_pixels"] // params["binning"]
    return h, w, 2 * h * w + params["header_bytes"]


def raw_numbers(heads: np.ndarray, first_idx: int) -> np.ndarray:
    """Of headers (a row of bytes each): two 16-bit words, the high one first; frames without such are numbered from 1."""
    if heads.shape[1] < 4:
        return first_idx + 1 + np.arange(len(heads))
    words = np.ascontiguousarray(heads[:, :4]).view("<u2").astype(np.int64)
    return words[:, 0] << 16 | words[:, 1]


def batch_of(rec_id: str, path: str, frames: np.ndarray, first_idx: int, params: dict) -> pa.RecordBatch:
    """Rows of whole frames (bytes), turned as asked for."""
    h, w, _ = frame_shape(params)
    raw = raw_numbers(frames[:, 2 * h * w :], first_idx)
    px = np.ascontiguousarray(frames[:, : 2 * h * w]).view("<u2").reshape(-1, h, w).astype(np.int32)
    if params["transpose"]:
        px = px.transpose(0, 2, 1)
    px = np.rot90(px, params["rot_ccw"] // 90, axes=(1, 2))
    px = px[:, ::-1] if params["flip_ud"] else px
    px = px[:, :, ::-1] if params["flip_lr"] else px
    n, height, width = px.shape
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (height * width), np.ascontiguousarray(px).reshape(-1))
    return _rows(rec_id, path, first_idx + np.arange(n), raw, height, width, lists, params)


def _rows(rec_id: str, path: str, idx: np.ndarray, raw: np.ndarray, height: int, width: int, px: pa.Array, params: dict) -> pa.RecordBatch:
    n, ut = len(idx), params["start_utc"] + (raw - 1) * params["kinetic_sec"]
    columns = {"rec_id": pa.array([rec_id] * n, pa.string()), "path": pa.array([path] * n, pa.string()), "frame_idx": pa.array(idx, pa.int64()), "raw_idx": pa.array(raw, pa.int64()), "ut": pa.array(ut, pa.float64())}
    columns |= {"height": pa.array([height] * n, pa.int32()), "width": pa.array([width] * n, pa.int32()), "px": px}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Range(InputPartition):
    """Bytes from ``start`` to before ``stop`` of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RawSource(DataSource):
    """Options: ``path`` (or ``paths``, a JSON list), ``suffix``, ``split_bytes``, ``lot_bytes``, ``pixels``, ``first_raw``, ``last_raw``, ``start``, ``stop``, ``push`` (whether the session pushes filters), and
    ``user`` and ``override`` (JSON), which the companions go over and which goes over them."""

    @classmethod
    def name(cls) -> str:
        return "camera_raw"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> RawReader:
        return (PushingReader if self.options.get("push") == "true" else RawReader)(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options):
        given = lambda name, kind: None if options.get(name) is None else kind(options[name])
        self.paths = json.loads(options.get("paths") or "[]") or [options["path"]]
        self.suffix, self.split, self.lot = options.get("suffix", SUFFIX), int(options.get("split_bytes", 64 << 20)), int(options.get("lot_bytes", 8 << 20))
        self.pixels = str(options.get("pixels", "true")).lower() != "false"
        self.user, self.override = (json.loads(options.get(c) or "{}") for c in ("user", "override"))
        self.raw, self.ut = [given("first_raw", int), given("last_raw", int)], [given("start", float), given("stop", float)]

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            store, at = opened(path)
            prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
            found = store.get_file_info(at)
            every = store.get_file_info(pafs.FileSelector(at, recursive=True)) if found.type == pafs.FileType.Directory else [found]
            for info in sorted(every, key=lambda x: x.path):
                if info.type == pafs.FileType.File and info.path.endswith(self.suffix):
                    out += [Range(prefix + info.path, s, min(s + self.split, info.size)) for s in range(0, max(1, info.size), self.split)]
        if not out:
            raise FileNotFoundError(f"no {self.suffix} file below {', '.join(self.paths)}")
        return out

    def _params(self, store: pafs.FileSystem, path: str) -> dict:
        said = []
        for end in (".xml", ".nmea"):
            at = path[: len(path) - len(self.suffix)] + end
            if store.get_file_info(at).type != pafs.FileType.File:
                raise FileNotFoundError(f"{path} has no {end} file")
            with store.open_input_stream(at) as text:
                said.append(text.read().decode(errors="replace"))
        return with_defaults(path, companion_params(*said), self.user, self.override)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = opened(partition.path)
        params = self._params(store, path)
        h, w, size = frame_shape(params)
        rec_id = re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
        with store.open_input_file(path) as data:
            # whole frames that begin in the range
            first, end = -(-partition.start // size), min(-(-partition.stop // size), data.size() // size)
            head = min(params["header_bytes"], 4)

            def number(i: int) -> int:
                if head < 4:
                    return i + 1
                data.seek(i * size + 2 * h * w)
                return int(raw_numbers(np.frombuffer(data.read(head), np.uint8)[None], i)[0])

            def below(limit, strictly: bool) -> int:
                """The first frame of the range whose raw number isn't below the limit (beyond it, unless strictly)."""
                low, high = first, end
                while low < high:
                    mid = (low + high) // 2
                    if number(mid) < limit or not strictly and number(mid) == limit:
                        low = mid + 1
                    else:
                        high = mid
                return low

            step = params["kinetic_sec"]
            low = [x for x in (self.raw[0], None if self.ut[0] is None else int(np.floor((self.ut[0] - params["start_utc"]) / step))) if x is not None]
            high = [x for x in (self.raw[1], None if self.ut[1] is None else int(np.ceil((self.ut[1] - params["start_utc"]) / step)) + 2) if x is not None]
            if first < end and low:
                first = below(max(low), True)
            if first < end and high:
                end = below(min(high), False)
            per = max(1, self.lot // (size if self.pixels else 64))
            for s in range(first, end, per):
                n = min(per, end - s)
                if self.pixels:
                    data.seek(s * size)
                    batch = batch_of(rec_id, partition.path, np.frombuffer(data.read(n * size), np.uint8).reshape(n, size), s, params)
                else:
                    raw, turned = np.array([number(i) for i in range(s, s + n)], np.int64), (params["rot_ccw"] // 90 + params["transpose"]) % 2 == 1
                    batch = _rows(rec_id, partition.path, np.arange(s, s + n), raw, w if turned else h, h if turned else w, pa.nulls(n, pa.list_(pa.int32())), params)
                yield self._within(batch)

    def _within(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Without what the bounds leave out: of times they're exact here only."""
        kept = np.ones(len(batch), bool)
        for column, (low, high) in (("raw_idx", self.raw), ("ut", self.ut)):
            values = batch.column(column).to_numpy()
            kept &= (values >= low if low is not None else True) & (values <= high if high is not None else True)
        return batch if kept.all() else batch.filter(pa.array(kept))


class PushingReader(RawReader):
    """For sessions that push filters to Python sources; Spark rejects such readers in others."""

    def pushFilters(self, filters) -> Iterator:
        """Bounds by the filters; Spark applies them again, so that a strict one may let its end through."""
        for f in filters:
            bounds = {("raw_idx",): self.raw, ("ut",): self.ut}.get(getattr(f, "attribute", None))
            if bounds is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                bounds[0] = f.value if bounds[0] is None else max(bounds[0], f.value)
            if bounds is not None and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bounds[1] = f.value if bounds[1] is None else min(bounds[1], f.value)
            yield f


def frames(spark: SparkSession, *paths: str, user: dict | None = None, override: dict | None = None, **options) -> DataFrame:
    """Frames of all raw files below ``paths``. Options as ``RawSource`` has them."""
    spark.dataSource.register(RawSource)
    given = {k: str(v) for k, v in options.items() if v is not None} | {"push": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("camera_raw").options(paths=json.dumps(paths), user=json.dumps(user or {}), override=json.dumps(override or {}), **given).load()


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """``path, size`` of files (``path`` below the folder, ``content`` binary) that tasks write; one that is there is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = opened(f"{folder}/{path.lstrip('/')}")
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")
