"""Videos as chunks of coded frames, from which any frame is decoded by reading one chunk.

A chunk is so many frames of a segment in their order. Its first frame stands as it is, each other one as the difference from the one before, byte by byte; the whole
is coded in runs (length, value). Chunks are coded where they're gathered, each by itself, and have their place in the segment's stream of bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a chunk.
CHUNK = 32


def encode(frames: np.ndarray) -> bytes:
    """Runs of frames (a row of bytes each): a byte's value, and how often it comes, less one, as 16 bits."""
    flat = np.concatenate([frames[:1], frames[1:] - frames[:-1]]).reshape(-1)
    if not len(flat):
        return b""
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    lengths = np.diff(np.append(starts, len(flat)))
    pieces = -(-lengths // 65_536)
    values = np.repeat(flat[starts], pieces)
    counts = np.full(len(values), 65_536)
    counts[np.cumsum(pieces) - 1] = lengths - (pieces - 1) * 65_536
    return values.tobytes() + (counts - 1).astype("<u2").tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The ``n`` frames of a chunk."""
    runs = len(data) // 3
    flat = np.repeat(np.frombuffer(data, np.uint8, runs), np.frombuffer(data, "<u2", runs, runs).astype(np.int64) + 1)
    return np.cumsum(flat.reshape(n, -1), axis=0, dtype=np.uint8)


def pack(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """``rec_id, seg, chunk, bins, n, at, bytes, data`` of video frames (``rec_id, seg, bin, rgb``): a seek table (the chunk's bins, and where its bytes begin in the segment's
    stream) beside the chunks. Frames of a chunk have one size. A chunk's place comes from the lengths of those before, without their data."""

    def code(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("bin")
        data = encode(np.stack([np.frombuffer(x, np.uint8) for x in lot["rgb"]]))
        return pd.DataFrame({"rec_id": [lot["rec_id"].iloc[0]], "seg": [lot["seg"].iloc[0]], "chunk": [lot["chunk"].iloc[0]], "bins": [lot["bin"].to_list()], "n": [len(lot)], "bytes": [len(data)], "data": [data]})

    rows = frames.select("rec_id", "seg", "bin", "rgb", F.floor(F.col("bin") / size).alias("chunk"))
    kind = frames.schema["seg"].dataType.simpleString()
    coded = rows.groupBy("rec_id", "seg", "chunk").applyInPandas(code, f"rec_id string, seg {kind}, chunk long, bins array<long>, n long, bytes long, data binary")
    before = F.sum("bytes").over(Window.partitionBy("rec_id", "seg").orderBy("chunk")) - F.col("bytes")
    return coded.withColumn("at", before)


def unpack(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``rec_id, seg, bin, rgb`` of all frames, or of the ``wanted`` (``rec_id, seg, bin``): only chunks that hold one are decoded."""
    if wanted is not None:
        asked = wanted.join(chunks.select("rec_id", "seg", "chunk", F.explode("bins").alias("bin")), ["rec_id", "seg", "bin"]).groupBy("rec_id", "seg", "chunk").agg(F.collect_set("bin").alias("asked"))
        chunks = chunks.join(asked, ["rec_id", "seg", "chunk"])
    else:
        chunks = chunks.withColumn("asked", F.col("bins"))
    kind = chunks.schema["seg"].dataType.simpleString()

    def read(lots):
        for lot in lots:
            out = []
            for x in lot.itertuples(index=False):
                asked = set(x.asked)
                out += [(x.rec_id, x.seg, b, f.tobytes()) for b, f in zip(x.bins, decode(x.data, x.n)) if b in asked]
            yield pd.DataFrame(out, columns=["rec_id", "seg", "bin", "rgb"])

    return chunks.select("rec_id", "seg", "bins", "n", "data", "asked").mapInPandas(read, f"rec_id string, seg {kind}, bin long, rgb binary")
