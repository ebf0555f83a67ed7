"""Aggregates over a recording's frames in their order, which users can add.

An aggregate is an object like ``Fold``. Frames are folded where they are, batch by batch: each stretch of a batch whose frames follow each other becomes a state,
and only states are moved, to be merged in their order. A state is anything that pickles, and small. A recording that is stored in its order gives a state for each batch; one
that isn't gives more. States are merged by blocks of ``BLOCK`` frames first, so that a long recording isn't one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 100_000


class Fold(Protocol):
    #: Columns of a result, as a schema string.
    schema: str

    def start(self) -> Any:
        """The state before any frame."""

    def update(self, state: Any, frame: Any) -> Any:
        """The state after one more frame (a named tuple of the frame's columns, ``px`` an array)."""

    def merge(self, left: Any, right: Any) -> Any:
        """The state after the frames of both, of which ``left``'s come first."""

    def finish(self, state: Any) -> dict:
        """The result."""


def apply(frames: DataFrame, fold: Fold, columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``rec_id`` and the fold's columns, a row for each recording. Only ``columns`` (all by default) are read beside the frames' numbers."""
    kept = ["rec_id", "frame_idx", *[c for c in columns or frames.columns if c not in ("rec_id", "frame_idx")]]

    def part(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            out, state, last = [], None, None
            for frame in lot.sort_values(["rec_id", "frame_idx"]).itertuples(index=False):
                at = (frame.rec_id, frame.frame_idx)
                if last is None or at != (last[0], last[1] + 1) or frame.frame_idx % block == 0:
                    if last is not None:
                        out[-1] += (pickle.dumps(state),)
                    out.append((frame.rec_id, int(frame.frame_idx // block), int(frame.frame_idx)))
                    state = fold.start()
                state, last = fold.update(state, frame), at
            if last is not None:
                out[-1] += (pickle.dumps(state),)
            yield pd.DataFrame(out, columns=["rec_id", "block", "first", "state"])

    def merged(lot: pd.DataFrame, order: str):
        state = fold.start()
        for data in lot.sort_values(order)["state"]:
            state = fold.merge(state, pickle.loads(data))
        return state

    def whole_block(lot: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rec_id": [lot["rec_id"].iloc[0]], "block": [int(lot["block"].iloc[0])], "state": [pickle.dumps(merged(lot, "first"))]})

    def whole(lot: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"rec_id": lot["rec_id"].iloc[0], **fold.finish(merged(lot, "block"))}])

    parts = frames.select(*kept).mapInPandas(part, "rec_id string, block long, first long, state binary")
    states = parts.groupBy("rec_id", "block").applyInPandas(whole_block, "rec_id string, block long, state binary")
    return states.groupBy("rec_id").applyInPandas(whole, f"rec_id string, {fold.schema}")


class Motion:
    """``n long, motion double``: frames, and the mean absolute difference of the brightness of consecutive ones (null for one frame)."""

    schema = "n long, motion double"

    def start(self):
        return 0, 0.0, None, None  # frames, sum of differences, first and last brightness

    def update(self, state, frame):
        mean = float(frame.px.mean())
        return self.merge(state, (1, 0.0, mean, mean))

    def merge(self, left, right):
        if not left[0] or not right[0]:
            return left if left[0] else right
        return left[0] + right[0], left[1] + right[1] + abs(right[2] - left[3]), left[2], right[3]

    def finish(self, state):
        return {"n": state[0], "motion": state[1] / (state[0] - 1) if state[0] > 1 else None}
