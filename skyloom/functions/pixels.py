"""Scalar functions on pixel arrays (row-major ``px``): inside the JVM, but for those that make binary, which pack a batch's arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def centre_column(px: Column, height: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.get(px, (y * width + F.floor(width / 2)).cast("int")))


def centre_row(px: Column, height: Column, width: Column) -> Column:
    return F.slice(px, (F.floor(height / 2) * width + 1).cast("int"), width)


def pixel_sum(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("long"), lambda a, v: a + v)


def normalise(v: Column, vmin: Column, vmax: Column, kind: str = "log") -> Column:
    """0 to 1 between the limits; equal limits give 0, and values that have no logarithm null."""
    if kind == "log":
        scaled = (F.ln(v) - F.ln(vmin)) / F.nullif(F.ln(vmax) - F.ln(vmin), F.lit(0.0))
        return F.when(v > 0, F.coalesce(scaled, F.lit(0.0)))
    return F.coalesce((v - vmin) / F.nullif((vmax - vmin).cast("double"), F.lit(0.0)), F.lit(0.0))


def gray(level: Column) -> Column:
    """The gray value 0 to 255 of a normalised one; null (bad) is black."""
    return F.coalesce(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(level * 256).cast("int"))), F.lit(0))


def rgb(levels: Column) -> Column:
    """Red, green and blue of gray levels, one after the other: a level's share of 1 times 255, truncated."""
    byte = lambda v: (v / F.lit(255.0) * 255).cast("int")
    return F.flatten(F.transform(levels, lambda v: F.array(byte(v), byte(v), byte(v))))


@F.pandas_udf(BinaryType())
def as_bytes(values: pd.Series) -> pd.Series:
    """Binary of values from 0 to 255."""
    return values.map(lambda v: v.astype(np.uint8).tobytes(), na_action="ignore")


@F.pandas_udf(BinaryType())
def as_unsigned_16(px: pd.Series) -> pd.Series:
    """Binary of little-endian 16-bit values."""
    return px.map(lambda v: v.astype("<u2").tobytes(), na_action="ignore")


def checked(px: Column) -> Column:
    """``px``, failing where a value isn't an unsigned 16-bit one."""
    return F.when(F.forall(px, lambda v: v.between(0, 65535)), px).otherwise(F.raise_error(F.lit("pixels must be 16-bit unsigned")).cast("array<int>"))
