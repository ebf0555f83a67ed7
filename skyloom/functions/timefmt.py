"""Scalar functions on times, names and sheet cells. Times are Unix seconds in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def assert_utc(moment: datetime | None, name: str = "time") -> None:
    """Only datetimes with the offset zero are accepted."""
    if moment is not None and moment.utcoffset() != timedelta(0):
        raise ValueError(f"{name} must be in UTC and say so")


def utc(ut: Column, form: str) -> Column:
    """``ut`` in UTC, seconds truncated; built on a timestamp without zone, so that the session's zone has no say."""
    return F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(ut).cast("decimal(18,6)")), form)


def label(ut: Column) -> Column:
    return utc(ut, "yyyy-MM-dd HH:mm:ss 'UTC'")


def hour_of(ut: Column) -> Column:
    return F.floor(ut / 3600) * F.lit(3600.0)


def hours_of_day(ut: Column) -> Column:
    return F.pmod(ut, F.lit(86400.0)) / 3600


def tick_label(hours: Column) -> Column:
    """HH:MM of hours that may pass 24; minutes half-even, at most 59."""
    minutes = F.least(F.bround((hours - F.floor(hours)) * 60), F.lit(59.0))
    return F.format_string("%02d:%02d", F.pmod(F.floor(hours), F.lit(24)), minutes.cast("long"))


def to_date(cell: Column) -> Column:
    """The date of a cell, null where it is none."""
    return F.coalesce(F.try_to_timestamp(F.trim(cell), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.trim(cell), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("date")


def to_seconds(cell: Column) -> Column:
    """Seconds of the day of ``HH:MM:SS``, null for blank and for bad cells."""
    part = lambda i: F.regexp_extract(F.trim(cell), r"^([01]?\d|2[0-3]):([0-5]?\d):([0-5]?\d)$", i)
    return F.when(part(1) != "", part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int"))


def is_blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def cam_ser(cell: Column) -> Column:
    """``7196.0`` is ``7196``; other text is trimmed."""
    number = F.trim(cell).try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).otherwise(F.trim(cell))


def truthy(cell: Column) -> Column:
    """Blank and null are false, any other text (``FALSE`` too) is true."""
    return F.coalesce(cell, F.lit("")) != ""


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def camera_of(path: Column) -> Column:
    """``CamSer<digits>`` of a path's stem; fails where there is none."""
    found = F.regexp_extract(stem(path), r"CamSer\d+", 0)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no camera serial in "), path)).cast("string")).otherwise(found)
