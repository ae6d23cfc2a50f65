"""Typed identifiers, timetable years and option values."""

from __future__ import annotations

import calendar
import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_public_id(c: Column) -> Column:
    """Opaque text, not empty and without a NUL."""
    return (c != "") & ~c.contains("\0")


def is_line(c: Column) -> Column:
    """Six digits and nothing after them, not even a line end."""
    return c.rlike(r"^[0-9]{6}\z")


def is_trip_number(c: Column) -> Column:
    return c >= 0


def is_train_number(c: Column) -> Column:
    return c > 0


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def first_md5(c: Column) -> Column:
    """The first run of 32 hexadecimal digits, in lower case; empty without one."""
    return F.lower(F.regexp_extract(c, r"(?i)(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])", 1))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def date_prefix(c: Column) -> Column:
    """The first ten characters, as text: the date of a longer time; null without any."""
    return F.substring(F.nullif(c, F.lit("")), 1, 10)


def year_of(instant: Column, zone: str = "Europe/Prague") -> Column:
    """The timetable year of an instant (a timestamp of a UTC session), by the local day."""
    day = F.from_utc_timestamp(instant, zone).cast("date")
    return F.year(day) + (day >= timetable_change(F.year(day))).cast("int")


def checked(kind: str, value: object) -> object:
    """The value of a public_id, line, trip_number or train_number; another type, a truth value too, or a value out of its range is an error."""
    fine = {
        "public_id": lambda v: isinstance(v, str) and v != "" and "\0" not in v,
        "line": lambda v: isinstance(v, str) and re.fullmatch("[0-9]{6}", v) is not None,
        "trip_number": lambda v: type(v) is int and v >= 0,
        "train_number": lambda v: type(v) is int and v > 0,
    }
    if not fine[kind](value):
        raise ValueError(f"{value!r} is no {kind}")
    return value


def timetable_change(year: Column) -> Column:
    """The second Sunday of December, when a new timetable year begins."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(11), F.lit(30)), "SUN"), 7)


def second_sunday(year: int) -> datetime.date:
    first = datetime.date(year, 12, 1)
    return first + datetime.timedelta(days=(calendar.SUNDAY - first.weekday()) % 7 + 7)


def timetable_year(year: int, month: int, day: int) -> int:
    """The timetable year of a local day."""
    today = datetime.date(year, month, day)
    return year + (today >= second_sunday(year))


def jobs(value: str) -> int | str:
    """``auto`` or a number from 1."""
    if value == "auto":
        return value
    if not re.fullmatch("[1-9][0-9]*", value):
        raise ValueError(f"{value!r} is neither auto nor a number of jobs")
    return int(value)


def memory(value: str) -> int:
    """Bytes of ``10GiB`` and the like."""
    m = re.fullmatch("([1-9][0-9]*)(KiB|MiB|GiB|TiB)", value)
    if not m:
        raise ValueError(f"{value!r} is no amount of memory")
    return int(m[1]) << {"KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40}[m[2]]
