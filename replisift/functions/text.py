"""Texts for people: sizes, durations, names of conflict copies, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RECEIVE_ONLY, SEND_ONLY, SEND_RECEIVE
from .paths import split_extension

# Fixed values.
MODES = {"sendreceive": SEND_RECEIVE, "sendonly": SEND_ONLY, "receiveonly": RECEIVE_ONLY}
DISK_EPOCH = 252460800  # 1978-01-01
NO_READ, NO_WRITE, NO_EXECUTE, NO_DELETE = 8, 4, 2, 1


def format_size(size: Column) -> Column:
    """``512 B``, ``1.5 KB``: units of 1024, one decimal, cut off; a unit is left from 1 MiB in it, down to GB."""
    b = size.cast("long")
    out = None
    for u, (this, upper) in enumerate([("B", "KB"), ("KB", "MB"), ("MB", "GB"), ("GB", "TB")]):
        x = F.shiftright(b, 10 * u)
        text = F.when(
            x >= 1024, F.concat(F.shiftright(x, 10).cast("string"), F.lit("."), F.floor(x.bitwiseAND(F.lit(1023)) * 10 / 1024).cast("string"), F.lit(f" {upper}"))
        ).otherwise(F.concat(x.cast("string"), F.lit(f" {this}")))
        if u == 3:
            return out.otherwise(text)
        out = F.when(x < 1 << 20, text) if out is None else out.when(x < 1 << 20, text)
    return out


def format_duration(minutes: Column) -> Column:
    """``3m``, ``4h 36m``, ``2d 5h``."""
    m = minutes.cast("long")
    part = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    return (
        F.when(m < 60, part(m, "m"))
        .when(m < 1440, F.concat_ws(" ", part(m / 60, "h"), part(m % 60, "m")))
        .otherwise(F.concat_ws(" ", part(m / 1440, "d"), part(m % 1440 / 60, "h")))
    )


def minutes_since(then_s: Column, now_s: Column) -> Column:
    """Whole minutes between two times, by the minutes of the clock; 0 if it is in the future."""
    return F.greatest(F.lit(0).cast("long"), F.floor(now_s / 60) - F.floor(then_s / 60))


def clock_state(now_s: Column, built_s: Column) -> Column:
    """``early`` before a build's day, ``late`` over 20 years past it, else ``ok``."""
    return F.when(now_s < built_s, "early").when(now_s > built_s + 20 * 365 * 86400, "late").otherwise("ok")


def display_label(label: Column, folder: Column) -> Column:
    """The label, or the id where it is empty."""
    return F.coalesce(F.nullif(label, F.lit("")), folder)


def mode_of(text: Column) -> Column:
    """The folder mode that a text names; null if none."""
    t = F.lower(text)
    out = None
    for name, mode in MODES.items():
        out = F.when(t == name, mode) if out is None else out.when(t == name, mode)
    return out


def mode_text(mode: Column) -> Column:
    """A folder mode's name."""
    out = None
    for name, number in MODES.items():
        out = F.when(mode == number, name) if out is None else out.when(mode == number, name)
    return out


def conflict_name(name: Column, now_s: Column, tag: Column, compact: bool = False, cap: int = 256) -> Column:
    """The name of a conflict copy: a suffix before the extension of the last component; null if it takes ``cap`` bytes or more."""
    # A time without zone: the session's time zone doesn't matter.
    time = F.timestamp_add("SECOND", now_s.cast("long"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    utc = lambda pattern: F.date_format(time, pattern)
    suffix = F.concat(F.lit(".cnfl-"), utc("HHmmss")) if compact else F.concat(F.lit(".sync-conflict-"), utc("yyyyMMdd-HHmmss"), F.lit("-"), F.substring(tag, 1, 7))
    parts = split_extension(name)
    out = F.concat(parts["stem"], suffix, parts["extension"])
    return F.when(F.octet_length(out) < cap, out)


def tz_offset(text: Column) -> Column:
    """Seconds east of UTC of ``[+-]HH[:MM]`` within 14 hours; null for anything else."""
    pattern = r"^[ \t]*([+-]?)(\d{1,2})(?:[:.](\d{1,2}))?[ \t]*$"
    sign, hh, mm = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    h, m = hh.try_cast("int"), F.coalesce(F.nullif(mm, F.lit("")).try_cast("int"), F.lit(0))
    seconds = F.when(sign == "-", -1).otherwise(1) * (h * 3600 + m * 60)
    ok = text.rlike(pattern) & (m <= 59) & ((h < 14) | ((h == 14) & (m == 0)))
    return F.when(ok, seconds)


def civil(unix_s: Column) -> Column:
    """(year, month, day, hour, minute, second) of Unix seconds in UTC, before 1970 too."""
    time = F.timestamp_add("SECOND", unix_s.cast("long"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return F.struct(F.year(time).alias("year"), F.month(time).alias("month"), F.day(time).alias("day"), F.hour(time).alias("hour"), F.minute(time).alias("minute"), F.second(time).alias("second"))


def days_of(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 to a civil date; a day or month beyond its range counts on into the next."""
    first = F.make_date(year + F.floor((month - 1) / 12).cast("int"), F.pmod(month - 1, F.lit(12)) + 1, F.lit(1))
    return F.unix_date(first) + day - 1


def disk_time(modified_s: Column, tz_east_s: Column) -> Column:
    """A time as a disk keeps it that knows none before 1978 of local time."""
    return F.greatest(modified_s, F.lit(DISK_EPOCH).cast("long") - tz_east_s)


def protection_bits(mode: Column) -> Column:
    """Protection bits, where a set bit forbids, of a Unix mode's owner bits; writing stands for deleting."""
    lacks = lambda bit, bits: F.when(mode.bitwiseAND(F.lit(bit)) == 0, F.lit(bits)).otherwise(F.lit(0))
    return lacks(0o400, NO_READ) + lacks(0o200, NO_WRITE | NO_DELETE) + lacks(0o100, NO_EXECUTE)
