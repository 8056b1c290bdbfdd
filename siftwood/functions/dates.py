"""Dates of the find language: parsing on the driver, formatting as columns."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
_UNIT = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400}


class DateError(ValueError):
    """A date that the language doesn't know, or a local time that a clock change skips."""


def _resolve(wall: dt.datetime, zone: ZoneInfo) -> int:
    local = wall.replace(tzinfo=zone)
    if local.astimezone(dt.UTC).astimezone(zone).replace(tzinfo=None) != wall:
        raise DateError(f"{wall} does not exist in {zone.key}")
    return int(local.timestamp())


def _relative(text: str, now_ns: int, zone: ZoneInfo) -> int | None:
    m = re.fullmatch(r"([+-]?\d+)\s+(second|sec|minute|min|hour|hr|day)s*", text.strip())
    if not m:
        return None
    delta = int(m[1]) * _UNIT[m[2]]
    if m[2] != "day":
        return now_ns - delta * NS
    # days keep the wall clock over a change of offset
    wall = dt.datetime.fromtimestamp(now_ns // NS, zone).replace(tzinfo=None) - dt.timedelta(seconds=delta)
    return _resolve(wall, zone) * NS + now_ns % NS


def parse_date(text: str, now_ns: int, zone_name: str = "UTC") -> int:
    """Nanoseconds since 1970 of a date argument."""
    zone, text = ZoneInfo(zone_name), text.strip()
    if text in ("now", "today"):
        return now_ns
    if text == "yesterday":
        return _relative("1 day", now_ns, zone)
    if text.startswith("@") and re.fullmatch(r"@-?\d+", text):
        return int(text[1:]) * NS
    for prefix in ("now-", "-"):
        if text.startswith(prefix) and (found := _relative(text[len(prefix) :], now_ns, zone)) is not None:
            return found
    if text.endswith(" ago"):
        found = _relative(text[:-4], now_ns, zone)
        if found is not None:
            return found
        if m := re.fullmatch(r"(\d+)\s+(month|year)s*", text[:-4].strip()):
            wall = dt.datetime.fromtimestamp(now_ns // NS, zone).replace(tzinfo=None)
            months = wall.year * 12 + wall.month - 1 - int(m[1]) * (12 if m[2] == "year" else 1)
            first = wall.replace(year=months // 12, month=months % 12 + 1, day=1)
            return _resolve(first + dt.timedelta(days=wall.day - 1), zone) * NS + now_ns % NS
    iso = text[:-1] + "+00:00" if text.endswith("Z") else text
    for shape in ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M%z", "%Y-%m-%dT%H:%M:%S%z", "%Y%m%d", "%b %d %Y", "%b %d, %Y", "%d %b %Y", "%Y/%m/%d"):
        try:
            wall = dt.datetime.strptime(iso, shape)
        except ValueError:
            continue
        return int(wall.timestamp()) * NS if wall.tzinfo else _resolve(wall, zone) * NS
    raise DateError(f"unknown date {text!r}")


def _padded(value: Column, width: int, fill: str = "0") -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


#: Codes that date_format writes as the language wants them.
_FORMATS = {"a": "EEE", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "D": "MM/dd/yy", "x": "MM/dd/yy", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "R": "HH:mm", "y": "yy", "Y": "yyyy"}


def time_code(code: str, seconds: Column, ns: Column) -> Column:
    """One %T-like code of a time in the session's zone; fractions as find writes them."""
    ts = F.timestamp_seconds(seconds)
    fraction = F.concat(F.lit("."), _padded(ns, 9), F.lit("0"))
    day = F.date_format(ts, "EEE")
    if code in _FORMATS:
        return F.date_format(ts, _FORMATS[code])
    if code == "@":
        return F.concat(seconds.cast("string"), fraction)
    if code == "s":
        return seconds.cast("string")
    if code == "S":
        return F.concat(F.date_format(ts, "ss"), fraction)
    if code in ("T", "X"):
        return F.concat(F.date_format(ts, "HH:mm:ss"), fraction)
    if code == "r":
        return F.date_format(ts, "hh:mm:ss a")
    if code == "P":
        return F.lower(F.date_format(ts, "a"))
    if code == "c":
        return F.concat(day, F.lit(" "), F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.lit(" "), F.date_format(ts, "HH:mm:ss yyyy"))
    if code == "e":
        return F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    if code == "k":
        return F.lpad(F.hour(ts).cast("string"), 2, " ")
    if code == "l":
        return F.lpad(F.date_format(ts, "h"), 2, " ")
    if code == "C":
        return _padded(F.floor(F.year(ts) / 100), 2)
    if code == "n":
        return F.lit("\n")
    if code == "t":
        return F.lit("\t")
    if code == "%":
        return F.lit("%")
    if code == "u":
        return (F.weekday(ts) + 1).cast("string")
    if code == "w":
        return F.pmod(F.weekday(ts) + 1, F.lit(7)).cast("string")
    if code == "U":
        return _padded(F.floor((F.dayofyear(ts) + 6 - F.pmod(F.weekday(ts) + 1, F.lit(7))) / 7), 2)
    if code == "W":
        return _padded(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7), 2)
    if code == "V":
        return _padded(F.weekofyear(ts), 2)
    if code == "G":
        return F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    if code == "g":
        return _padded(F.pmod(F.extract(F.lit("YEAROFWEEK"), ts), F.lit(100)), 2)
    if code == "Z":
        return F.date_format(ts, "zzz")
    if code == "z":
        return F.date_format(ts, "xx")
    if code == "+":
        return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("+"), F.date_format(ts, "HH:mm:ss"), fraction)
    raise DateError(f"unknown time code {code!r}")


def whole_time(seconds: Column, ns: Column) -> Column:
    """%a, %c and %t: like ctime, with a fraction behind the seconds."""
    ts = F.timestamp_seconds(seconds)
    return F.concat(F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss"), F.lit("."), _padded(ns, 9), F.lit("0"), F.date_format(ts, " yyyy"))
