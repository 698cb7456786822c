"""Time layouts that show how the reference time Mon Jan 2 15:04:05 MST 2006 is written.

A layout becomes one pattern with a group for each component; the driver, the row-by-row
interpreter and the Spark columns all use that pattern, so they agree.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# The components of a layout, the longest spelling first where one begins another.
COMPONENTS = [
    ("January", "month_name", "[A-Za-z]+"), ("Jan", "month_name", "[A-Za-z]{3}"), ("Monday", "", "[A-Za-z]+"), ("Mon", "", "[A-Za-z]{3}"),
    ("MST", "zone", "[A-Z]{3,4}"), ("2006", "year", r"\d{4}"), ("-07:00", "offset", r"[+-]\d{2}:\d{2}"), ("-0700", "offset", r"[+-]\d{4}"), ("-07", "offset", r"[+-]\d{2}"),
    ("Z07:00", "offset", r"Z|[+-]\d{2}:\d{2}"), ("Z0700", "offset", r"Z|[+-]\d{4}"), ("01", "month", r"\d{2}"), ("02", "day", r"\d{2}"), ("03", "hour12", r"\d{2}"), ("04", "minute", r"\d{2}"), ("05", "second", r"\d{2}"), ("06", "year2", r"\d{2}"),
    ("15", "hour", r"\d{2}"), ("_2", "day", r" *\d{1,2}"), ("PM", "half", "AM|PM"), ("pm", "half", "am|pm"),
    ("1", "month", r"\d{1,2}"), ("2", "day", r"\d{1,2}"), ("3", "hour12", r"\d{1,2}"), ("4", "minute", r"\d{1,2}"), ("5", "second", r"\d{1,2}"),
]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


@dataclass(frozen=True)
class Layout:
    pattern: str
    groups: tuple[str, ...]  # component of each group, in order

    @property
    def has_year(self) -> bool:
        return "year" in self.groups or "year2" in self.groups


@lru_cache(maxsize=256)
def layout(text: str) -> Layout:
    """ValueError if a component stands twice or there is none."""
    out, groups, i = "", [], 0
    while i < len(text):
        if (m := re.match(r"[.,](0+|9+)(?!\d)", text[i:])) and groups and groups[-1] == "second":
            if out.endswith("(?:[.,]\\d+)?"):
                out = out[: -len("(?:[.,]\\d+)?")]
            out += r"[.,](\d+)" if m[1][0] == "0" else r"(?:[.,](\d+))?"
            groups.append("fraction")
            i += len(m[0])
            continue
        found = next((c for c in COMPONENTS if text.startswith(c[0], i)), None)
        if found is None:
            out += r" +" if text[i] == " " else re.escape(text[i])
            i += 1
            continue
        spelled, what, pattern = found
        out += f"({pattern})" if what else f"(?:{pattern})"
        if what:
            groups.append(what)
        if what == "second":
            out += r"(?:[.,]\d+)?"
        i += len(spelled)
    if len(set(groups)) < len(groups) or not groups:
        raise ValueError(f'invalid time format string "{text}"')
    return Layout(out, tuple(groups))


def parse(value: str, text: str, year: int = 0, zone: str = "UTC") -> float:
    """Seconds since the epoch; ValueError if the value is not written as the layout says.

    `year` is taken where the layout has none."""
    x = layout(text)
    m = re.fullmatch(x.pattern, value, re.A)
    if not m:
        raise ValueError(f'parsing time "{value}" as "{text}"')
    part = {k: v for k, v in zip(x.groups, m.groups(), strict=True) if v is not None}
    y = int(part["year"]) if "year" in part else _century(int(part["year2"])) if "year2" in part else year
    month = MONTHS.index(part["month_name"][:3].lower()) + 1 if "month_name" in part and part["month_name"][:3].lower() in MONTHS else int(part.get("month", 1 if "month_name" not in part else 13))
    hour = int(part.get("hour", part.get("hour12", 0)))
    if "half" in part:
        hour = hour % 12 + 12 * (part["half"].upper() == "PM")
    micro = int(f"{part.get('fraction', '0')[:6]:<06}")
    utc = "offset" in part or part.get("zone") in ("UTC", "GMT")
    when = dt.datetime(max(y, 1), month, int(part.get("day", 1)), hour, int(part.get("minute", 0)), int(part.get("second", 0)), micro, dt.UTC if utc else ZoneInfo(zone))
    return when.timestamp() - _offset(part.get("offset", "Z"))


def _century(y: int) -> int:
    return y + (1900 if y >= 69 else 2000)


def _offset(text: str) -> int:
    if text == "Z":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    return (-1 if text[0] == "-" else 1) * (int(digits[:2]) * 3600 + int(digits[2:]) * 60)


def parse_column(value: Column, text: str, year: int = 0, zone: str = "UTC") -> Column:
    """The same as a timestamp column; null if the value is not written so."""
    x = layout(text)
    pattern = rf"\A{x.pattern}\z"
    part = {k: F.regexp_extract(value, pattern, i + 1) for i, k in enumerate(x.groups)}
    number = lambda k, otherwise: part[k].try_cast("int") if k in part else F.lit(otherwise)
    if "day" in part:
        part["day"] = F.trim(part["day"])
    y = number("year", year) if "year" in part else F.when(number("year2", 0) >= 69, number("year2", 0) + 1900).otherwise(number("year2", 0) + 2000) if "year2" in part else F.lit(max(year, 1))
    if "month_name" in part:
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part["month_name"], 1, 3)))
        month = F.nullif(place, F.lit(0).cast("long")).cast("int")
    else:
        month = number("month", 1)
    hour = number("hour", 0) if "hour" in part else number("hour12", 0)
    if "half" in part:
        hour = hour % 12 + F.when(F.upper(part["half"]) == "PM", 12).otherwise(0)
    second = number("second", 0).cast("decimal(16,6)")
    if "fraction" in part:
        second = second + (F.rpad(F.substring(part["fraction"], 1, 6), 6, "0").try_cast("int") / F.lit(1000000)).cast("decimal(16,6)")
    own_zone = F.lit("UTC") if "offset" in part else F.when(part["zone"].isin("UTC", "GMT"), "UTC").otherwise(zone) if "zone" in part else F.lit(zone)
    when = F.try_make_timestamp(y, month, number("day", 1), hour, number("minute", 0), second, own_zone)
    if "offset" in part:
        digits = F.rpad(F.replace(F.substring(part["offset"], 2, 5), F.lit(":"), F.lit("")), 4, "0")
        shift = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
        shift = F.when(part["offset"] == "Z", 0).when(F.substring(part["offset"], 1, 1) == "-", -shift).otherwise(shift)
        when = F.timestamp_micros(F.unix_micros(when) - shift.cast("long") * 1000000)
    return F.when(value.rlike(pattern), when)
