"""Numbers as text: the shortest form of a float, and strict parsing, for rows and for columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = r"[+-]?[0-9]+"
FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"
HEX = r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def format_float(x: float) -> str:
    """Shortest digits; with an exponent below 1e-4 and from 1e6 (1e+06, not 1000000)."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exponent = "-" * (x < 0), "", 0
    mantissa, _, power = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    raw = (whole + part).lstrip("0")
    exponent = int(power or 0) + len(whole) - 1 - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = raw.rstrip("0")
    if exponent < -4 or exponent >= 6:
        return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    return sign + digits[: exponent + 1].ljust(exponent + 1, "0") + ("." + digits[exponent + 1 :] if len(digits) > exponent + 1 else "")


def format_float_column(x: Column) -> Column:
    """format_float; Java's shortest digits are taken apart and written again."""
    s = F.abs(x).cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(whole, part)
    raw = F.ltrim(every, F.lit("0"))
    exponent = power + F.length(whole) - 1 - (F.length(every) - F.length(raw))
    digits = F.rtrim(raw, F.lit("0"))
    rest = F.substr(digits, F.lit(2))
    wide = F.concat(F.substring(digits, 1, 1), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    head = F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    tail = F.substr(digits, exponent + 2)
    plain = F.concat(head, F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""))
    text = F.when((exponent < -4) | (exponent >= 6), wide).when(exponent < 0, small).otherwise(plain)
    signed = F.concat(F.when(x < 0, "-").otherwise(""), text)
    infinite = F.abs(x) == float("inf")
    return F.when(F.isnan(x), "NaN").when(infinite, F.when(x > 0, "+Inf").otherwise("-Inf")).when(x == 0, F.when(x.cast("string") == "-0.0", "-0").otherwise("0")).otherwise(signed)


def parse_int(s: str, base: int = 10) -> int:
    """ValueError unless s is a whole number of 64 bits in that base (2 to 36)."""
    if not 2 <= base <= 36 or not re.fullmatch(r"[+-]?[0-9A-Za-z]+", s, re.A):
        raise ValueError(f'parsing "{s}": invalid syntax')
    x = int(s, base)
    if not LOW <= x <= HIGH:
        raise ValueError(f'parsing "{s}": value out of range')
    return x


def parse_float(s: str) -> float:
    if re.fullmatch(HEX, s, re.A):
        try:
            return float.fromhex(s)
        except OverflowError:
            raise ValueError(f'parsing "{s}": value out of range') from None
    if not re.fullmatch(FLOAT, s, re.A):
        raise ValueError(f'parsing "{s}": invalid syntax')
    x = float(s)
    if math.isinf(x) and not re.fullmatch(r"[+-]?inf(inity)?", s, re.I):
        raise ValueError(f'parsing "{s}": value out of range')
    return x


def parse_int_column(s: Column) -> Column:
    return F.when(s.rlike(rf"\A{INT}\z"), s.try_cast("bigint"))


def parse_float_column(s: Column) -> Column:
    x = s.try_cast("double")
    # A number in base 16 by its digits and powers of two; digits beyond 15 only shift it.
    whole, part = F.regexp_extract(s, r"0[xX]([0-9a-fA-F]*)", 1), F.regexp_extract(s, r"\.([0-9a-fA-F]*)[pP]", 1)
    power = F.regexp_extract(s, r"[pP]([+-]?[0-9]{1,6})$", 1).try_cast("int") - 4 * F.length(part)
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    kept = F.when(digits == "", "0").otherwise(F.substring(digits, 1, 15))
    size = F.conv(kept, 16, 10).cast("double") * F.pow(F.lit(2.0), (power + 4 * F.greatest(F.lit(0), F.length(digits) - 15)).cast("double"))
    sixteen = F.when(F.abs(size) != float("inf"), F.when(s.startswith("-"), -size).otherwise(size))
    return F.when(s.rlike(rf"\A{HEX}\z"), sixteen).when(s.rlike(rf"\A{FLOAT}\z") & (s.rlike(r"(?i)inf") | (F.abs(x) != float("inf"))), x)


def parse_base_column(s: Column, base: Column) -> Column:
    """parse_int in a base; null where it fails."""
    digits = F.ltrim(F.lower(F.regexp_replace(s, r"\A[+-]", "")), F.lit("0"))
    shortened = F.when(digits == "", "0").otherwise(digits)
    points = F.transform(F.split(shortened, ""), lambda c: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), c) - 1)
    fits = ~F.exists(points, lambda p: (p < 0) | (p >= base))
    total = F.aggregate(points, F.lit(0).cast("decimal(38,0)"), lambda a, p: F.when(a > F.lit("9223372036854775808").cast("decimal(38,0)"), a).otherwise((a * base.cast("decimal(3,0)") + p.cast("decimal(3,0)")).cast("decimal(38,0)")))
    signed = F.when(s.startswith("-"), -total).otherwise(total)
    return F.when(s.rlike(r"\A[+-]?[0-9A-Za-z]+\z") & (base >= 2) & (base <= 36) & fits, signed.try_cast("bigint"))
