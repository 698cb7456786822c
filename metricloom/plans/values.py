"""Arithmetic, comparison and conversion of single values, as the language defines them."""

from __future__ import annotations

import math

from ..functions.numbers import format_float, parse_float, parse_int


class Failure(Exception):
    """A runtime error: the program ends for this line."""


def wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def arithmetic(op: str, a, b, kind: str):
    if kind == "Int":
        if op in ("/", "%"):
            if b == 0:
                raise Failure("Divide by zero")
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return wrap(q if op == "/" else a - q * b)
        if op == "**":
            x = _pow(float(a), float(b))
            return 0 if math.isnan(x) else max(-(1 << 63), min((1 << 63) - 1, int(x) if math.isfinite(x) else (1 << 63) * (1 if x > 0 else -1)))
        return wrap({"+": a + b, "-": a - b, "*": a * b}[op])
    a, b = float(a), float(b)
    if op == "/":
        return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)
    if op == "**":
        return _pow(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _pow(a: float, b: float) -> float:
    try:
        return math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan


def bits(op: str, a: int, b: int) -> int:
    if op in ("<<", ">>"):
        if b < 0 or b >= (1 << 31) - 1:
            raise Failure("shift out of range")
        return (wrap(a << b) if b < 64 else 0) if op == "<<" else a >> min(b, 63)
    return {"&": a & b, "|": a | b, "^": a ^ b}[op]


def compare(op: str, a, b) -> bool:
    """<= and >= are the negations of > and <, so that they hold for a NaN."""
    less, more = a < b, a > b
    return {"<": less, ">": more, "<=": not more, ">=": not less, "==": a == b, "!=": a != b}[op]


def compare_loose(op: str, a: str, b: str) -> bool:
    """Strings whose left one reads as a number are compared as numbers."""
    try:
        x = parse_float(a)
    except ValueError:
        return compare(op, a, b)
    try:
        return compare(op, x, parse_float(b))
    except ValueError as why:
        raise Failure(str(why)) from why


def convert(x, a: str, b: str):
    """A value of type a as one of type b."""
    if a == b or b in ("", "Any", "Bool"):
        return x
    try:
        if b == "String":
            return format_float(x) if a == "Float" else str(int(x))
        if b == "Float":
            return parse_float(x) if a == "String" else float(x)
        if b == "Int":
            return parse_int(x) if a == "String" else int(x)
    except ValueError as why:
        raise Failure(str(why)) from why
    return x
