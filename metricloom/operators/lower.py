"""Tiers A and B: a program as columns over lines (filename, line, seq), giving an array of ops.

A statement's effect is a struct with the condition under which it happens: its path of blocks, and
that nothing before it in the line failed or stopped the program.  Whatever can fail gets a flag;
the first flag or stop that holds is the line's `halt`, and only ops before it count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gotime
from ..functions.numbers import format_float_column, parse_base_column, parse_float_column, parse_int_column
from ..lang.checker import COMPARE, Capture, Program
from ..lang.parser import Expr, Metric, Stmt
from ..plans.analysis import fallible
from .interpreter import loose

NEVER = 1 << 30
SPARK = {"Int": "bigint", "Float": "double", "String": "string", "Bool": "boolean"}


@dataclass
class Value:
    column: Column
    fails: Column | None = None


def _any(*flags: Column | None) -> Column | None:
    out = None
    for f in flags:
        if f is not None:
            out = f if out is None else out | f
    return out


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def wrapped(op: str, a: Column, b: Column) -> Column:
    """Whole numbers of 64 bits that wrap around: the exact result first, decimals where it overflows."""
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    exact = ({"+": x + y, "-": x - y, "*": x * y}[op]).cast("decimal(38,0)")
    half, full = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    turns = F.floor((exact + half).cast("decimal(38,0)") / full).cast("decimal(20,0)")
    return F.coalesce(quick, (exact - (turns * full).cast("decimal(38,0)")).cast("decimal(38,0)").try_cast("bigint"))


def convert(v: Value, a: str, b: str) -> Value:
    a = a or "Int"
    if a == b or b in ("", "Any"):
        return v
    if b == "Bool":
        return Value(v.column != F.lit("" if a == "String" else 0), v.fails) if a != "Bool" else v
    if a == "String":
        made = parse_int_column(v.column) if b == "Int" else parse_float_column(v.column)
        return Value(made, _any(v.fails, made.isNull()))
    if b == "String":
        return Value(format_float_column(v.column) if a == "Float" else v.column.cast("bigint").cast("string"), v.fails)
    return Value(v.column.cast(SPARK[b]), v.fails)


class Lowering:
    def __init__(self, program: Program, lines: DataFrame, number: int, year: int, zone: str, shared: dict[tuple, Column] | None = None):
        self.program, self.df, self.year, self.zone = program, lines, year, zone
        self.prefix = f"_p{number}_"
        self.shared = {} if shared is None else shared  # matches and groups of the line itself, of all programs
        self.path, self.flag, self.time = F.lit(True), F.lit(False), F.lit(None).cast("timestamp")
        self.halts: list[tuple[Column, int]] = []
        self.ops: list[Column] = []
        self.ord = 0
        self.stops: set[int] = set()
        self.extracted: dict[tuple, Column] = {}
        self.matches: dict[int, tuple] = {}  # by site: subject, match, path, whether it is the line

    def name(self, column: Column, what: str) -> Column:
        """The column under a name of its own, so that it is worked out once."""
        name = f"{self.prefix}{what}{len(self.df.columns)}"
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    def fail(self, flag: Column | None) -> None:
        if flag is not None:
            self.halts.append((self.path & _yes(flag), self.ord))
            self.ord += 1

    # Statements --------------------------------------------------------------------------------

    def block(self, body: list[Stmt]) -> None:
        for s in body:
            if s.kind == "cond":
                v = self.value(s.expr)
                self.fail(v.fails)
                c = self.name(_yes(convert(v, s.expr.type if s.expr.op != "~" else "Int", "Bool").column), "c")
                self.branch(c, s.body, s.other)
            elif s.kind == "otherwise":
                self.branch(self.name(~self.flag, "c"), s.body, None)
            elif s.kind == "expr":
                self.effect(s.expr)
            elif s.kind == "stop":
                self.halts.append((self.path, self.ord))
                self.stops.add(self.ord)
                self.ord += 1
            elif s.kind == "del":
                self.emit(s.expr, "del" if s.seconds is None else "expire", None if s.seconds is None else F.lit(float(s.seconds)))

    def branch(self, c: Column, body: list[Stmt], other: list[Stmt] | None) -> None:
        path, flag = self.path, self.flag
        self.path, self.flag = path & c, F.lit(False)
        self.block(body)
        after = flag | (path & c)
        if other is not None:
            self.path, self.flag = path & ~c, flag
            self.block(other)
            after = F.when(path & c, True).otherwise(self.flag)
        self.path, self.flag = path, after

    def effect(self, e: Expr) -> None:
        if e.op in ("=", "+=", "++", "--"):
            m: Metric = e.items[0].ref
            if e.op in ("++", "--"):
                self.change(e.items[0], m, "inc", Value(F.lit(1 if e.op == "++" else -1).cast("bigint")), "Int")
                return
            x = e.items[1]
            op = "=" if e.op == "=" else "inc"
            self.change(e.items[0], m, op, self.value(x), x.type, x)
        else:
            self.fail(self.value(e).fails)

    def change(self, target: Expr, m: Metric, op: str, v: Value, kind: str, source: Expr | None = None) -> None:
        if m.type == "Buckets":
            if op != "=":
                self.fail(F.lit(True))
                return
            op, want = "observe", "Float"
        else:
            want = m.type
            op = "set" if op == "=" else {"Int": "inc", "Float": "fadd"}.get(m.type, "append")
        v = convert(v, kind, want)
        if source is not None and (v.fails is not None or fallible(source)):
            self.emit(target, "touch", None)
        self.fail(v.fails)
        self.emit(target, op, v.column)

    def emit(self, target: Expr, op: str, value: Column | None) -> None:
        m: Metric = target.ref
        labels = [convert(self.value(x), x.type, "String") for x in target.items[1:]] if target.op == "index" else []
        self.fail(_any(*(v.fails for v in labels)))
        slot = "f" if op in ("observe", "expire", "fadd") or m.type == "Float" else "s" if m.type == "String" else "i"
        field = lambda k, t: (value.cast(t) if value is not None and slot == k else F.lit(None).cast(t)).alias(k)
        self.ops.append(
            F.when(
                self.path,
                F.struct(F.lit(m.index).alias("metric"), (F.array(*(v.column for v in labels)) if labels else F.array().cast("array<string>")).alias("labels"), F.lit(op).alias("op"), field("i", "bigint"), field("f", "double"), field("s", "string"), self.time.alias("ts"), F.lit(self.ord).alias("ord")),
            )
        )
        self.ord += 1

    # Expressions -------------------------------------------------------------------------------

    def value(self, e: Expr) -> Value:
        op = e.op
        if op in ("int", "float", "string"):
            return Value(F.lit(e.value).cast({"int": "bigint", "float": "double", "string": "string"}[op]))
        if op == "match":
            return Value(self.match(e, F.col("line"), True))
        if op == "capture":
            return self.capture(e)
        if op == "call":
            return self.call(e)
        if op in ("&&", "||"):
            a = self.value(e.items[0])
            first = _yes(convert(a, e.items[0].type, "Bool").column)
            path = self.path
            self.path = path & (first if op == "&&" else ~first)
            b = self.value(e.items[1])
            self.path = path
            second = _yes(convert(b, e.items[1].type, "Bool").column)
            late = None if b.fails is None else (first if op == "&&" else ~first) & b.fails
            return Value(first & second if op == "&&" else first | second, _any(a.fails, late))
        if op in ("=~", "!~"):
            x = self.value(e.items[0])
            text = convert(x, e.items[0].type, "String")
            hit = self.match(e.items[1], text.column, False)
            return Value(hit if op == "=~" else ~hit, text.fails)
        if op == "~":
            x = convert(self.value(e.items[0]), e.items[0].type, "Int")
            return Value(F.bitwise_not(x.column), x.fails)
        a, b = self.value(e.items[0]), self.value(e.items[1])
        ka, kb = (x.type or "Int" for x in e.items)
        if op in COMPARE:
            kind = "String" if "String" in (ka, kb) else "Float" if "Float" in (ka, kb) else "Int"
            a, b = convert(a, ka, kind), convert(b, kb, kind)
            return self.compare(op, a, b, kind, loose(e.items[0]) or loose(e.items[1]))
        a, b = convert(a, ka, e.type), convert(b, kb, e.type)
        fails = _any(a.fails, b.fails)
        x, y = a.column, b.column
        if e.type == "String":
            return Value(F.concat(x, y), fails)
        if op in ("&", "|", "^"):
            return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], fails)
        if op in ("<<", ">>"):
            step = F.least(F.greatest(y, F.lit(0)), F.lit(63)).cast("int")
            far = y >= 64
            out = F.when(far, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", x, step)) if op == "<<" else F.call_function("shiftright", x, step)
            return Value(out, _any(fails, (y < 0) | (y >= (1 << 31) - 1)))
        if e.type == "Int":
            if op in "+-*" and op != "**":
                return Value(wrapped(op, x, y), fails)
            if op == "**":
                p = F.pow(x.cast("double"), y.cast("double"))
                return Value(F.when(F.isnan(p), F.lit(0)).when(p >= float(1 << 63), F.lit((1 << 63) - 1)).when(p <= -float(1 << 63), F.lit(-(1 << 63))).otherwise(p.try_cast("bigint")), fails)
            safe = F.when(y == 0, F.lit(1)).otherwise(y)
            quotient = F.when((y == -1), wrapped("-", F.lit(0).cast("bigint"), x)).otherwise(F.call_function("div", x, safe)) if op == "/" else F.when(y == -1, F.lit(0)).otherwise(x % safe)
            return Value(quotient.cast("bigint"), _any(fails, y == 0))
        if op == "/":
            over = F.when((x == 0) | F.isnan(x), F.lit(math.nan)).otherwise(F.when((x > 0) == (y.cast("string") != "-0.0"), F.lit(math.inf)).otherwise(F.lit(-math.inf)))
            return Value(F.when(y == 0, over).otherwise(F.try_divide(x, y)), fails)
        if op == "%":
            return Value(F.when((y == 0) | (F.abs(x) == math.inf), F.lit(math.nan)).otherwise(F.try_mod(x, y)), fails)
        if op == "**":
            return Value(F.pow(x, y), fails)
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], fails)

    def compare(self, op: str, a: Value, b: Value, kind: str, is_loose: bool) -> Value:
        x, y = a.column, b.column
        fails = _any(a.fails, b.fails)
        if kind == "String" and is_loose:
            n, m = parse_float_column(x), parse_float_column(y)
            as_numbers = self._ordered(op, n, m, True)
            return Value(F.when(n.isNull(), self._ordered(op, x, y, False)).otherwise(as_numbers), _any(fails, n.isNotNull() & m.isNull()))
        return Value(self._ordered(op, x, y, kind == "Float"), fails)

    def _ordered(self, op: str, x: Column, y: Column, floats: bool) -> Column:
        number = ~(F.isnan(x) | F.isnan(y)) if floats else F.lit(True)
        less, more, same = number & (x < y), number & (x > y), number & (x == y)
        return {"<": less, ">": more, "<=": ~more, ">=": ~less, "==": same, "!=": ~same}[op]

    def match(self, e: Expr, text: Column, plain: bool) -> Column:
        pattern = e.ref
        java, literal = pattern.regex.java(), pattern.regex.literal()
        subject = text if plain else self.name(text, "t")
        hit = self.shared.get((java, -1)) if plain else None
        if hit is None:
            test = subject.rlike(java)
            if len(literal) > 2:
                test = subject.contains(literal) & test
            hit = self.name(_yes(test), "m")
            if plain:
                self.shared[java, -1] = hit
        self.matches[pattern.site] = (subject, hit, self.path, plain)
        return hit

    def capture(self, e: Expr) -> Value:
        ref: Capture = e.ref
        subject, hit, path, plain = self.matches[ref.pattern.site]
        java = ref.pattern.regex.java()
        known, key = (self.shared, (java, ref.group)) if plain else (self.extracted, (ref.pattern.site, ref.group))
        if key not in known:
            known[key] = self.name(F.regexp_extract(subject, java, ref.group), "g")
        return convert(Value(known[key], ~(hit & path)), "String", e.type)

    def call(self, e: Expr) -> Value:
        name, items = e.value, e.items
        if name == "getfilename":
            return Value(F.col("filename"))
        if name == "timestamp":
            return Value(F.coalesce(F.unix_seconds(self.time), F.unix_seconds(F.col("now"))))
        if name == "subst" and items[0].op == "pattern":
            new, text = (convert(self.value(x), x.type, "String") for x in items[1:])
            plain = F.replace(F.replace(new.column, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
            return Value(F.regexp_replace(text.column, F.lit(items[0].ref.regex.java()), plain), _any(new.fails, text.fails))
        values = [self.value(x) for x in items]
        if name in ("int", "float", "string", "bool"):
            return convert(values[0], items[0].type, name.capitalize())
        if name == "settime":
            v = convert(values[0], items[0].type, "Int")
            self.time = self.name(F.when(self.path, F.timestamp_seconds(v.column)).otherwise(self.time), "ts")
            return Value(F.lit(None), v.fails)
        if name == "strptime":
            v = convert(values[0], items[0].type, "String")
            when = self.name(gotime.parse_column(v.column, items[1].value, self.year, self.zone) if items[1].value else F.lit(None).cast("timestamp"), "w")
            self.time = self.name(F.when(self.path & when.isNotNull(), when).otherwise(self.time), "ts")
            return Value(F.lit(None), _any(v.fails, when.isNull()))
        if name == "strtol":
            text, base = convert(values[0], items[0].type, "String"), convert(values[1], items[1].type, "Int")
            out = parse_base_column(text.column, base.column)
            return Value(out, _any(text.fails, base.fails, out.isNull()))
        texts = [convert(v, x.type, "String") for v, x in zip(values, items, strict=True)]
        fails = _any(*(t.fails for t in texts))
        if name == "len":
            return Value(F.octet_length(texts[0].column).cast("bigint"), fails)
        if name == "tolower":
            return Value(F.lower(texts[0].column), fails)
        return Value(F.replace(texts[2].column, texts[0].column, texts[1].column), fails)


def lower(program: Program, lines: DataFrame, number: int, year: int, zone: str, shared: dict[tuple, Column] | None = None) -> tuple[DataFrame, Column, Column]:
    """lines with helper columns; the array of ops that happen; and whether the line failed."""
    x = Lowering(program, lines, number, year, zone, shared)
    x.block(program.body)
    stop = x.name(F.least(F.lit(NEVER), *(F.when(c, F.lit(k)).otherwise(NEVER) for c, k in x.halts)) if x.halts else F.lit(NEVER), "halt")
    failing = [k for _, k in x.halts if k not in x.stops]
    failed = stop.isin(failing) if failing else F.lit(False)
    if not x.ops:
        return x.df, F.array(), failed
    every = F.array(*x.ops)
    happens = (lambda o: o.isNotNull() & (o["ord"] < stop)) if x.halts else (lambda o: o.isNotNull())
    return x.df, F.filter(every, happens), failed

