"""The op stream: what a line does to the store, whatever computed it.

    program, metric, labels    the cell (metric: its number in the program)
    op          touch, inc, fadd, set, append, observe, del, expire
    i, f, s     the value, by the metric's type
    ts          the time to stamp, null for "when it is processed"
    seq, ord    place of the line, and of the op in the line
"""

from __future__ import annotations

OP_FIELDS = [
    ("program", "string"), ("metric", "int"), ("labels", "array<string>"), ("op", "string"), ("i", "bigint"), ("f", "double"), ("s", "string"), ("ts", "timestamp"), ("seq", "bigint"), ("ord", "int"),
]
OPS = ", ".join(f"{a} {b}" for a, b in OP_FIELDS)
