"""From ops to the store: one row for each cell.

Every fold is an aggregation with partial aggregates on the map side; no cell's ops are gathered in
one place (but for appended strings).  Where a metric is only set, or only added to, one aggregate
does: the last value, or the sum.  Where cells are deleted, or set and added to, a first aggregate
finds the last deletion and the last value set, and a second takes what comes after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import MetricInfo, bounds
from .lower import wrapped

KEY = ["program", "metric", "labels"]


def fold(ops: DataFrame, metrics: list[MetricInfo], ordered: bool, mixed: bool = True, appended: bool = False, timed: bool = True) -> DataFrame:
    """Cells by KEY with their value columns; ops as in plans.ops.

    Only what the metrics need is aggregated, and buffers are plain numbers where no text is kept, so
    that the aggregate hashes.  A place is one number: 2 ** 51 lines, 4096 ops in each."""
    types = {m.type for m in metrics}
    is_ = lambda *names: F.col("op").isin(*names)
    ops = ops.withColumn("pos", F.shiftleft(F.col("seq"), 12) + F.col("ord"))
    slots = [c for c, t in (("i", "Int"), ("f", "Float"), ("s", "String")) if t in types] if ordered else []
    last = lambda c: F.max_by(c, F.when(is_("set"), F.col("pos"))).alias(f"v_{c}")
    if ordered and mixed:
        marks = ops.groupBy(*KEY).agg(F.max(F.when(is_("del"), F.col("pos"))).alias("gone"), F.max(F.when(is_("set"), F.col("pos"))).alias("last_set"), *(last(c) for c in slots))
        kept = F.col("gone").isNull() | (F.col("last_set") > F.col("gone"))
        marks = marks.withColumns({**{f"v_{c}": F.when(kept, F.col(f"v_{c}")) for c in slots}, "since": F.greatest("gone", "last_set")})
        met = ops.join(marks.withColumnsRenamed({k: f"_{k}" for k in KEY}), F.expr(" AND ".join(f"{k} = _{k}" for k in KEY))).drop(*(f"_{k}" for k in KEY))
        met = met.where("op <> 'del' AND (gone IS NULL OR pos > gone)").withColumn("late", F.col("since").isNull() | (F.col("pos") > F.col("since")))
        values = [F.any_value(f"v_{c}").alias(f"v_{c}") for c in slots]
    else:
        met, values = ops.withColumn("late", F.lit(True)), [last(c) for c in slots]
    late, wrote = F.col("late"), F.when(~is_("touch", "expire"), F.col("pos"))
    micros = F.unix_micros("ts")
    aggregates = [*values, F.max(wrote).alias("wrote"), F.min_by(micros, F.col("pos")).alias("made")]
    if timed:
        aggregates.append(F.max_by(micros, wrote).alias("at"))
    if "Int" in types:
        # Sums wrap around like all whole numbers: the signed lower half and the upper one are summed apart.
        added = F.when(late & is_("inc"), F.col("i"))
        aggregates.append(F.sum(F.shiftright(F.shiftleft(added, 32), 32)).alias("inc_low"))
        aggregates.append(F.sum(F.shiftright(added, 32) + F.shiftright(added, 31).bitwiseAND(1)).alias("inc_high"))
    if "Float" in types:
        aggregates.append(F.sum(F.when(late & is_("fadd"), F.col("f"))).alias("fadd"))
    if ordered:
        aggregates.append(F.max_by("f", F.when(is_("expire"), F.col("pos"))).alias("expiry"))
    if appended:
        aggregates.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(late & is_("append"), F.struct("pos", "s")))), lambda x: x["s"]), "").alias("tail"))
    edges = {(m.program, m.index): bounds(m.buckets) for m in metrics if m.type == "Buckets"}
    longest = max((len(b) for b in edges.values()), default=0)
    if edges:
        aggregates += [F.sum(F.when(is_("observe"), 1).otherwise(0)).alias("hist_count"), F.sum(F.when(is_("observe"), F.col("f"))).alias("hist_sum")]
    for k in range(longest):
        inside = F.lit(False)
        for (program, index), b in edges.items():
            if k < len(b):
                above = F.lit(True) if k == 0 else ~(F.col("f") <= b[k - 1][1])
                inside = inside | ((F.col("program") == program) & (F.col("metric") == index) & above & (F.col("f") <= b[k][1]) & ~F.isnan("f"))
        aggregates.append(F.sum(F.when(is_("observe") & inside, 1).otherwise(0)).alias(f"b{k}"))
    cells = met.groupBy(*KEY).agg(*aggregates)
    own = lambda name, zero: F.coalesce(F.col(name) if name in cells.columns else F.lit(None), F.lit(zero))
    whole = wrapped("+", F.shiftleft(own("inc_high", 0).cast("bigint"), 32), own("inc_low", 0).cast("bigint"))
    if "v_i" in cells.columns:
        whole = wrapped("+", own("v_i", 0).cast("bigint"), whole)
    text = F.concat(F.coalesce("v_s", F.lit("")) if "v_s" in cells.columns else F.lit(""), F.col("tail") if appended else F.lit(""))
    when = F.when(F.col("wrote").isNull(), F.col("made")).otherwise(F.col("at") if timed else F.lit(None))
    return cells.select(
        *KEY,
        whole.alias("i"), (own("v_f", 0.0) + own("fadd", 0.0)).cast("double").alias("f"), text.alias("s"),
        (F.array(*(F.col(f"b{k}") for k in range(longest))) if longest else F.array().cast("array<bigint>")).alias("counts"),
        (F.col("hist_count") if edges else F.lit(0)).cast("bigint").alias("hist_count"), (F.coalesce("hist_sum", F.lit(0.0)) if edges else F.lit(0.0)).alias("hist_sum"),
        F.timestamp_micros(when).alias("ts"), (F.col("expiry").cast("bigint") if ordered else F.lit(None).cast("bigint")).alias("expiry_s"),
    )
