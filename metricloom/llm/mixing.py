"""Mixing sources to target weights, by pivotal dependent rounding.

Every document of a source should be taken target / source_size times.  The whole part is
taken outright; the fraction is a copy probability.  Probabilities are rounded in pairs: mass
(probability x size) moves between two documents, in a random direction that keeps both
expectations, until one of them is 0 or 1.  The other goes on to the next pair.  Since mass is
moved and never lost, a source's taken words differ from its target by less than one document.

The pairing is a tree: documents are dealt by a hash into nodes of about FAN rows, each node
folds its rows into one residual, and the residuals of FAN nodes meet in the next level's node,
up to one per source.  A node holds few rows whatever a source's share of the table, and a level
passes on one row in FAN.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, LIMIT, FAN = 1.5, 2.0, 64
BROADCAST_ROWS = 100_000


def sized(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """docs and `size`, the number of words in the whole text (0 for a null)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, n_rows and target of each source (one row per source).

    Weights go round over the sources in order of code point, null last.  All sources get words
    in proportion to weight until they reach `limit` times their size: with a source's ratio
    limit * size / weight, those that stop are the ones of smallest ratio, so one running sum over
    the sources in that order finds the common level."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.lit(limit) * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.least(F.lit(share), F.lit(limit)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level is final at the first source (in that order) whose cap lies above it.
    levelled = weighed.withColumn("own_level", level).withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("cap") >= F.col("own_level") * F.col("weight") * (1 - 1e-12), F.struct("place", F.col("own_level").alias("level")))).over(every)["level"]
    return levelled.withColumn("target", F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))).select("source", "source_size", "n_rows", "target")


def _chance(*parts) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


_ITEM = "struct<id:bigint,size:double,mass:double>"
_STATE = f"struct<rest:{_ITEM},done:array<struct<id:bigint,up:boolean>>>"


def _meet(state: Column, item: Column, seed: int) -> Column:
    """The pivotal step between the residual and the next item."""
    a, b = state["rest"], item
    gain_a = F.least(a["size"] - a["mass"], b["mass"])
    gain_b = F.least(a["mass"], b["size"] - b["mass"])
    to_a = _chance(F.lit(seed), a["id"], b["id"]) * (gain_a + gain_b) < gain_b
    full_a = a["size"] - a["mass"] <= b["mass"]
    empty_a = a["mass"] <= b["size"] - b["mass"]
    settled_a = F.when(to_a, full_a).otherwise(empty_a)
    up = F.when(to_a, full_a).otherwise(~empty_a)
    total = a["mass"] + b["mass"]
    rest_size = F.when(settled_a, b["size"]).otherwise(a["size"])
    gone = F.when(up, F.when(settled_a, a["size"]).otherwise(b["size"])).otherwise(F.lit(0.0))
    rest = F.struct(F.when(settled_a, b["id"]).otherwise(a["id"]).alias("id"), rest_size.alias("size"), F.greatest(F.lit(0.0), F.least(rest_size, total - gone)).alias("mass"))
    one = F.array(F.struct(F.when(settled_a, a["id"]).otherwise(b["id"]).alias("id"), up.alias("up")))
    met = F.struct(rest.alias("rest"), F.concat(state["done"], one).alias("done"))
    return F.when(a.isNull(), F.struct(b.alias("rest"), state["done"].alias("done"))).otherwise(met)


def round_fractions(items: DataFrame, levels: int, seed: int, fan: int = FAN) -> DataFrame:
    """id and up (take one copy more) of every item: (group, node, id, size, mass), 0 <= mass <= size."""
    settled, rest = None, items
    for level in range(levels + 1):
        listed = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), F.col("id")).alias("key"), "id", "size", "mass")))
        folded = rest.groupBy("group", "node").agg(
            F.aggregate(
                F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["mass"].alias("mass")).cast(_ITEM)),
                F.struct(F.lit(None).cast(_ITEM).alias("rest"), F.array().cast("array<struct<id:bigint,up:boolean>>").alias("done")).cast(_STATE),
                lambda s, x: _meet(s, x, seed + level).cast(_STATE),
            ).alias("s")
        )
        folded = cut(folded)
        done = folded.select(F.explode("s.done").alias("d")).select("d.id", "d.up")
        settled = done if settled is None else settled.unionAll(done)
        rest = folded.select("group", F.floor(F.col("node") / fan).alias("node"), "s.rest.id", "s.rest.size", "s.rest.mass")
    last = rest.select("id", (_chance(F.lit(seed), F.lit("last"), F.col("id")) * F.col("size") < F.col("mass")).alias("up"))
    return settled.unionAll(last)


def decide(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 20240607, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, same, source_size, target and copies_of_all.

    One row for each distinct (doc_id, source, size), of which docs holds `same` rows; they are to
    be taken copies_of_all times between them.  A null text or one without words has size 0 and
    whole copies only (it takes no words either way).  A null source is a source of its own, last
    in order.  An empty table gives an empty result.  The result depends on rows and seed only."""
    keyed = cut(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("same")))
    targets = cut(source_targets(keyed.select("source", (F.col("size") * F.col("same")).alias("size")), weights, share, limit).withColumn("group", _group()).drop("source"))
    n_sources, biggest = targets.agg(F.count(F.lit(1)), F.max("n_rows")).first()
    small = F.broadcast(targets) if n_sources <= BROADCAST_ROWS else targets
    levels, n = 0, max(1, -(-(biggest or 0) // fan))
    while n > 1:
        levels, n = levels + 1, -(-n // fan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wish = F.col("same") * rate
    item = keyed.withColumn("group", _group()).join(small, "group").withColumn("whole", F.floor(wish + 1e-12))
    item = item.withColumn("part", F.greatest(F.lit(0.0), wish - F.col("whole"))).withColumn("id", F.xxhash64(F.lit(seed), "group", F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "size"))
    nodes = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / fan))
    open_ = item.where((F.col("part") > 0) & (F.col("size") > 0)).select("group", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), nodes).alias("node"), "id", F.col("size").cast("double").alias("size"), (F.col("part") * F.col("size")).alias("mass"))
    more = round_fractions(open_, levels, seed, fan).where("up").select("id").distinct().withColumn("more", F.lit(1))
    return cut(item.join(more, "id", "left").select("doc_id", "source", "size", "same", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies_of_all")))


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _copies(nth: Column) -> Column:
    """Copies of the nth (from 1) of `same` equal rows."""
    return (F.floor(F.col("copies_of_all") / F.col("same")) + F.when(nth <= F.col("copies_of_all") % F.col("same"), 1).otherwise(0)).cast("int")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size), for every row of
    docs.  See `decide`."""
    each = decide(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    return each.withColumn("copies", _copies(F.col("nth"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs only.

    Of several rows with equal doc_id, source and size, those of least hash over all columns get a copy more."""
    choice = decide(docs, **options).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "same", "copies_of_all")
    rows = sized(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("r_id"), F.col("source").cast("string").alias("r_source"), "text")).drop("text")
    met = rows.join(choice, F.col("r_id").eqNullSafe(F.col("m_id")) & F.col("r_source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")))
    if choice.where("same > 1").isEmpty():
        copies = F.col("copies_of_all").cast("int")
    else:
        met = met.withColumn("nth", F.row_number().over(Window.partitionBy("r_id", "r_source", "size").orderBy(F.xxhash64("row"), F.col("row").cast("string"))))
        copies = _copies(F.col("nth"))
    return met.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
