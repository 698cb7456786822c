"""Exact top-k search by integer inner product, over vectors in order of norm.

Vectors are turned by the right singular vectors of the whole table, so that the first few
coordinates carry most of the length.  A partition holds vectors of falling norm and is read in
blocks.  For a block, each query's exact k-th best score so far is compared with upper bounds
from Cauchy-Schwarz: |q| |v| for the block's longest vector (none later can do better: the query
is finished here), then the partial product of the first coordinates plus the product of the
lengths that remain.  Pairs that pass are scored exactly in integers, in Python's own where 64 bits
don't hold the products.

Queries go out in chunks of at most CHUNK_MB; each chunk is one pass over the vectors, so that
what is sent to the executors is bounded whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

SCALE = 1024
MOST = (1 << 63) - 1  # a score beyond 64 bits counts as this or its negative
BLOCK = 1024
HEAD = 16  # turned coordinates in the partial sums
CHUNK_MB = 32
SEEDS = 2048  # longest vectors that give the first lower bounds


def integers(vectors: DataFrame, id_: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim, norm and v (whole numbers as doubles, packed) of the vectors that take part.

    Those null, empty, or with a null or non-finite component take no part; neither do rows without
    vec_id.  A component that `scale` makes infinite counts as the largest double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.nan_to_num(np.floor(values * scale))
            wrong = ~np.isfinite(values)
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(wrong)])
            good = (bad[end] == bad[end - size]) & (size > 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(good)
            packed = [scaled[end[i] - size[i] : end[i]].tobytes() for i in rows]
            with np.errstate(over="ignore"):
                norm = np.array([np.sqrt(float(np.dot(x, x))) for x in (scaled[end[i] - size[i] : end[i]] for i in rows)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(size[rows], pa.int32()), pa.array(norm, pa.float64()), pa.array(packed, pa.binary())], ["vec_id", "dim", "norm", "v"])

    return vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all vectors (from the sum of their outer products, dim x dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = vectors.select("v").mapInArrow(run, "m binary")
    sums = parts.coalesce(16).mapInArrow(add, "m binary").collect()
    total = sum((np.frombuffer(r["m"], np.float64) for r in sums), np.zeros(dim * dim)).reshape(dim, dim)
    return np.linalg.svd(total)[2].T if np.isfinite(total).all() else np.eye(dim)


def _large(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(-1, initial=0)


def paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, a_top: np.ndarray, b_top: np.ndarray) -> np.ndarray:
    """The inner products of rows i of a with rows j of b; a_top and b_top: the rows' largest sizes."""
    with np.errstate(over="ignore", invalid="ignore"):
        if a_top.max(initial=0) * b_top.max(initial=0) * a.shape[1] < 2**53:
            return np.rint(np.einsum("ij,ij->i", a[i], b[j])).astype(np.int64)
        near = a_top[i] * b_top[j] * a.shape[1] < 2**62
    out = np.empty(len(i), np.int64)
    out[near] = np.einsum("ij,ij->i", a[i[near]].astype(np.int64), b[j[near]].astype(np.int64))
    for k in np.flatnonzero(~near).tolist():
        score = sum(int(x) * int(y) for x, y in zip(a[i[k]].tolist(), b[j[k]].tolist(), strict=True))
        out[k] = max(-MOST, min(MOST, score))
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products; in doubles where these are exact."""
    a_top, b_top = _large(a), _large(b)
    if float(a_top.max(initial=0)) * float(b_top.max(initial=0)) * a.shape[1] < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return paired(a, b, np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), a_top, b_top).reshape(len(a), len(b))


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def put(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        rows, place = np.unique(query, return_inverse=True)
        k = self.score.shape[1]
        q = np.concatenate([place, np.repeat(np.arange(len(rows)), k)])
        s, i = np.concatenate([score, self.score[rows].ravel()]), np.concatenate([id_, self.id[rows].ravel()])
        order = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else -np.maximum(s, -(2**63 - 1)), q))
        q, s, i = q[order], s[order], i[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < k
        self.score[rows[q[kept]], nth[kept]], self.id[rows[q[kept]], nth[kept]] = s[kept], i[kept]


def search(vectors: DataFrame, queries, k: int = 10, chunk_mb: int = CHUNK_MB) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score of the k best vectors for each query.

    `vectors` is as `integers` gives it; `queries` is a condition on it.  A query's own row (by
    vec_id) isn't a candidate; ties go to the smaller vec_id; vectors of another length than the
    query's have no product with it.  Rows that share a vec_id are candidates each; queries that
    share one are taken as one query if equal, else each gives its own ranks.  With fewer
    candidates than k, all are returned; an empty table gives an empty result."""
    vectors = cut(vectors)
    found = None
    for dim, n_queries in [(r["dim"], r["n"]) for r in vectors.where(queries).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]:
        own = vectors.where(F.col("dim") == dim)
        turn = rotation(own, dim)
        longest = own.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        seeds = _unpack(longest.column("v"), dim), np.array(longest.column("vec_id").to_pylist(), np.int64)
        chunks = max(1, -(-n_queries * dim * 8 // (chunk_mb << 20)))
        width = 2 * max(1, vectors.sparkSession.sparkContext.defaultParallelism)
        by_norm = own.select("vec_id", "v", "norm").repartition(width, F.xxhash64("vec_id", "norm")).sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "v")
        if chunks > 1:
            by_norm = cut(by_norm)  # sorted once, read once for each chunk
        for c in range(chunks):
            rows = own.where(queries).where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).select("vec_id", "v").distinct().orderBy("vec_id", "v").toArrow()
            if rows.num_rows:
                part = _pass(by_norm, _unpack(rows.column("v"), dim), np.array(rows.column("vec_id").to_pylist(), np.int64), turn, seeds, k)
                found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _high(x: np.ndarray) -> np.ndarray:
    """Bounds; what doubles can't tell (or hold) bounds nothing."""
    return np.where(np.isfinite(x), x, np.inf)


def _norm(x: np.ndarray) -> np.ndarray:
    return _high(np.sqrt((x**2).sum(1)))


def _pass(by_norm: DataFrame, queries: np.ndarray, ids: np.ndarray, turn: np.ndarray, seeds: tuple, k: int) -> DataFrame:
    """The best of each partition, for one chunk of queries (nth tells queries of one id apart)."""
    lower = np.full(len(ids), np.iinfo(np.int64).min)
    for a in range(0, len(ids), 1024):
        score = exact(queries[a : a + 1024], seeds[0])
        score[ids[a : a + 1024, None] == seeds[1][None]] = np.iinfo(np.int64).min
        if score.shape[1] >= k:
            lower[a : a + 1024] = np.partition(score, -k, axis=1)[:, -k]
    sent = by_norm.sparkSession.sparkContext.broadcast((queries.astype(np.float32) if _large(queries).max(initial=0) <= 1 << 24 else queries, ids, turn, lower))
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, turn, lower = sent.value
        queries = queries.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = queries @ turn
            length = _norm(turned)
            rest = _norm(turned[:, HEAD:])
        best, over, q_top = Best(len(ids), k), False, _large(queries)
        for batch in batches:
            for a in range(0, 0 if over else batch.num_rows, BLOCK):
                v = _unpack(batch.column(1).slice(a, BLOCK), dim)
                v_ids = batch.column(0).slice(a, BLOCK).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore", invalid="ignore"):
                    t = v @ turn
                    v_length, v_rest = _norm(t), _norm(t[:, HEAD:])
                    need = np.maximum(lower, best.score[:, -1]).astype(np.float64)
                    reach = _high(length * v_length.max(initial=0))
                    slack = 1e-9 * reach + 1e-6
                    live = np.flatnonzero(reach + slack >= need)
                v_top = _large(v)
                over = not len(live)  # nor can any later, shorter vector be among the best
                for b in range(0, len(live), 512):
                    q = live[b : b + 512]
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound = _high(turned[q, :HEAD] @ t[:, :HEAD].T + rest[q, None] * v_rest[None])
                    row, col = np.nonzero((bound + slack[q, None] >= need[q, None]) & (ids[q, None] != v_ids[None]))
                    if len(row):
                        score = paired(queries, v, q[row], col, q_top, v_top)
                        good = score >= np.maximum(lower, best.score[:, -1])[q[row]]
                        if good.any():
                            best.put(q[row[good]], score[good], v_ids[col[good]])
        row, col = np.nonzero(best.id != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(row.astype(np.int32)), pa.array(best.id[row, col]), pa.array(best.score[row, col])], ["query_id", "nth", "vec_id", "score"])

    return by_norm.mapInArrow(run, "query_id long, nth int, vec_id long, score long")
