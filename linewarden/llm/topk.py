"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

For a segment of length L, the squared distance of two vectors is at least
``L * ((mean - mean')^2 + (dev - dev')^2)``.  With the norms this bounds the inner product from
above by ``sum of L * (mean * mean' + dev * dev')`` over the segments, and finer segments bound it
closer.  Queries and vectors meet in blocks of bounded size; in a pair of blocks each level keeps
what may still enter the current top k, and only those pairs are computed exactly.  The tops of
the block pairs are ranked per query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different lengths are never compared; a repeated query row counts once and a repeated
candidate row each time; rows with the query's id are not its candidates; ties go to the smaller
id; a query with fewer candidates gets all of them; an empty table gives no rows.  Scores are
64-bit integers.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Segments of each level, coarse to fine.
LEVELS = (8, 32)
#: Rows of a block of queries and of vectors, and vectors that a task compares at once.
QUERY_BLOCK, VECTOR_BLOCK, SLICE = 2048, 16384, 2048
#: Share of pairs from which a full matrix product is cheaper than single pairs.
DENSE = 0.1

_NONE = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``vec_id`` and the components as integers, without the vectors that take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    )
    return vectors.where(F.col("vec_id").isNotNull() & usable).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * factor)).alias("values")
    )


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments, each times the root of the segment's length."""
    starts = np.arange(n) * x.shape[1] // n
    lengths = np.diff(starts, append=x.shape[1])
    means = np.add.reduceat(x, starts, 1) / lengths
    rest = x - np.repeat(means, lengths, 1)
    devs = np.sqrt(np.add.reduceat(rest * rest, starts, 1) / lengths)
    return np.concatenate([means, devs], 1) * np.sqrt(np.concatenate([lengths, lengths]))


def _products(q: np.ndarray, c: np.ndarray, open_: np.ndarray, exact: bool) -> np.ndarray:
    """Products of the open pairs; the others are minus infinity, or ``_NONE`` if exact."""
    out = np.full(open_.shape, _NONE if exact else -np.inf, np.int64 if exact else float)
    if np.count_nonzero(open_) > DENSE * open_.size:
        full = q @ c.T
        out[open_] = full[open_]
        return out
    rows = np.flatnonzero(open_.any(1))
    for i in rows:
        js = np.flatnonzero(open_[i])
        out[i, js] = c[js] @ q[i]
    return out


def block_top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int):
    """Up to k best (query row, id, score) of one block pair, and how many pairs were computed."""
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    levels = [n for n in LEVELS if n < q.shape[1]]
    real_q, real_c = q.astype(float), c.astype(float)
    # sums of products up to 2 ** 53 are exact as floating-point numbers, and those are faster
    size = max(np.abs(real_q).max(), np.abs(real_c).max())
    exact_q, exact_c = (real_q, real_c) if size * size * q.shape[1] < 2**53 else (q, c)
    slack = 1e-9 * (1 + size * size * q.shape[1])
    stats_q = [_segments(real_q, n) for n in levels]
    best = np.full((len(q), k), _NONE, np.int64)
    who = np.zeros((len(q), k), np.int64)
    computed = 0
    for start in range(0, len(c), SLICE):
        part = slice(start, start + SLICE)
        open_ = query_ids[:, None] != ids[None, part]
        # ids rise, so a later vector must exceed the k-th best score
        least = best[:, -1:]
        for stats, n in zip(stats_q, levels, strict=True):
            if (least == _NONE).all():
                break
            bound = _products(stats, _segments(real_c[part], n), open_, exact=False)
            open_ &= (bound + slack > least) | (least == _NONE)
        computed += np.count_nonzero(open_)
        scores = _products(exact_q, exact_c[part], open_, exact=True)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            continue
        all_scores = np.concatenate([best[rows], scores[rows]], 1)
        all_ids = np.concatenate([who[rows], np.broadcast_to(ids[part], scores[rows].shape)], 1)
        # a stable order of falling scores; ~x falls as x rises and never overflows
        top = np.argsort(~all_scores, axis=1, kind="stable")[:, :k]
        best[rows] = np.take_along_axis(all_scores, top, 1)
        who[rows] = np.take_along_axis(all_ids, top, 1)
    i, j = np.nonzero(best != _NONE)
    return query_ids[i], who[i, j], best[i, j], computed


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256) -> DataFrame:
    """Each query's k highest integer inner products over all other vectors."""
    rows = written(
        scaled(vectors, factor).select(
            "vec_id", "values", F.size("values").alias("dims"), is_query.alias("is_query")
        ), "vectors",
    )
    queries = rows.where("is_query").dropDuplicates(["vec_id"])
    n = rows.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries")).first()
    vector_blocks = max(1, -(-n["rows"] // VECTOR_BLOCK))
    query_blocks = max(1, -(-n["queries"] // QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(
        "vec_id", "values", "dims", block(query_blocks).alias("query_block"),
        every(vector_blocks).alias("vector_block"),
    )
    right = rows.select(
        "vec_id", "values", "dims", every(query_blocks).alias("query_block"),
        block(vector_blocks).alias("vector_block"),
    )
    keys = ["dims", "query_block", "vector_block"]
    schema = "query_id long, vec_id long, score long"
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            return arrow.empty_table()
        query_ids, ids, scores, _ = block_top(
            q["vec_id"].to_numpy(), _matrix(q["values"], q.num_rows),
            c["vec_id"].to_numpy(), _matrix(c["values"], c.num_rows), k,
        )
        return pa.table([query_ids, ids, scores], schema=arrow)

    tops = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)
    place = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    )
    return tops.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
