"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.llm.vectors import deal, matrix, nearest, usable
from ethersense.session import materialise

SCHEMA = "query_id long, vec_id long, score long"


def _search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, step: int):
    """Best ``k`` rows of ``x`` for each row of ``q`` by integer inner product.

    ``x`` lies in columns (dimension by row). Dimensions are added ``step`` at a time, those with most of the
    queries' mass first. What the open dimensions can still add or take is at most the product of the
    remaining norms, so a row leaves once its upper bound is below the ``k``-th best lower bound.
    """
    order = np.argsort(-(q.astype(float) ** 2).sum(0), kind="stable")
    q, columns = q[:, order], np.ascontiguousarray(x[:, order].T)
    edges = list(range(0, len(order), step)) + [len(order)]
    mass_q = np.sqrt(np.cumsum((q.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1])
    mass_x = np.sqrt(np.cumsum((columns.astype(float) ** 2)[::-1], axis=0)[::-1])
    for i in range(len(q)):
        alive = np.flatnonzero(x_id != q_id[i])
        score = np.zeros(len(alive), q.dtype)
        for lo, hi in zip(edges, edges[1:]):
            block = columns[lo:hi] if len(alive) == columns.shape[1] else columns[lo:hi, alive]
            score = score + q[i, lo:hi] @ block
            if hi < len(order) and len(alive) > k:
                rest = mass_q[i, hi] * mass_x[hi, alive] * (1 + 1e-9) + 1
                bar = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                keep = score + rest >= bar
                alive, score = alive[keep], score[keep]
        best = np.lexsort((x_id[alive], -score))[:k]
        yield q_id[i], x_id[alive[best]], score[best]


def _blocks(k: int, scale: float, step: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, near, score = [], [], []
        if left.num_rows and right.num_rows:
            x, q = np.floor(scale * matrix(left.column("x"))), np.floor(scale * matrix(right.column("x")))
            if np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2.0**52:  # doubles would round
                x, q = x.astype(np.int64), q.astype(np.int64)
            x_id, q_id = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
            for i, found, scores in _search(q, q_id, x, x_id, k, step):
                ids.append(np.full(len(found), i))
                near.append(found)
                score.append(scores.astype(np.int64))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": join(ids), "vec_id": join(near), "score": join(score)})

    return run


def exact_top_k(
    vectors: DataFrame, every: int, k: int, scale: float = 256.0, rows: int = 1024, queries: int = 256, step: int = 8
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of ``floor(scale * x)``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id and
    as many components. Ties go to the smaller id; a query with fewer candidates gets them all. ``usable`` says
    which rows take part. Scores are exact while they fit 64 bits. Blocks of ``rows`` vectors meet blocks
    of ``queries`` in tasks of fixed size, whatever the values are.
    """
    table = materialise(usable(vectors, nonzero=False).withColumn("dim", F.size("x")), "vectors")
    asked = table.where(F.col("vec_id") % every == 0)
    n, m = table.count(), asked.count()
    x_blocks, q_blocks = -(-n // rows), -(-m // queries)
    x_all, q_all = (F.explode(F.sequence(F.lit(0), F.lit(max(1, b) - 1))) for b in (x_blocks, q_blocks))
    left = table.withColumn("x_block", deal(F.col("vec_id"), x_blocks)).withColumn("q_block", q_all)
    right = asked.withColumn("q_block", deal(F.col("vec_id") + 1, q_blocks)).withColumn("x_block", x_all)
    keys = ["dim", "x_block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_blocks(k, scale, step), SCHEMA)
    return nearest(found, k)
