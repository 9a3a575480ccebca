"""Shared parts of the vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``(vec_id, x)`` with one row per id: the rows that take part in a search.

    Rows without id, without vector, or with null or non-finite components fall out, with ``nonzero`` those of
    length zero too. Of rows that share an id the smallest vector counts.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    )
    if nonzero:
        rows = rows.where(F.exists("x", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def deal(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, parts))).cast("int")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten(), float).reshape(len(array), -1) if len(array) else np.empty((0, 0))


def nearest(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query, ties to the smaller id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score
    )
