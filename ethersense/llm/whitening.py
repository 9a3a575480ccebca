"""Embedding whitening with distributed block matrices.

Centred rows are dealt by a dense index into blocks of a ``BlockMatrix``; its transpose times itself is the scatter
matrix, whose eigenvectors (one small matrix of dimensions by dimensions) are found on the driver; a second block
product projects every row.

Vectors are read on an integer lattice, ``x = floor(scale * c) + offset``, so that sums and squared deviations are exact.

* Null vectors, empty ones and those holding null or non-finite entries are left out.
* Rows count one by one: a repeated ``vec_id``, or a null one, gives its rows as often as it stands there. In the fit
  each distinct lattice vector counts once.
* A covariance needs one length: vectors of another length than the most common one (ties: the longer) are left out.
* Components without variance (fewer distinct vectors than dimensions, equal vectors) have ``whitened`` null and take no
  part in ``identity_error``; without any variance ``explained`` and ``identity_error`` are null too.
* Entries beyond 2**62 on the lattice are held there; a deviation that does not fit 64 bits is null.
* An empty table gives no rows. Other columns than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.operators.position import prefix_buckets
from ethersense.session import local_frame, materialise

BLOCK_BYTES = 1 << 21
#: Row blocks that meet in one task of a scatter product.
BLOCKS_PER_TASK = 4
_EDGE = float(1 << 62)

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def lattice(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """``(vec_id, x)``: every usable vector on the integer lattice."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_c"))
    bad = F.exists("_c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.least(F.greatest(v * float(scale), F.lit(-_EDGE)), F.lit(_EDGE))
    x = F.transform("_c", lambda v: F.floor(held(v)).cast("long") + F.lit(offset))
    return rows.where(F.col("_c").isNotNull() & (F.size("_c") > 0) & ~bad).select("vec_id", x.alias("x"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored with a dense ``row_index``: place inside the partition that wrote them plus the rows before it."""
    place = F.monotonically_increasing_id()
    stored = materialise(
        rows.withColumn("bucket", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))), name
    )
    counts = materialise(stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    before = prefix_buckets(counts, ["n"]).select("bucket", "n_before")
    return stored.join(before, "bucket").withColumn("row_index", F.col("n_before") + F.col("_place")).drop("bucket", "_place", "n_before")


def block_matrix(rows: DataFrame, values: Column, n: int, width: int, per_block: int) -> BlockMatrix:
    """The rows of ``(row_index, values)`` as blocks of ``per_block`` rows and all columns."""
    frame = rows.select(F.col("row_index").alias("index"), array_to_vector(values).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(frame, "vector"), n, width).toBlockMatrix(per_block, width)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """``matrix`` transposed times itself. The inner dimension is split over tasks, or all blocks of this one
    result block would meet in one task."""
    turned = matrix.transpose()
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_PER_TASK))
    product = turned._java_matrix_wrapper._java_model.multiply(matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """``matrix`` times the small matrix ``weights``."""
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("vector", VectorUDT())])
    rows = local_frame(spark, [(i, Vectors.dense(w)) for i, w in enumerate(weights.tolist())], schema)
    right = IndexedRowMatrix(rows, *weights.shape).toBlockMatrix(matrix.colsPerBlock, weights.shape[1])
    return matrix.multiply(right)


def matrix_rows(matrix: BlockMatrix) -> DataFrame:
    """``(row_index, values)`` of a block matrix, without a turn through Python."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("row_index"), vector_to_array("vector").alias("values"))


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, explained)`` of the leading components that have variance; weights are eigenvectors over the
    square root of their eigenvalue, one column a component."""
    cov = scatter / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, len(values))]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(cov))
    real = values > len(cov) * np.finfo(float).eps * max(float(values.max(initial=0.0)), 0.0)
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    return (vectors * signs)[:, real] / np.sqrt(values[real]), explained


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per usable vector and leading component, see ``SCHEMA``."""
    spark = vectors.sparkSession
    rows = lattice(vectors, scale, offset)
    widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if widths is None:
        return spark.createDataFrame([], SCHEMA)
    d = widths["d"]
    rows = rows.where(F.size("x") == d)
    fit = numbered(rows.select("x").distinct(), "whitening-fit")
    stats = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    stats = sorted(stats.collect())  # one row a dimension
    n, sums = stats[0]["n"], [int(r["s"]) for r in stats]
    exact = all(abs(s) < 1 << 62 for s in sums)
    total = F.lit([s if exact else 0 for s in sums]).cast("array<long>")
    means = F.lit([s / n for s in sums]).cast("array<double>")
    far = F.zip_with("x", total, lambda v, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), v), s))
    centred = F.zip_with(
        far if exact else F.transform("x", lambda v: F.lit(None).cast("long")),
        F.zip_with("x", means, lambda v, m: v.cast("double") - m),
        lambda a, b: F.coalesce(a.cast("double") / F.lit(float(n)), b),
    )
    deviation = F.aggregate(
        far, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v))
    ) if exact else F.lit(None).cast("long")

    per_block = max(64, BLOCK_BYTES // (8 * d))
    fitted = block_matrix(fit, centred, n, d, per_block)
    weights, explained = whitening_matrix(gram(fitted), n, components)
    kept = weights.shape[1]
    everything = numbered(rows, "whitening-rows")
    out = everything.select("row_index", "vec_id", deviation.alias("deviation"))
    error = None
    if kept:
        white = project(spark, fitted, weights)
        error = float(np.abs(gram(white) / n - np.eye(kept)).max())  # projections of centred rows are centred
        size = everything.count()
        projected = matrix_rows(project(spark, block_matrix(everything, centred, size, d, per_block), weights))
        out = out.join(projected, "row_index")
    else:
        out = out.withColumn("values", F.array().cast("array<double>"))
    shares = F.lit([float(e) for e in explained]).cast("array<double>")
    return out.select("vec_id", "deviation", "values", F.posexplode(shares).alias("pos", "share")).select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("values", F.col("pos")).alias("whitened"),
        F.nanvl("share", F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
