"""Dense global row positions without a one-task window.

File order is part of the data model: count windows, chronological splits, row caps and replay all
number rows. A ``row_number`` without partitions would pull every row into one task. Here rows
are numbered inside *buckets* of bounded size, a small table of bucket counts is turned into
starting offsets, and both are added up.

The bucket must be monotone in the wanted order. Packet order uses blocks of the packet index,
which is unique within its file, so no bucket can exceed the block size whatever the data looks
like; hash order uses leading digits of a hash over a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.session import bounded, local_frame, materialise

BLOCK_BITS = 14
FILE_SHIFT = 40
GROUP_BITS = 10
FEW_BUCKETS = 10_000


def packet_bucket(bits: int = BLOCK_BITS) -> Column:
    """Block of ``2**bits`` packet indexes within a file, increasing in file order."""
    return F.shiftleft(F.col("file_ordinal").cast("long"), FILE_SHIFT) + F.shiftright(
        F.col("packet_index").cast("long"), bits
    )


PACKET_ORDER = ("file_ordinal", "packet_index")


def row_hash(seed: int, *keys: str) -> Column:
    """Keyed digest of a row's identity: the same under any partitioning."""
    columns = keys or PACKET_ORDER
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def prefix_buckets(
    buckets: DataFrame,
    sums: Sequence[str],
    *,
    partition: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Running totals over the ``bucket`` order, *excluding* the bucket itself.

    Adds ``<sum>_before`` for each of ``sums`` and ``<carry>_before`` with the carried value of
    the nearest earlier bucket. ``buckets`` is read more than once, so pass a stored table. Up to
    ``FEW_BUCKETS`` rows are added up on the driver and broadcast; more are done in Spark.
    """
    few = buckets.limit(FEW_BUCKETS + 1).collect()
    if len(few) > FEW_BUCKETS:
        return _prefix_many(buckets, sums, partition, carry)
    out, running, latest = [], {}, {}
    for row in sorted(few, key=lambda r: r["bucket"]):
        key = tuple(row[p] for p in partition)
        total = running.setdefault(key, dict.fromkeys(sums, 0))
        held = latest.setdefault(key, dict.fromkeys(carry))
        out.append((*row, *[total[s] for s in sums], *[held[c] for c in carry]))
        for s in sums:
            total[s] += row[s] or 0
        held.update({c: row[c] for c in carry if row[c] is not None})
    schema = T.StructType([
        *buckets.schema.fields,
        *[T.StructField(f"{s}_before", buckets.schema[s].dataType) for s in sums],
        *[T.StructField(f"{c}_before", buckets.schema[c].dataType) for c in carry],
    ])
    return F.broadcast(local_frame(buckets.sparkSession, out, _nullable(schema)))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _prefix_many(
    buckets: DataFrame, sums: Sequence[str], partition: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Two levels: inside groups of ``2**GROUP_BITS`` neighbouring buckets in parallel, then over
    one row per group."""
    keys = [*partition, "_group"]
    grouped = buckets.withColumn("_group", F.shiftright("bucket", GROUP_BITS))
    coarse = grouped.groupBy(*keys).agg(
        *[F.sum(s).alias(f"_{s}_total") for s in sums],
        *[F.max_by(c, "bucket").alias(f"_{c}_last") for c in carry],
    )
    across = Window.partitionBy(*partition).orderBy("_group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    coarse = coarse.select(
        *keys,
        *[F.coalesce(F.sum(f"_{s}_total").over(across), F.lit(0)).alias(f"_{s}_base")
          for s in sums],
        *[F.last(f"_{c}_last", True).over(across).alias(f"_{c}_base") for c in carry],
    )
    inside = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    fine = grouped.select(
        "*",
        *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_inside") for s in sums],
        *[F.last(c, True).over(inside).alias(f"_{c}_inside") for c in carry],
    )
    joined = fine.join(coarse, keys)
    return joined.select(
        *buckets.columns,
        *[(F.col(f"_{s}_inside") + F.col(f"_{s}_base")).alias(f"{s}_before") for s in sums],
        *[F.coalesce(f"_{c}_inside", f"_{c}_base").alias(f"{c}_before") for c in carry],
    )


def add_position(
    df: DataFrame,
    bucket: Column | None = None,
    order: Sequence[str | Column] = PACKET_ORDER,
    *,
    partition: Sequence[str] = (),
    name: str = "frame_pos",
    below: int | None = None,
    one_value: str | None = None,
) -> DataFrame:
    """Number rows 0..n-1 in ``order`` (per ``partition``), which must be unique.

    Rows that differ in the column ``one_value`` are an error.

    Two passes: one counts per bucket (map-side combined, only the order and filter columns are
    read) and stores that small table, one numbers. The offsets join on the bucket, the same key
    the numbering window is partitioned by, so the rows are exchanged once.
    """
    source = df.withColumn("_bucket", packet_bucket() if bucket is None else bucket)
    ends = [] if one_value is None else [F.min(one_value).alias("_low"), F.max(one_value).alias("_high")]
    counts = materialise(
        source.groupBy(*partition, F.col("_bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), *ends),
        "bucket-counts",
    )
    if one_value is not None:
        seen = counts.agg(F.min("_low").alias("low"), F.max("_high").alias("high")).first()
        if seen["low"] != seen["high"]:
            raise ValueError(f"rows with several values of {one_value} need file_ordinal or frame_pos to have an order")
        counts = counts.drop("_low", "_high")
    offsets = prefix_buckets(counts, ["n"], partition=partition).select(
        *partition, F.col("bucket").alias("_bucket"), F.col("n_before").alias("_before")
    )
    if below is not None:  # later blocks fall out before the exchange
        offsets = offsets.where(F.col("_before") < below)
    within = Window.partitionBy(*partition, "_bucket").orderBy(*order)
    return (
        source.join(offsets, [*partition, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_bucket", "_before")
    )


def add_hash_position(
    df: DataFrame,
    seed: int,
    *,
    keys: Sequence[str] = PACKET_ORDER,
    partition: Sequence[str] = (),
    name: str = "hash_pos",
    digits: int = 4,
) -> DataFrame:
    """Number rows in a seeded pseudo-random order."""
    hashed = df.withColumn("_digest", row_hash(seed, *keys))
    return add_position(
        hashed,
        hash_bucket(F.col("_digest"), digits),
        ["_digest", *keys],
        partition=partition,
        name=name,
    ).drop("_digest")


def flag_first(
    df: DataFrame,
    wanted: DataFrame,
    bucket: Column,
    order: Sequence[str],
    *,
    partition: Sequence[str] = (),
    name: str = "is_first",
) -> DataFrame:
    """Add ``name``: whether a row is among the first ``wanted`` ones of its partition in ``order``.

    ``wanted`` has one row per partition value with the count ``wanted``; rows without one get false. The counts per
    bucket tell in which bucket the cut falls; only the rows of that bucket are ranked, to find the last row that is
    taken, and all others are judged where they are. The data is read three times and never exchanged.
    """
    keys = [*partition]
    source = df.withColumn("_bucket", bucket)
    counts = materialise(
        source.groupBy(*keys, F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    limits = _joined(total, wanted, keys)
    reached = F.col("n_before") + F.col("n")
    cuts = _joined(prefix_buckets(counts, ["n"], partition=keys), limits, keys).where(
        (F.col("wanted") > 0) & (F.col("n_before") < F.col("wanted")) & (reached >= F.col("wanted"))
    ).select(*keys, F.col("bucket").alias("_bucket"), (F.col("wanted") - F.col("n_before")).alias("_need"))
    cuts = bounded(materialise(cuts, "bucket-cuts"))[0]
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = source.select(*dict.fromkeys([*keys, *order, "_bucket"])).join(cuts, [*keys, "_bucket"]).withColumn(
        "_rank", F.row_number().over(within)).where(F.col("_rank") == F.col("_need")).select(
        *keys, F.col("_bucket").alias("_cut"), F.struct(*order).alias("_last"))
    edges = _joined(limits, last, keys, "left").select(
        *keys, "_cut", "_last", (F.col("wanted") >= F.col("_total")).alias("_all"))
    edges = bounded(materialise(edges, "bucket-edges"))[0]
    taken = F.col("_all") | (F.col("_bucket") < F.col("_cut")) | (
        (F.col("_bucket") == F.col("_cut")) & (F.struct(*order) <= F.col("_last")))
    return _joined(source, edges, keys, "left").select(*df.columns, F.coalesce(taken, F.lit(False)).alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys``; without any, ``right`` is a table of at most one row."""
    if keys:
        return left.join(right, [*keys], how)
    return left.join(F.broadcast(right), F.lit(True), how)


def hash_digits(rows: int) -> int:
    """Leading hex digits that cut ``rows`` hashes into buckets of about 2**14."""
    return min(max(4, -(-max(rows - 1, 1).bit_length() // 4) - 3), 12)


def ensure_position(df: DataFrame, name: str = "frame_pos", below: int | None = None) -> DataFrame:
    """Keep an existing position; else number by packet order (one file when no ordinal exists).

    Rows of several files without ``file_ordinal`` have no order, which is an error. ``below`` leaves out
    blocks that begin at that position or later.

    An existing position is trusted to be dense where that matters (count windows, cuts): drop the
    column after filtering rows, and it is numbered anew.
    """
    if name in df.columns:
        return df
    if "file_ordinal" in df.columns:
        return add_position(df, name=name, below=below)
    single = "source_file" if "source_file" in df.columns else None
    numbered = add_position(df.withColumn("file_ordinal", F.lit(0)), name=name, below=below, one_value=single)
    return numbered.drop("file_ordinal")


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], label: str = "ranges"
) -> DataFrame:
    """Inclusive running totals ``<sum>_upto`` over an order of any distribution.

    For already aggregated tables whose order column has unique values. Range partitioning picks
    boundaries from the data, so a crowded value range is spread as well; the partition number is
    written with the rows, because a recomputed sample could draw other boundaries.
    """
    spread = df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id())
    stored = materialise(spread, label)
    totals = prefix_buckets(
        materialise(stored.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in sums]), label), sums
    ).select("bucket", *[f"{s}_before" for s in sums])
    upto = Window.partitionBy("bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return stored.join(totals, "bucket").select(
        *df.columns,
        *[(F.sum(s).over(upto) + F.col(f"{s}_before")).alias(f"{s}_upto") for s in sums],
    )


__all__ = [
    "PACKET_ORDER", "add_hash_position", "add_position", "ensure_position", "flag_first", "hash_bucket", "hash_digits",
    "packet_bucket", "prefix_buckets", "row_hash", "running_totals",
]
