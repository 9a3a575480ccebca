"""Sampling, balancing and splitting with keyed hashes instead of a sequential generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.operators.position import (
    PACKET_ORDER,
    add_hash_position,
    ensure_position,
    flag_first,
    hash_bucket,
    hash_digits,
    packet_bucket,
    row_hash,
)
from ethersense.session import bounded, local_frame, materialise

TOP_K_LIMIT = 100_000
DRAW_BLOCK = 1 << 16
HASH_DIGITS = 12


def hash_number(digest: Column) -> Column:
    """The first 48 bits of a digest as a whole number."""
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def sample_percent(
    df: DataFrame, percentage: float, seed: int = 42, keys: tuple[str, ...] = PACKET_ORDER
) -> DataFrame:
    """Bernoulli sample; a narrow filter, no shuffle."""
    if percentage >= 100:
        return df
    if percentage <= 0:
        return df.where(F.lit(False))
    cut = int(percentage / 100.0 * 16**HASH_DIGITS)
    return df.where(hash_number(row_hash(seed, *keys)) < cut)


def sample_k(
    df: DataFrame, size: int, seed: int = 42, keys: tuple[str, ...] = PACKET_ORDER
) -> DataFrame:
    """Uniform sample of ``size`` rows: top-k by hash, or the hash of the last one for a large size."""
    if size <= TOP_K_LIMIT:
        ordered = df.withColumn("_digest", row_hash(seed, *keys)).orderBy("_digest", *keys)
        return ordered.limit(size).drop("_digest")
    wanted = local_frame(df.sparkSession, [(size,)], "wanted long")
    return _first_hashes(df, wanted, df.count(), seed, keys, "_taken").where("_taken").drop("_taken")


def _first_hashes(
    df: DataFrame, wanted: DataFrame, rows: int, seed: int, keys: tuple[str, ...], name: str,
    partition: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``name``: whether a row is among the first ``wanted`` ones in hash order."""
    hashed = df.withColumn("_digest", row_hash(seed, *keys))
    return flag_first(
        hashed, wanted, hash_bucket(F.col("_digest"), hash_digits(rows)), ("_digest", *keys), partition=partition, name=name
    ).drop("_digest")


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("label_count")
    )


def downsample(
    df: DataFrame, label: str = "label", seed: int = 42, keys: tuple[str, ...] = PACKET_ORDER
) -> DataFrame:
    """Every class down to the size of the smallest one."""
    labelled = df.where(F.col(label).isNotNull())
    counts = materialise(label_counts(df, label), "label-counts")
    size = counts.agg(F.min("label_count").alias("least"), F.max("label_count").alias("most")).first()
    wanted = counts.select(label, F.lit(size["least"]).cast("long").alias("wanted"))
    kept = _first_hashes(labelled, wanted, size["most"] or 0, seed, keys, "_kept", (label,))
    return kept.where("_kept").drop("_kept")


def upsample(
    df: DataFrame, label: str = "label", seed: int = 42, keys: tuple[str, ...] = PACKET_ORDER
) -> DataFrame:
    """All rows, plus random repeats of each class up to the size of the largest one.

    Draws are counted per drawn row before they meet the rows, so both join sides have unique
    keys even when a class of one row is repeated a billion times. ``copy`` is 0 for the row
    itself and 1.. for its repeats.
    """
    labelled = df.where(F.col(label).isNotNull())
    counts = materialise(label_counts(df, label), "label-counts")
    most = counts.agg(F.max("label_count")).first()[0] or 0
    largest = counts.agg(F.max("label_count").alias("_largest"))
    missing = counts.crossJoin(F.broadcast(largest)).where(F.col("label_count") < F.col("_largest"))
    blocks = missing.select(
        label,
        "label_count",
        (F.col("_largest") - F.col("label_count")).alias("_draws"),
        F.explode(
            F.sequence(
                F.lit(0).cast("long"),
                F.floor((F.col("_largest") - F.col("label_count") - 1) / DRAW_BLOCK),
            )
        ).alias("_block"),
    ).repartition(label, "_block")
    draws = blocks.select(
        label,
        "label_count",
        F.explode(
            F.sequence(
                F.col("_block") * DRAW_BLOCK,
                F.least((F.col("_block") + 1) * DRAW_BLOCK, F.col("_draws")) - 1,
            )
        ).alias("draw"),
    )
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(label), F.col("draw").cast("string")))
    times = (
        draws.select(label, F.pmod(hash_number(digest), F.col("label_count")).alias("hash_pos"))
        .groupBy(label, "hash_pos")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    ranked = add_hash_position(labelled, seed, keys=keys, partition=[label], digits=hash_digits(most))
    repeated = ranked.join(times, [label, "hash_pos"], "left").select(
        *df.columns, F.coalesce("_times", F.lit(0)).alias("_times")
    )
    spread = repeated.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_times") / DRAW_BLOCK)))
        .alias("_block"),
    )
    return spread.select(
        *df.columns,
        F.explode(
            F.sequence(
                F.col("_block") * DRAW_BLOCK,
                F.least((F.col("_block") + 1) * DRAW_BLOCK - 1, F.col("_times")),
            )
        ).alias("copy"),
    )


def class_weights(
    df: DataFrame, label: str = "label", weight: str = "sample_weight"
) -> DataFrame:
    """Attach total / (classes * class count) to every labelled row."""
    counts = label_counts(df, label)
    totals = counts.agg(
        F.sum("label_count").alias("_total"), F.count(F.lit(1)).alias("_classes")
    )
    weights = counts.crossJoin(F.broadcast(totals)).select(
        label,
        (F.col("_total") / (F.col("_classes") * F.col("label_count")).cast("double")).alias(weight),
    )
    return df.where(F.col(label).isNotNull()).join(bounded(weights)[0], label)


def _weighted(df: DataFrame, label: str, seed: int) -> DataFrame:
    return class_weights(df, label)


#: What each name of a strategy does with ``(rows, label, seed)``.
STRATEGIES: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    **dict.fromkeys(("none", "off", ""), lambda df, label, seed: df),
    "downsample": downsample,
    "upsample": lambda df, label, seed: upsample(df, label, seed).drop("copy"),
    **dict.fromkeys(("class_weight", "weights"), _weighted),
}


def balance(df: DataFrame, strategy: str, label: str = "label", seed: int = 42) -> DataFrame:
    if strategy.lower() not in STRATEGIES:
        raise ValueError(f"balance strategy {strategy!r} is none of {', '.join(sorted(filter(None, STRATEGIES)))}")
    return STRATEGIES[strategy.lower()](df, label, seed)


def _train_rows(df: DataFrame, train_fraction: float) -> DataFrame:
    """One row: int(rows * fraction)."""
    total = F.count(F.lit(1)).cast("double") * F.lit(float(train_fraction))
    return df.agg(total.cast("long").alias("wanted"))


def chronological_split(df: DataFrame, train_fraction: float = 0.9) -> DataFrame:
    """First part of the file order is train. Placed rows are judged by their position, others by the packet
    at which the cut falls; the data is neither sorted nor exchanged."""
    if "frame_pos" in df.columns:
        cut = _train_rows(df, train_fraction)
        return df.crossJoin(F.broadcast(cut)).withColumn("is_train", F.col("frame_pos") < F.col("wanted")).drop("wanted")
    if "file_ordinal" not in df.columns:
        return chronological_split(ensure_position(df), train_fraction)
    wanted = _train_rows(df, train_fraction)
    return flag_first(df, wanted, packet_bucket(), PACKET_ORDER, name="is_train")


def shuffled_split(
    df: DataFrame,
    train_fraction: float = 0.9,
    seed: int = 42,
    keys: tuple[str, ...] = PACKET_ORDER,
) -> DataFrame:
    """First part of the hash order is train."""
    wanted = materialise(_train_rows(df, train_fraction), "train-rows")
    rows = int((wanted.first()["wanted"] or 0) / max(train_fraction, 1e-9)) + 1
    return _first_hashes(df, wanted, rows, seed, keys, "is_train")


def split(
    df: DataFrame, train_fraction: float = 0.9, *, chronological: bool = True, seed: int = 42
) -> DataFrame:
    if chronological:
        return chronological_split(df, train_fraction)
    return shuffled_split(df, train_fraction, seed)


def fraction_cuts(df: DataFrame, fractions: list[float]) -> DataFrame:
    """Train and test sizes for every fraction of an experiment."""
    grid = local_frame(df.sparkSession, [(float(f),) for f in fractions], "train_fraction double")
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    cut = (F.col("total_rows").cast("double") * F.col("train_fraction")).cast("long")
    return F.broadcast(grid).crossJoin(total).select(
        "train_fraction", cut.alias("train_rows"), (F.col("total_rows") - cut).alias("test_rows")
    )
