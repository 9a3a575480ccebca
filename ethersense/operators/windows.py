"""Presence windows over predictions: count windows, time windows, replay, state changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.functions.columns import (
    parse_probabilities,
    target_probability,
    time_bucket,
)
from ethersense.operators.position import BLOCK_BITS, ensure_position, prefix_buckets
from ethersense.schemas import column_or_null
from ethersense.session import bounded, local_frame, materialise

FRAME_COUNT, TIME = "frame_count", "time"
STATES = ["present", "absent", "uncertain"]
MEAN_DIGITS = 12


@dataclass(frozen=True)
class WindowSettings:
    frame_count: int = 100
    time_seconds: float = 30.0
    min_frames: int = 5
    present_ratio_threshold: float = 0.5
    mean_probability_threshold: float = 0.5
    max_probability_threshold: float = 0.8

    def with_thresholds(self, ratio: float, mean: float, maximum: float) -> WindowSettings:
        return replace(
            self,
            present_ratio_threshold=ratio,
            mean_probability_threshold=mean,
            max_probability_threshold=maximum,
        )


def presence_state(
    frames: Column, ratio: Column, mean: Column, maximum: Column, settings: WindowSettings
) -> Column:
    def reached(value: Column, threshold: float) -> Column:
        return F.coalesce(value >= F.lit(float(threshold)), F.lit(False))

    ratio_ok = reached(ratio, settings.present_ratio_threshold)
    mean_ok = reached(mean, settings.mean_probability_threshold)
    max_ok = reached(maximum, settings.max_probability_threshold)
    return (
        F.when(frames < settings.min_frames, "uncertain")
        .when(ratio_ok & (mean_ok | max_ok), "present")
        .when(~(ratio_ok | mean_ok | max_ok), "absent")
        .otherwise("uncertain")
    )


def per_target(preds: DataFrame, targets: Sequence[str], *, keep: Sequence[str]) -> DataFrame:
    """One row per prediction and target with the target's probability and hit flags.

    The probability text is parsed once, before the rows are multiplied; the multiplication is
    narrow and everything after it aggregates on the map side first.
    """
    if "probabilities" in preds.columns:
        probabilities = F.col("probabilities")
    else:
        probabilities = parse_probabilities(column_or_null(preds, "probabilities_json", "string"))
    base = preds.select(
        *keep,
        probabilities.alias("_probs"),
        column_or_null(preds, "predicted_class", "string").alias("_class"),
        column_or_null(preds, "confidence", "double").alias("_conf"),
        column_or_null(preds, "ground_truth", "string").alias("_truth"),
    )
    names = F.array(*[F.lit(str(t)) for t in dict.fromkeys(targets)])
    crossed = base.select("*", F.explode(names).alias("target_id"))
    return crossed.select(
        *keep,
        "target_id",
        target_probability(F.col("_probs"), F.col("_class"), F.col("_conf"), F.col("target_id"))
        .alias("p"),
        F.col("_class").eqNullSafe(F.col("target_id")).cast("long").alias("hit"),
        F.col("_truth").eqNullSafe(F.col("target_id")).cast("long").alias("truth"),
    )


FEW_TARGETS = 32
MANY_TARGETS = 1_000_000
_MARK = "struct<target_id:string,p:double,hit:bigint,truth:bigint>"


def target_table(spark: SparkSession, targets: Sequence[str] | DataFrame) -> DataFrame:
    """The distinct targets as a table."""
    if isinstance(targets, DataFrame):
        return targets.where(F.col("target_id").isNotNull()).select("target_id").distinct()
    return local_frame(spark, [(str(t),) for t in dict.fromkeys(targets)], "target_id string")


def _few(targets: Sequence[str] | DataFrame) -> list[str] | None:
    """The distinct targets, where they are few enough for a plan."""
    if isinstance(targets, DataFrame):
        return None
    names = [str(t) for t in dict.fromkeys(targets)]
    return names if len(names) <= FEW_TARGETS else None


def with_marks(preds: DataFrame, targets: Sequence[str] | DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """``keep`` and one short array per row: the targets that the row says anything about.

    These are its listed, predicted and true classes; for every other target the row counts with probability 0.
    With few targets the others are left out here, so that no text of probabilities is exchanged later.
    """
    if "probabilities" in preds.columns:
        probabilities = F.col("probabilities")
    else:
        probabilities = parse_probabilities(column_or_null(preds, "probabilities_json", "string"))
    base = preds.select(
        *keep,
        probabilities.alias("_probs"),
        column_or_null(preds, "predicted_class", "string").alias("_class"),
        column_or_null(preds, "confidence", "double").alias("_conf"),
        column_or_null(preds, "ground_truth", "string").alias("_truth"),
    )
    names = F.concat(F.coalesce(F.map_keys("_probs"), F.array().cast("array<string>")), F.array("_class", "_truth"))
    names = F.array_compact(F.array_distinct(names))
    if _few(targets) is not None:
        names = F.filter(names, lambda n: n.isin(_few(targets)))
    marks = F.transform(names, lambda n: F.struct(
        n.alias("target_id"), target_probability(F.col("_probs"), F.col("_class"), F.col("_conf"), n).alias("p"),
        F.col("_class").eqNullSafe(n).cast("long").alias("hit"), F.col("_truth").eqNullSafe(n).cast("long").alias("truth"),
    ))
    return base.select(*keep, marks.alias("_marks"))


def marked_stats(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums per ``keys`` and class, and one row per ``keys`` with a null class that counts all rows."""
    everyone = F.array(F.lit(None).cast(_MARK))
    rows = marked.select(*keys, F.explode(F.concat(everyone, "_marks")).alias("_mark")).select(*keys, "_mark.*")
    return rows.groupBy(*keys, "target_id").agg(*partial_stats())


def fill_targets(stats: DataFrame, keys: Sequence[str], targets: Sequence[str] | DataFrame) -> DataFrame:
    """Every target of every window, out of the sums of those that its rows mention.

    No row of the data meets the target list: what a window lacks is added to the window itself.
    """
    few = _few(targets)
    if few is None:
        table = bounded(target_table(stats.sparkSession, targets), MANY_TARGETS)[0]
        stats = stats.join(table.withColumn("_wanted", F.lit(True)), "target_id", "left").where(
            F.col("target_id").isNull() | F.col("_wanted"))
    entry = F.struct("target_id", F.col("n").alias("m"), "sum_p", "max_p", "hits", "truths")
    windows = stats.groupBy(*keys).agg(
        F.max(F.when(F.col("target_id").isNull(), F.col("n"))).alias("n"),
        F.collect_list(F.when(F.col("target_id").isNotNull(), entry)).alias("_listed"),
    )
    if few is None:
        windows = windows.crossJoin(F.broadcast(table.agg(F.sort_array(F.collect_list("target_id")).alias("_all"))))
    else:
        windows = windows.withColumn("_all", F.lit(few).cast("array<string>"))
    lacking = F.array_except("_all", F.transform("_listed", lambda e: e["target_id"]))
    absent = F.transform(lacking, lambda t: F.struct(
        t.alias("target_id"), F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("sum_p"), F.lit(0.0).alias("max_p"),
        F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("truths")))
    filled = windows.select(*keys, "n", F.explode(F.concat("_listed", absent)).alias("_e"))
    short = F.col("_e.m") < F.col("n")
    return filled.select(
        *keys, F.col("_e.target_id").alias("target_id"), "n", F.col("_e.sum_p").alias("sum_p"),
        F.when(short, F.greatest("_e.max_p", F.lit(0.0))).otherwise(F.col("_e.max_p")).alias("max_p"),
        F.col("_e.hits").alias("hits"), F.col("_e.truths").alias("truths"),
    )


def partial_stats() -> list[Column]:
    """Mergeable window statistics."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("sum_p"),
        F.max("p").alias("max_p"),
        F.sum("hit").alias("hits"),
        F.sum("truth").alias("truths"),
    ]


def merge_stats() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("sum_p").alias("sum_p"),
        F.max("max_p").alias("max_p"),
        F.sum("hits").alias("hits"),
        F.sum("truths").alias("truths"),
    ]


def summary_columns() -> list[Column]:
    """Window columns out of merged statistics. Means are rounded so that the order in which
    doubles were added cannot move one across a threshold."""
    return [
        F.col("n").alias("frame_count"),
        F.round(F.col("sum_p") / F.col("n"), MEAN_DIGITS).alias("mean_probability"),
        F.col("max_p").alias("max_probability"),
        (F.col("hits") / F.col("n")).alias("positive_prediction_ratio"),
    ]


def marked(preds: DataFrame, targets: Sequence[str] | DataFrame) -> DataFrame:
    """Predictions as marks beside what places and times them; marked ones stay as they are."""
    if "_marks" in preds.columns:
        return preds
    places = ("file_ordinal", "source_file", "packet_index", "frame_pos", "timestamp")
    return with_marks(preds, targets, keep=[c for c in places if c in preds.columns])


def frame_window_stats(
    preds: DataFrame, targets: Sequence[str] | DataFrame, settings: WindowSettings
) -> DataFrame:
    """Chunks of ``frame_count`` rows in file order; the end position is inclusive."""
    size = settings.frame_count
    placed = ensure_position(marked(preds, targets))
    rows = placed.withColumn("window_seq", F.floor(F.col("frame_pos") / size))
    grouped = fill_targets(marked_stats(rows, ["window_seq"]), ["window_seq"], targets)
    return grouped.select(
        "target_id",
        F.lit(FRAME_COUNT).alias("window_type"),
        "window_seq",
        (F.col("window_seq") * size).cast("double").alias("window_start"),
        (F.col("window_seq") * size + F.col("n") - 1).cast("double").alias("window_end"),
        "n", "sum_p", "max_p", "hits", "truths",
    )


def time_window_stats(
    preds: DataFrame, targets: Sequence[str] | DataFrame, settings: WindowSettings
) -> DataFrame:
    """Epoch-aligned tumbling windows; the end is exclusive and null timestamps are skipped."""
    seconds = float(settings.time_seconds)
    timed = preds.where(F.col("timestamp").isNotNull()).withColumn(
        "window_seq", time_bucket(F.col("timestamp"), seconds)
    )
    rows = timed if "_marks" in timed.columns else with_marks(timed, targets, keep=["window_seq"])
    grouped = fill_targets(marked_stats(rows, ["window_seq"]), ["window_seq"], targets)
    return grouped.select(
        "target_id",
        F.lit(TIME).alias("window_type"),
        "window_seq",
        (F.col("window_seq") * seconds).alias("window_start"),
        (F.col("window_seq") * seconds + seconds).alias("window_end"),
        "n", "sum_p", "max_p", "hits", "truths",
    )


def window_stats(
    preds: DataFrame,
    targets: Sequence[str] | DataFrame,
    settings: WindowSettings,
    kinds: Sequence[str] = (FRAME_COUNT, TIME),
) -> DataFrame:
    """Only the count windows pay for positions; the time windows aggregate straight off the scan."""
    unknown = sorted(set(kinds) - {FRAME_COUNT, TIME})
    if unknown:
        raise ValueError(f"unsupported window type(s): {', '.join(unknown)}")
    parts = []
    if FRAME_COUNT in kinds:
        parts.append(frame_window_stats(preds, targets, settings))
    if TIME in kinds:
        parts.append(time_window_stats(preds, targets, settings))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def with_state(stats: DataFrame, settings: WindowSettings, *extra: str) -> DataFrame:
    shaped = stats.select(
        "window_start", "window_end", "target_id", *summary_columns(), "window_type",
        "window_seq", *extra,
    )
    return shaped.withColumn(
        "state",
        presence_state(
            F.col("frame_count"),
            F.col("positive_prediction_ratio"),
            F.col("mean_probability"),
            F.col("max_probability"),
            settings,
        ),
    )


def presence_windows(
    preds: DataFrame,
    targets: Sequence[str] | DataFrame,
    settings: WindowSettings = WindowSettings(),
    kinds: Sequence[str] = (FRAME_COUNT, TIME),
) -> DataFrame:
    """Windows of each kind for every target, with their three-valued state."""
    return with_state(window_stats(preds, targets, settings, kinds), settings)


def replay_time_stats(
    preds: DataFrame,
    targets: Sequence[str] | DataFrame,
    settings: WindowSettings,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Time windows as a row-by-row replay closes them.

    A window ends when the next timed row falls into *another* bucket, so a row that arrives out
    of order opens a second window for an old bucket. Islands of equal buckets are numbered inside
    position blocks; one row per block then tells whether its first island continues the last
    one of the block before, which gives every block its island offset.
    """
    seconds = float(settings.time_seconds)
    placed = ensure_position(marked(preds, targets))
    timed = placed.where(F.col("timestamp").isNotNull()).select(
        "*",
        time_bucket(F.col("timestamp"), seconds).alias("tb"),
        F.shiftright("frame_pos", block_bits).alias("bucket"),
    )
    in_block = Window.partitionBy("bucket").orderBy("frame_pos")
    flagged = timed.withColumn("_prev", F.lag("tb").over(in_block)).withColumn(
        "local", F.sum((~F.col("tb").eqNullSafe(F.col("_prev"))).cast("long")).over(in_block)
    )
    # the rows are gone over once: islands, their order and their sums all follow from the fragments
    fragments = materialise(marked_stats(flagged, ["bucket", "local", "tb"]), "replay-fragments")
    blocks = materialise(
        fragments.where(F.col("target_id").isNull()).groupBy("bucket").agg(
            F.max("local").alias("islands"),
            F.min_by("tb", "local").alias("first_tb"),
            F.max_by("tb", "local").alias("last_tb"),
        ),
        "replay-blocks",
    )
    chained = prefix_buckets(blocks, ["islands"], carry=["last_tb"])
    joins = chained.withColumn(
        "merged", F.col("first_tb").eqNullSafe(F.col("last_tb_before")).cast("long")
    )
    offsets = prefix_buckets(
        joins.select("bucket", "merged", "islands_before"), ["merged"]
    ).select(
        "bucket",
        (F.col("islands_before") - F.col("merged_before") - F.col("merged")).alias("offset"),
    )
    merged = (
        fragments.join(offsets, "bucket")
        .withColumn("window_seq", F.col("local") + F.col("offset") - 1)
        .groupBy("target_id", "window_seq", "tb")
        .agg(*merge_stats())
    )
    islands = fill_targets(merged, ["window_seq", "tb"], targets)
    last = offsets.join(blocks, "bucket").agg(
        F.max(F.col("offset") + F.col("islands") - 1).alias("_last")
    )
    return islands.crossJoin(F.broadcast(last)).select(
        "target_id",
        F.lit(TIME).alias("window_type"),
        "window_seq",
        (F.col("tb") * seconds).alias("window_start"),
        ((F.col("tb") + 1) * seconds).alias("window_end"),
        "n", "sum_p", "max_p", "hits", "truths",
        (F.col("window_seq") == F.col("_last")).alias("final_window"),
    )


def replay_windows(
    preds: DataFrame,
    targets: Sequence[str] | DataFrame,
    settings: WindowSettings = WindowSettings(),
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """What a replay of the stored rows emits, including the windows flushed at the end."""
    numbered = ensure_position(marked(preds, targets))
    # two readers follow (count windows, islands): number the rows once
    placed = materialise(numbered.select("frame_pos", "timestamp", "_marks"), "replay")
    frames = frame_window_stats(placed, targets, settings).withColumn(
        "final_window", F.col("n") < settings.frame_count
    )
    timed = replay_time_stats(placed, targets, settings, block_bits)
    return with_state(frames.unionByName(timed), settings, "final_window")


def state_changes(
    events: DataFrame, sequence: str = "window_seq", block_bits: int = BLOCK_BITS,
    *, stored: bool = False,
) -> DataFrame:
    """Events whose state differs from the one before in their (target, window type).

    One target may own most windows, so the order is cut into blocks and the last state of the
    previous block is carried over. Pass ``stored`` when the events already come from a table.
    """
    keys = ["target_id", "window_type"]
    if not stored:
        events = materialise(events, "presence-events")
    cut = events.withColumn("bucket", F.shiftright(sequence, block_bits))
    closing = cut.groupBy(*keys, "bucket").agg(F.max_by("state", sequence).alias("closing"))
    carried = prefix_buckets(
        materialise(closing, "closing-states"),
        [],
        partition=keys,
        carry=["closing"],
    ).select(*keys, "bucket", "closing_before")
    in_block = Window.partitionBy(*keys, "bucket").orderBy(sequence)
    return (
        cut.join(carried, [*keys, "bucket"])
        .withColumn("_previous", F.coalesce(F.lag("state").over(in_block), "closing_before"))
        .where(~F.col("state").eqNullSafe(F.col("_previous")))
        .select(*events.columns)
    )


@F.pandas_udf(T.StringType())
def _three_decimals(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "n/a" if v != v else f"{v:.3f}")


def event_text(df: DataFrame) -> Column:
    """One readable line per event. Three-decimal text is rounded from the exact binary value,
    which the JVM formatter does not do, hence the small Arrow step."""
    return F.concat(
        F.col("window_type"), F.lit(" target="), F.col("target_id"),
        F.lit(" state="), F.col("state"),
        F.lit(" frames="), F.col("frame_count").cast("string"),
        F.lit(" mean="), _three_decimals("mean_probability"),
        F.lit(" max="), _three_decimals("max_probability"),
        F.lit(" positive_ratio="), _three_decimals("positive_prediction_ratio"),
    )
