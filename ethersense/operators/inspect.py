"""Capture inspection: counts, coverage, rankings and rule-based warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethersense.functions.columns import FAMILIES, frame_family
from ethersense.operators.labels import lookup_targets
from ethersense.operators.position import running_totals
from ethersense.schemas import column_or_null
from ethersense.session import local_frame

COVERAGE_FIELDS = ["data_rate", "channel_frequency", "rssi_or_ssi"]

# The warning texts.
NO_FILES = "No capture files were found."
NONE_PARSED = "No 802.11 Dot11 frames were parsed from the scanned packets."
MANY_FAILED = "At least 20% of scanned packets failed 802.11 parsing."
NO_RATE = "No Radiotap data-rate values were observed."
NO_SIGNAL = "No Radiotap RSSI/SSI signal values were observed."
NO_PROTECTED = (
    "No protected 802.11 frames were observed; encrypted-network runs usually need them."
)
NO_TARGET = "No source MACs matched enabled targets in the configured registry."


def _parsed(df: DataFrame) -> Column:
    if "parse_ok" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col("parse_ok"), F.lit(False))


def _signal(df: DataFrame) -> Column:
    return F.coalesce(column_or_null(df, "rssi", "double"), column_or_null(df, "ssi", "double"))


def _mac(df: DataFrame, name: str) -> Column:
    value = column_or_null(df, name, "string")
    return F.when(value != "", value)


def capture_summary(records: DataFrame) -> DataFrame:
    """One row of totals.

    Distinct addresses are counted from per-address groups rather than by a multi-distinct
    aggregate, which would copy every row once per distinct column.
    """
    scan = records.select(
        _parsed(records).alias("ok"),
        F.coalesce(column_or_null(records, "protected", "boolean"), F.lit(False)).alias("protected"),
        column_or_null(records, "channel_frequency", "int").alias("channel"),
    )
    totals = scan.agg(
        F.count(F.lit(1)).alias("packets_scanned"),
        F.count_if("ok").alias("parse_successes"),
        F.count_if(~F.col("ok")).alias("parse_failures"),
        F.count_if("protected").alias("protected_frame_count"),
        # channels are a small fixed set of frequencies
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channel_frequencies"),
    )
    macs = address_counts(records).groupBy().agg(
        F.count_if(F.col("side") == "source").alias("source_mac_count"),
        F.count_if(F.col("side") == "destination").alias("destination_mac_count"),
    )
    return totals.crossJoin(macs).withColumn(
        "parse_failure_rate",
        F.coalesce(F.try_divide(F.col("parse_failures"), F.col("packets_scanned")), F.lit(0.0)),
    )


def family_counts(records: DataFrame) -> DataFrame:
    """All five families, zero counts included; a null type counts as unknown."""
    family = F.coalesce(frame_family(column_or_null(records, "frame_type", "int")), F.lit("unknown"))
    counted = records.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    names = local_frame(records.sparkSession, [(f,) for f in FAMILIES], "family string")
    return names.join(counted, "family", "left").select(
        "family", F.coalesce("n", F.lit(0)).alias("frames")
    )


def field_coverage(records: DataFrame) -> DataFrame:
    sums = records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(column_or_null(records, "data_rate", "double")).alias("data_rate"),
        F.count(column_or_null(records, "channel_frequency", "int")).alias("channel_frequency"),
        F.count(_signal(records)).alias("rssi_or_ssi"),
    )
    return sums.unpivot("total", COVERAGE_FIELDS, "field", "present").select(
        "field",
        "present",
        (F.col("total") - F.col("present")).alias("missing"),
        F.coalesce(F.try_divide("present", "total"), F.lit(0.0)).alias("coverage"),
    )


def address_counts(records: DataFrame) -> DataFrame:
    """Frames per (side, address); a hot address collapses on the map side."""
    return (
        records.select(
            F.explode(
                F.array(
                    F.struct(F.lit("source").alias("side"),
                             _mac(records, "source_mac").alias("mac")),
                    F.struct(F.lit("destination").alias("side"),
                             _mac(records, "destination_mac").alias("mac")),
                )
            ).alias("e")
        )
        .select("e.*")
        .where(F.col("mac").isNotNull())
        .groupBy("side", "mac")
        .agg(F.count(F.lit(1)).alias("frames"))
    )


def mac_ranking(records: DataFrame, side: str = "source") -> DataFrame:
    return (
        address_counts(records).where(F.col("side") == side).select("mac", "frames")
        .orderBy(F.desc("frames"), "mac")
    )


def target_matches(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Frames per matched target plus the total row ``__all__``."""
    found = lookup_targets(records, targets).where(F.col("source_target_id").isNotNull())
    return (
        found.groupBy("source_target_id").agg(F.count(F.lit(1)).alias("n"))
        .rollup("source_target_id").agg(F.sum("n").alias("frames"))
        .select(F.coalesce("source_target_id", F.lit("__all__")).alias("target_id"),
                F.coalesce("frames", F.lit(0)).alias("frames"))
    )


def warning_facts(records: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The totals the warning rules need, in one scan."""
    source = records if targets is None else lookup_targets(records, targets)
    matched = F.lit(0) if targets is None else F.count("source_target_id")
    return source.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(_parsed(records)).alias("parsed"),
        F.count(column_or_null(records, "data_rate", "double")).alias("with_rate"),
        F.count(_signal(records)).alias("with_signal"),
        F.count_if(F.coalesce(column_or_null(records, "protected", "boolean"), F.lit(False)))
        .alias("protected_frames"),
        matched.alias("matched"),
    )


def capture_warnings(
    facts: DataFrame, *, file_count: int = 1, has_enabled_targets: bool = False
) -> DataFrame:
    """One row per raised warning, in rule order."""
    scanned, parsed = F.col("scanned"), F.col("parsed")
    rules = [
        (F.lit(file_count == 0), NO_FILES),
        ((scanned > 0) & (parsed == 0), NONE_PARSED),
        (F.coalesce(F.try_divide(scanned - parsed, scanned), F.lit(0.0)) >= 0.2, MANY_FAILED),
        ((scanned > 0) & (F.col("with_rate") == 0), NO_RATE),
        ((scanned > 0) & (F.col("with_signal") == 0), NO_SIGNAL),
        ((parsed > 0) & (F.col("protected_frames") == 0), NO_PROTECTED),
        (F.lit(has_enabled_targets) & (parsed > 0) & (F.col("matched") == 0), NO_TARGET),
    ]
    raised = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(i).alias("rule"), F.lit(text).alias("warning")))
        for i, (test, text) in enumerate(rules, 1)
    ]))
    return facts.select(F.explode(raised).alias("w")).select("w.*")


def device_candidates(records: DataFrame, top: int | None = None) -> DataFrame:
    """Source addresses ranked by frames.

    Ranks come from range-partitioned running counts, as the addresses may be many.
    """
    counts = address_counts(records).where(F.col("side") == "source").select(
        "mac", "frames", F.lit(1).cast("long").alias("one")
    )
    ranked = running_totals(counts, [F.desc("frames"), F.col("mac")], ["one"], "candidates")
    out = ranked.select(F.col("one_upto").alias("rank"), "mac", "frames")
    return out if top is None else out.where(F.col("rank") <= top)


def presence_summary(events: DataFrame, order: str = "window_seq", shown: int = 120) -> DataFrame:
    """Per (target, window type): rows, count per state and the first states in order.

    The timeline keeps the lowest ``shown`` positions only; they are picked inside position
    blocks first, so no group is collected whole.
    """
    named = events.select(
        F.coalesce(F.when(F.col("target_id") != "", F.col("target_id")), F.lit("unknown"))
        .alias("target_id"),
        F.coalesce(F.when(F.col("window_type") != "", F.col("window_type")), F.lit("unknown"))
        .alias("window_type"),
        F.coalesce(F.when(F.col("state") != "", F.col("state")), F.lit("unknown")).alias("state"),
        F.col(order).alias("_order"),
    )
    keys = ["target_id", "window_type"]
    counts = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col("state") == s).alias(f"{s}_rows")
          for s in ("present", "absent", "uncertain", "unknown")],
    )
    # mergeable top-k by order value: per block, then over the block winners
    salted = named.withColumn("_block", F.pmod(F.xxhash64("_order"), F.lit(256)))
    per_block = Window.partitionBy(*keys, "_block").orderBy("_order")
    winners = salted.withColumn("_rank", F.row_number().over(per_block)).where(
        F.col("_rank") <= shown
    )
    overall = Window.partitionBy(*keys).orderBy("_order")
    timeline = (
        winners.withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= shown)
        .groupBy(*keys)
        .agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_order", "state"))),
                        lambda s: s["state"]), ",").alias("timeline"))
    )
    return counts.join(timeline, keys)
