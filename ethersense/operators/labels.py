"""Device registry and label assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.functions.columns import normalize_mac
from ethersense.schemas import REGISTRY, column_or_null
from ethersense.session import bounded, local_frame

MULTICLASS_MODES = ("multiclass_known_targets_only", "multiclass_with_other")
LABEL_MODES = ("binary_one_vs_rest", "per_target_binary", *MULTICLASS_MODES)


@dataclass(frozen=True)
class LabelSettings:
    mode: str = "binary_one_vs_rest"
    target_id: str | None = None
    positive_label: str = "target"
    negative_label: str = "other"


def registry_frame(spark: SparkSession, targets: list[dict]) -> DataFrame:
    """Registry entries (as parsed from a YAML or JSON document) as a DataFrame."""
    rows = [
        (
            i,
            str(t["target_id"]),
            t.get("label"),
            [None if m is None else str(m) for m in t.get("mac_addresses", [])],
            bool(t.get("enabled", True)),
        )
        for i, t in enumerate(targets)
    ]
    schema = T.StructType([T.StructField("target_ordinal", T.LongType()), *REGISTRY.fields])
    return local_frame(spark, rows, schema)


def mac_targets(registry: DataFrame) -> DataFrame:
    """One row per registered address: enabled targets only, the last mention wins."""
    listed = registry.where(F.coalesce("enabled", F.lit(True))).select(
        "target_id", "target_ordinal", F.posexplode("mac_addresses").alias("mac_ordinal", "raw")
    )
    return (
        listed.select("target_id", "target_ordinal", "mac_ordinal", normalize_mac(F.col("raw"))
                      .alias("mac"))
        .where(F.col("mac").isNotNull())
        .groupBy("mac")
        .agg(F.max_by("target_id", F.struct("target_ordinal", "mac_ordinal")).alias("target_id"))
    )


def broadcastable_targets(registry: DataFrame, limit: int = 50_000) -> DataFrame:
    """The address table, carrying a broadcast hint only when it has at most ``limit`` rows."""
    return bounded(mac_targets(registry), limit)[0]


def enabled_targets(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("enabled", F.lit(True))).select("target_id").distinct()


def resolve_targets(
    labels: LabelSettings,
    registry: DataFrame | None = None,
    *,
    explicit: list[str] | None = None,
    all_targets: bool | None = None,
    configured: list[str] | None = None,
    configured_all: bool = False,
    limit: int = 10_000,
) -> list[str] | DataFrame:
    """Which classes get presence windows.

    Explicit names win, then the all/single switch, then the configured list, then the configured
    all, then the default of the label mode. More than ``limit`` enabled targets stay a table of
    ``target_id``, which the windows take as well.
    """
    named = list(dict.fromkeys(str(t) for t in (explicit or []) if str(t)))
    if named:
        return named
    if all_targets is None:
        from_config = list(dict.fromkeys(str(t) for t in (configured or []) if str(t)))
        if from_config:
            return from_config
        all_targets = configured_all
    if not all_targets:
        if labels.mode in MULTICLASS_MODES:
            return [labels.target_id or labels.positive_label]
        return [labels.positive_label]
    if labels.mode not in MULTICLASS_MODES:
        raise ValueError("all targets need a multiclass label mode: " + ", ".join(MULTICLASS_MODES))
    if registry is None:
        raise ValueError("all targets need a target registry")
    rows = enabled_targets(registry).orderBy("target_id").limit(limit + 1).collect()
    if not rows:
        raise ValueError("the target registry has no enabled targets")
    if len(rows) > limit:
        return enabled_targets(registry)
    return [r[0] for r in rows]


def lookup_targets(df: DataFrame, targets: DataFrame, name: str = "source_target_id") -> DataFrame:
    """Left equi join on the normalised source address; never multiplies rows."""
    table = targets.select(F.col("mac").alias("_mac"), F.col("target_id").alias(name))
    keyed = df.withColumn("_source", normalize_mac(column_or_null(df, "source_mac", "string")))
    return keyed.join(table, F.col("_source") == F.col("_mac"), "left").drop("_source", "_mac")


def label_column(settings: LabelSettings, target: Column) -> Column:
    if settings.mode not in LABEL_MODES:
        raise ValueError(f"unsupported label mode: {settings.mode}")
    if settings.mode == "multiclass_known_targets_only":
        return target
    if settings.mode == "multiclass_with_other":
        return F.coalesce(F.when(target != "", target), F.lit(settings.negative_label))
    if settings.target_id is None:
        if settings.mode == "per_target_binary":
            raise ValueError("per_target_binary needs a target_id")
        hit = target.isNotNull()
    else:
        hit = target.eqNullSafe(F.lit(settings.target_id))
    return F.when(hit, settings.positive_label).otherwise(settings.negative_label)


def assign_labels(df: DataFrame, targets: DataFrame, settings: LabelSettings) -> DataFrame:
    looked_up = lookup_targets(df, targets)
    labelled = looked_up.withColumn(
        "label", label_column(settings, F.col("source_target_id"))
    ).withColumn("label_mode", F.lit(settings.mode))
    return labelled.where(F.col("label").isNotNull())
