"""Row filters. Scalar rules reach the scan; the registry test is one left semi join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.functions.columns import (
    FAMILY_CODES,
    non_zero,
    normalize_mac,
    time_literal,
)
from ethersense.operators.position import ensure_position
from ethersense.schemas import column_or_null


@dataclass(frozen=True)
class FilterSettings:
    known_targets_only: bool = False
    include_management: bool = True
    include_control: bool = True
    include_data: bool = True
    include_ap_originated: bool = True
    ap_macs: tuple[str, ...] = field(default_factory=tuple)
    channel_frequency: int | None = None
    start_time: float | str | None = None
    end_time: float | str | None = None
    rssi_min: float | None = None
    rssi_max: float | None = None
    min_frame_size: int | None = None


def parse_ok(df: DataFrame) -> DataFrame:
    """Keep parsed frames; a null flag drops the row, an absent column keeps all."""
    return df.where(F.col("parse_ok")) if "parse_ok" in df.columns else df


def known_targets(df: DataFrame, mac_targets: DataFrame) -> DataFrame:
    """Keep frames whose source is a registered device."""
    wanted = mac_targets.select(F.col("mac").alias("_mac"))
    keyed = df.withColumn("_source", normalize_mac(column_or_null(df, "source_mac", "string")))
    return keyed.join(wanted, F.col("_source") == F.col("_mac"), "left_semi").drop("_source")


def family_allowed(df: DataFrame, settings: FilterSettings) -> Column:
    """A plain test of the family code, so that it reaches the scan; unknown families stay."""
    switches = {
        "management": settings.include_management,
        "control": settings.include_control,
        "data": settings.include_data,
    }
    off = [code for code, name in FAMILY_CODES.items() if not switches.get(name, True)]
    if not off:
        return F.lit(True)
    code = column_or_null(df, "frame_type", "int")
    return code.isNull() | ~code.isin(off)


def ap_originated(df: DataFrame, ap_macs: tuple[str, ...] = ()) -> Column:
    source = normalize_mac(column_or_null(df, "source_mac", "string"))
    listed = F.lit(False)
    if ap_macs:
        listed = F.coalesce(source.isin([m.strip().lower() for m in ap_macs]), F.lit(False))
    from_ds = F.coalesce(column_or_null(df, "from_ds", "boolean"), F.lit(False))
    to_ds = F.coalesce(column_or_null(df, "to_ds", "boolean"), F.lit(False))
    return listed | (from_ds & ~to_ds)


def on_channel(df: DataFrame, frequency: int) -> Column:
    return column_or_null(df, "channel_frequency", "int").eqNullSafe(F.lit(frequency))


def within(value: Column, low: Column | None, high: Column | None) -> Column:
    """Inclusive range; a null value passes."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (value.isNull() | (value >= low))
    if high is not None:
        keep = keep & (value.isNull() | (value <= high))
    return keep


def in_time_range(df: DataFrame, start: float | str | None, end: float | str | None) -> Column:
    return within(
        column_or_null(df, "timestamp", "double"),
        None if start is None else time_literal(start),
        None if end is None else time_literal(end),
    )


def in_signal_range(df: DataFrame, low: float | None, high: float | None) -> Column:
    # this filter prefers rssi, while the feature prefers ssi
    signal = F.coalesce(column_or_null(df, "rssi", "double"), column_or_null(df, "ssi", "double"))
    return within(
        signal,
        None if low is None else F.lit(float(low)),
        None if high is None else F.lit(float(high)),
    )


def large_enough(df: DataFrame, minimum: int) -> Column:
    size = F.coalesce(
        non_zero(column_or_null(df, "data_size", "int")),
        non_zero(column_or_null(df, "dot11_frame_len", "int")),
        column_or_null(df, "packet_len", "int"),
    )
    return size.isNull() | (size >= minimum)


def scalar_condition(df: DataFrame, settings: FilterSettings) -> Column:
    keep = family_allowed(df, settings)
    if not settings.include_ap_originated:
        keep = keep & ~ap_originated(df, settings.ap_macs)
    if settings.channel_frequency is not None:
        keep = keep & on_channel(df, settings.channel_frequency)
    keep = keep & in_time_range(df, settings.start_time, settings.end_time)
    keep = keep & in_signal_range(df, settings.rssi_min, settings.rssi_max)
    if settings.min_frame_size is not None:
        keep = keep & large_enough(df, settings.min_frame_size)
    return keep


def apply_filters(
    df: DataFrame, settings: FilterSettings, mac_targets: DataFrame | None = None
) -> DataFrame:
    kept = df.where(scalar_condition(df, settings))
    if settings.known_targets_only:
        if mac_targets is None:
            return kept.where(F.lit(False))
        kept = known_targets(kept, mac_targets)
    return kept


def first_rows(df: DataFrame, count: int, position: str = "frame_pos") -> DataFrame:
    """The first ``count`` rows in file order; without a position only the blocks they lie in are numbered."""
    if position not in df.columns:
        df = ensure_position(df, position, below=count)
    return df.where(F.col(position) < count)
