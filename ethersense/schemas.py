"""Explicit schemas of every dataset layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _I, _S, _B = (
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_FRAMES = _struct(
    ("file_ordinal", _I), ("source_file", _S), ("packet_index", _L), ("timestamp", _D),
    ("original_len", _I), ("linktype", _I), ("frame", T.BinaryType()),
)

RECORDS = _struct(
    ("file_ordinal", _I), ("timestamp", _D), ("source_file", _S), ("packet_index", _L),
    ("packet_len", _I), ("capture_len", _I), ("original_len", _I), ("radiotap_len", _I),
    ("dot11_frame_len", _I), ("payload_len", _I), ("hour", _I), ("data_rate", _D),
    ("channel_frequency", _I), ("ssi", _D), ("rssi", _D), ("frame_type", _I),
    ("frame_subtype", _I), ("to_ds", _B), ("from_ds", _B), ("addr1", _S), ("addr2", _S),
    ("addr3", _S), ("addr4", _S), ("source_mac", _S), ("destination_mac", _S),
    ("sequence_number", _I), ("retry", _B), ("protected", _B), ("parse_ok", _B),
    ("parse_error", _S),
)

FEATURES = _struct(
    ("timestamp", _D), ("source_file", _S), ("packet_index", _L), ("hour", _I),
    ("data_rate", _D), ("ssi", _D), ("frame_type", _I), ("frame_subtype", _I),
    ("source_mac", _S), ("destination_mac", _S), ("data_size", _I), ("total_packet_len", _I),
    ("dot11_frame_len", _I), ("payload_len", _I), ("channel_frequency", _I), ("retry", _B),
    ("protected", _B),
)

PREDICTIONS = _struct(
    ("timestamp", _D), ("packet_index", _L), ("label_mode", _S), ("predicted_class", _S),
    ("confidence", _D), ("ground_truth", _S), ("source_mac", _S), ("destination_mac", _S),
    ("features_json", _S), ("probabilities_json", _S),
)

PRESENCE = _struct(
    ("window_start", _D), ("window_end", _D), ("target_id", _S), ("frame_count", _L),
    ("mean_probability", _D), ("max_probability", _D), ("positive_prediction_ratio", _D),
    ("state", _S), ("window_type", _S),
)

REGISTRY = T.StructType([
    T.StructField("target_id", _S, False),
    T.StructField("label", _S, True),
    T.StructField("mac_addresses", T.ArrayType(_S), True),
    T.StructField("enabled", _B, True),
])

CALIBRATION_COLUMNS = [
    "scope", "target_id", "window_type", "candidate_index", "present_ratio_threshold",
    "mean_probability_threshold", "max_probability_threshold", "window_count", "support",
    "positive_support", "truth_absent_windows", "true_positive", "false_positive",
    "true_negative", "false_negative", "precision", "recall", "f1", "mcc", "objective",
    "objective_score",
]

COMPARISON_COLUMNS = [
    "model_id", "train_fraction", "train_rows", "test_rows", "accuracy", "precision", "recall",
    "f1", "mcc", "roc_auc", "pr_auc", "model_mapping", "elapsed_seconds",
]


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """An absent column reads as a typed null, like a missing key of a row."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of ``schema``, adding typed nulls for absent ones."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schema.fields
    ])


def assert_same_columns(df: DataFrame, schema: T.StructType) -> None:
    """Reject column drift before a write starts."""
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra:
        raise ValueError(f"schema changed while writing; new column(s): {', '.join(extra)}")
