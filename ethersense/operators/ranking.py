"""Information gain of each model feature towards the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.functions.columns import MODEL_FEATURES, significant_digits
from ethersense.session import bounded, materialise


def feature_label_counts(
    df: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "label"
) -> DataFrame:
    """Rows per (feature, value bucket, label).

    Raw values are counted first, so that the three-digit text of doubles is made once per
    distinct value and label instead of once per row.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    is_float = {name: kinds.get(name) in ("double", "float") for name in features}
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(is_float[name]).alias("is_float"),
            F.col(name).cast("string").alias("raw"),
        )
        for name in features
    ]
    raw = (
        df.where(F.col(label).isNotNull())
        .select(F.col(label).cast("string").alias("label"), F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature", "e.is_float", "e.raw", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    text = F.when(F.col("raw").isNull(), F.lit("missing")).when(
        F.col("is_float"), significant_digits(F.col("raw").try_cast("double"))
    ).otherwise(F.col("raw"))
    return raw.select("feature", text.alias("bucket"), "label", "n").groupBy(
        "feature", "bucket", "label"
    ).agg(F.sum("n").alias("n"))


def feature_rank(
    df: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "label"
) -> DataFrame:
    """Mutual information in bits per feature, best first (ties in the given order)."""
    cells = materialise(feature_label_counts(df, features, label), "feature-cells")
    by_value = cells.groupBy("feature", "bucket").agg(F.sum("n").alias("nx"))
    by_label = bounded(cells.groupBy("feature", "label").agg(F.sum("n").alias("ny")))[0]
    total = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = (
        cells.join(by_value, ["feature", "bucket"])
        .join(by_label, ["feature", "label"])
        .join(F.broadcast(total), "feature")
    )
    share = F.col("n") / F.col("total")
    gain = F.col("n").cast("double") * F.col("total") / (
        F.col("nx").cast("double") * F.col("ny").cast("double")
    )
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return (
        joined.groupBy("feature").agg(F.sum(share * F.log2(gain)).alias("score"))
        .orderBy(F.desc("score"), place)
    )
