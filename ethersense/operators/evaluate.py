"""Classification metrics. Everything after the first group-by works on a label x label table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.operators.position import running_totals
from ethersense.session import bounded, materialise


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def pair_counts(preds: DataFrame, truth: str = "ground_truth", predicted: str = "predicted_class"
                ) -> DataFrame:
    """Counts per (truth, predicted) over rows that have a truth."""
    return (
        preds.where(F.col(truth).isNotNull())
        .groupBy(F.col(truth).cast("string").alias("truth"),
                 F.col(predicted).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def labels_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("truth", "predicted")).alias("label")).distinct()


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Dense label x label table with zeros filled in.

    The counts are used three times, so they are fetched first when they are as few as expected.
    """
    pairs = bounded(pairs, 100_000)[0]
    labels = labels_of(pairs)
    grid = labels.select(F.col("label").alias("truth")).crossJoin(
        labels.select(F.col("label").alias("predicted"))
    )
    return grid.join(pairs, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per true label and one column per predicted label."""
    pairs = bounded(pairs, 100_000)[0]
    if labels is None:
        labels = [r[0] for r in labels_of(pairs).orderBy("label").collect()]
    return (
        confusion_matrix(pairs).groupBy("truth").pivot("predicted", list(labels)).agg(F.sum("n"))
    )


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0.0 where a denominator is zero."""
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("label"), F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("assigned"),
                    F.when(F.col("truth") == F.col("predicted"), F.col("n"))
                    .otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("assigned"), F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("assigned").alias("assigned"),
        F.sum("tp").alias("tp"),
    )
    rated = sums.select(
        "label", "tp", "assigned", "support",
        _ratio(F.col("tp"), F.col("assigned")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
    )
    return rated.withColumn(
        "f1",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def _weighted(name: str) -> Column:
    return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def headline(classes: DataFrame, positive_label: str = "target") -> DataFrame:
    """Precision, recall and F1 of the positive label, else their support-weighted means."""
    is_positive = F.col("label") == positive_label
    return classes.agg(*[
        F.coalesce(F.max(F.when(is_positive, F.col(name))), _weighted(name)).alias(name)
        for name in ("precision", "recall", "f1")
    ])


def accuracy(pairs: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_examples"),
        _ratio(hit, F.sum("n")).alias("accuracy"),
    )


def matthews(classes: DataFrame) -> DataFrame:
    """Multiclass MCC from the class marginals; null without rows or with a zero denominator."""
    d = "double"
    s = classes.agg(
        F.sum("tp").cast(d).alias("trace"), F.sum("support").cast(d).alias("n"),
        F.sum(F.col("support").cast(d) * F.col("assigned")).alias("cross"),
        F.sum(F.col("assigned").cast(d) * F.col("assigned")).alias("pp"),
        F.sum(F.col("support").cast(d) * F.col("support")).alias("tt"),
    )
    n2 = F.col("n") * F.col("n")
    bottom = F.sqrt((n2 - F.col("tt")) * (n2 - F.col("pp")))
    return s.select(
        F.when(bottom > 0, (F.col("trace") * F.col("n") - F.col("cross")) / bottom).alias("mcc")
    )


def score_table(preds: DataFrame, score: str = "score", truth: str = "ground_truth",
                positive_label: str = "target") -> DataFrame:
    """Positive and negative counts per distinct score."""
    positive = (F.col(truth) == positive_label).cast("long")
    return (
        preds.where(F.col(truth).isNotNull())
        .groupBy(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Scores from high to low with cumulative hits (``tp``) and false alarms (``fp``).

    The distinct scores may be as many as the rows, so the running sums are range partitioned.
    """
    return running_totals(scores, [F.col("score").desc()], ["pos", "neg"], "scores").select(
        "score", "pos", "neg", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp")
    )


def areas(ranked: DataFrame) -> DataFrame:
    """ROC area (ties count half) and average precision; null unless both truths occur."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = ranked.agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        # a negative is beaten by every positive above it and by half of those tied with it
        F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)).alias("won"),
        F.sum(F.col("pos") * precision).alias("ap"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(
        F.when(both, F.col("won") / (F.col("p") * F.col("q"))).alias("roc_auc"),
        F.when(both, F.col("ap") / F.col("p")).alias("pr_auc"),
    )


def _totals(ranked: DataFrame) -> DataFrame:
    return F.broadcast(ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")))


def roc_points(ranked: DataFrame) -> DataFrame:
    """One point per distinct threshold, from the most to the least certain."""
    return ranked.crossJoin(_totals(ranked)).where((F.col("p") > 0) & (F.col("q") > 0)).select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("q")).alias("fpr"),
        (F.col("tp") / F.col("p")).alias("tpr"),
    )


def pr_points(ranked: DataFrame) -> DataFrame:
    return ranked.crossJoin(_totals(ranked)).where((F.col("p") > 0) & (F.col("q") > 0)).select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("p")).alias("recall"),
    )


def classification_metrics(
    preds: DataFrame,
    *,
    truth: str = "ground_truth",
    predicted: str = "predicted_class",
    score: str | None = None,
    positive_label: str = "target",
) -> DataFrame:
    """All metrics in one row.

    One scan: the table is grouped by (truth, predicted, score), stored, and both the confusion
    counts and the score ranking are read from that.
    """
    d = preds.where(F.col(truth).isNotNull())
    value = F.lit(None).cast("double") if score is None else F.coalesce(
        F.col(score).cast("double"), F.lit(0.0))
    cells = materialise(
        d.groupBy(F.col(truth).cast("string").alias("truth"),
                  F.col(predicted).cast("string").alias("predicted"), value.alias("score"))
        .agg(F.count(F.lit(1)).alias("n")),
        "metric-cells",
    )
    pairs = cells.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
    pairs = bounded(pairs, 100_000)[0]
    classes = per_class(pairs)
    out = accuracy(pairs).crossJoin(headline(classes, positive_label)).crossJoin(matthews(classes))
    if score is None:
        nulls = [F.lit(None).cast("double").alias(c) for c in ("roc_auc", "pr_auc")]
        return out.select("*", *nulls)
    positive = F.col("truth") == positive_label
    scores = cells.groupBy("score").agg(
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"),
    )
    return out.crossJoin(areas(ranked_scores(scores)))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("string").alias("label")
    ).agg(F.count(F.lit(1)).alias("label_count"))


def severe_skew(distribution: DataFrame) -> DataFrame:
    """True with two or more classes when the largest has ten times the rows of the smallest."""
    low, high = F.min("label_count"), F.max("label_count")
    return distribution.agg(
        F.count(F.lit(1)).alias("classes"), low.alias("smallest"), high.alias("largest"),
        F.coalesce(
            (F.count(F.lit(1)) >= 2) & (low > 0) & (F.try_divide(high, low) >= 10), F.lit(False)
        ).alias("severe_skew"),
    )


def metrics_document(
    preds: DataFrame,
    *,
    truth: str = "ground_truth",
    predicted: str = "predicted_class",
    score: str | None = None,
    positive_label: str = "target",
) -> DataFrame:
    """One row with everything an evaluation reports: the metrics, ``labels`` in order, ``per_class`` by label, and
    ``confusion_matrix`` with a row per truth and a column per prediction."""
    metrics = classification_metrics(preds, truth=truth, predicted=predicted, score=score, positive_label=positive_label)
    known = preds.where(F.col(truth).isNotNull())
    pairs = materialise(
        known.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n")), "metric-pairs")
    pairs = bounded(pairs, 100_000)[0]
    classes = per_class(pairs)
    labels = classes.agg(F.sort_array(F.collect_list("label")).alias("labels"))
    details = classes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support").alias("value"))))).alias("per_class"))
    cells = pairs.groupBy("truth").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("row"))
    rows = cells.agg(F.map_from_entries(F.collect_list(F.struct("truth", "row"))).alias("_rows"))
    count = F.transform("labels", lambda t: F.transform("labels", lambda p: F.coalesce(
        F.try_element_at(F.try_element_at("_rows", t), p), F.lit(0).cast("long"))))
    return metrics.crossJoin(labels).crossJoin(details).crossJoin(rows).select(
        *metrics.columns, "labels", "per_class", F.struct("labels", count.alias("matrix")).alias("confusion_matrix"))
