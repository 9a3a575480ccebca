"""Whole jobs: prepare, train and evaluate, classify a dataset, compare models."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ethersense.functions.columns import FeatureSettings, feature_rows
from ethersense.operators import evaluate as ev
from ethersense.operators import inspect as ins
from ethersense.operators.filters import FilterSettings, apply_filters, parse_ok
from ethersense.operators.labels import LabelSettings, assign_labels
from ethersense.operators.learn import MODEL_MAPPINGS, LearnerSettings, train, train_prefix, training_inputs
from ethersense.operators.position import add_position
from ethersense.operators.sampling import fraction_cuts, split
from ethersense.operators.trees import Model, classify, save_model
from ethersense.operators.windows import WindowSettings, presence_windows
from ethersense.schemas import COMPARISON_COLUMNS, PREDICTIONS
from ethersense.session import local_frame, materialise
from ethersense.sources.capture import discover, ingest
from ethersense.sources.datasets import read_dataset, write_dataset, write_document

SAVE_MODES = ("errorifexists", "overwrite", "skip")


@dataclass
class JobResult:
    manifest: DataFrame
    tables: dict[str, str]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def write_layer(df: DataFrame, path: str, mode: str = "errorifexists") -> tuple[DataFrame, int]:
    """Write one layer and read it back; its row count is observed during the write.

    ``skip`` keeps a finished layer of an earlier run.
    """
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {', '.join(SAVE_MODES)}")
    spark = df.sparkSession
    if mode == "skip" and _exists(spark, path):
        stored = spark.read.parquet(path)
        return stored, stored.count()
    counted = Observation()
    out = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    out.write.mode("overwrite" if mode == "overwrite" else "errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), counted.get["rows"]


def _manifest(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return local_frame(spark, list(counts.items()), "stage string, row_count long")


def prepare(
    records: DataFrame,
    targets: DataFrame,
    folder: str,
    *,
    features: FeatureSettings = FeatureSettings(),
    filters: FilterSettings = FilterSettings(),
    labels: LabelSettings = LabelSettings(),
    train_fraction: float = 0.9,
    chronological: bool = True,
    seed: int = 42,
    mode: str = "errorifexists",
) -> JobResult:
    """Records, features, labels and split, one stored table per layer.

    Labelled rows are stored with their position, so that no later job numbers them again; train and
    test are two partitions of one table.
    """
    spark = records.sparkSession
    tables = {n: f"{folder}/{n}" for n in ("records", "features", "labels", "split")}
    counts: dict[str, int] = {}
    stored, counts["records"] = write_layer(records, tables["records"], mode)
    rows, counts["features"] = write_layer(
        feature_rows(parse_ok(stored), features), tables["features"], mode)
    labelled = add_position(
        assign_labels(apply_filters(rows, filters, targets), targets, labels))
    labelled, counts["labels"] = write_layer(labelled, tables["labels"], mode)
    parts = split(labelled, train_fraction, chronological=chronological, seed=seed)
    taken, total = write_split(parts, tables["split"], mode)
    counts["train"], counts["test"] = taken, total - taken
    return JobResult(_manifest(spark, counts), tables)


def write_split(parts: DataFrame, path: str, mode: str) -> tuple[int, int]:
    spark = parts.sparkSession
    if mode == "skip" and _exists(spark, path):
        row = spark.read.parquet(path).agg(
            F.count_if("is_train").alias("taken"), F.count(F.lit(1)).alias("total")).first()
        return row["taken"], row["total"]
    counted = Observation()
    out = parts.observe(
        counted, F.count_if(F.col("is_train")).alias("taken"), F.count(F.lit(1)).alias("total"))
    out.write.mode("overwrite" if mode == "overwrite" else "errorifexists").partitionBy(
        "is_train").parquet(path)
    return counted.get["taken"], counted.get["total"]


def prediction_metrics(preds: DataFrame, positive_label: str = "target") -> DataFrame:
    score = F.coalesce(F.try_element_at("probabilities", F.lit(positive_label)), F.lit(0.0))
    return ev.metrics_document(
        preds.withColumn("score", score), score="score", positive_label=positive_label)


def evaluate_holdout(
    rows: DataFrame,
    model_id: str,
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    *,
    weight: str | None = None,
    positive_label: str = "target",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Train on ``is_train`` rows, score the others; returns (metrics, predictions)."""
    model, learned = train(
        rows.where("is_train"), model_id, features, settings, weight=weight, seed=seed)
    test = rows.where(~F.col("is_train") & F.col("label").isNotNull())
    preds = classify(test, model, features)
    metrics = prediction_metrics(preds, positive_label).withColumn(
        "train_examples", F.lit(learned))
    return metrics, preds


def train_eval(
    spark: SparkSession,
    rows: DataFrame,
    folder: str,
    model_id: str,
    target_classes: Sequence[str],
    *,
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    windows: WindowSettings = WindowSettings(),
    weight: str | None = None,
    positive_label: str = "target",
    seed: int = 42,
) -> JobResult:
    """Train on all labelled rows, evaluate a fresh model on the split, classify and aggregate.

    The kept model has seen every labelled row, so the evaluation uses one of its own that has
    only seen the train part. Evaluation and classification go to two tables.
    """
    tables = {n: f"{folder}/{n}" for n in
              ("model", "metrics", "eval_predictions", "predictions", "presence")}
    rows = materialise(rows, "train-eval-rows")
    counts: dict[str, int] = {}
    model, counts["train_examples"] = train(
        rows, model_id, features, settings, weight=weight, seed=seed)
    save_model(spark, model, tables["model"])
    metrics, preds = evaluate_holdout(
        rows, model_id, features, settings, weight=weight, positive_label=positive_label,
        seed=seed)
    write_document(metrics, tables["metrics"])
    _, counts["eval_predictions"] = write_layer(preds, tables["eval_predictions"])
    stored, counts["predictions"] = write_layer(
        classify(rows, model, features), tables["predictions"])
    _, counts["presence"] = write_layer(
        presence_windows(stored, target_classes, windows), tables["presence"])
    return JobResult(_manifest(spark, counts), tables)


def classify_dataset(
    spark: SparkSession,
    source: str,
    destination: str,
    model: Model,
    features: FeatureSettings = FeatureSettings(),
) -> DataFrame:
    """Read a stored dataset, classify it, write predictions by suffix and read them back, in the order of
    the dataset's files if it has one."""
    preds = classify(read_dataset(spark, source), model, features, keep=("file_ordinal",))
    write_dataset(preds.drop("probabilities"), destination, PREDICTIONS)
    return read_dataset(spark, destination, PREDICTIONS)


def comparison_plan(rows: DataFrame, models: Sequence[str], fractions: Sequence[float]
                    ) -> DataFrame:
    """The experiment matrix with the rows each cell trains and tests on."""
    unknown = [m for m in models if m not in MODEL_MAPPINGS]
    if unknown:
        raise ValueError(f"unsupported model_id: {', '.join(unknown)}")
    if any(not 0 < f < 1 for f in fractions):
        raise ValueError("train fractions must lie between 0 and 1")
    names = local_frame(rows.sparkSession, [(m,) for m in models], "model_id string")
    return names.crossJoin(fraction_cuts(rows, list(fractions)))


def compare_models(
    rows: DataFrame,
    models: Sequence[str],
    fractions: Sequence[float],
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    *,
    chronological: bool = True,
    weight: str | None = None,
    positive_label: str = "target",
    seed: int = 42,
    parallel: int = 4,
) -> DataFrame:
    """One row per model and fraction. Cells run as concurrent Spark jobs.

    A chronological train part is a prefix of the file order, so all cells learn from one stored table of inputs; a
    shuffled one is a set of its own per fraction.
    """
    spark = rows.sparkSession
    if not rows.head(1):
        raise ValueError("the labelled dataset has no rows")
    stored = materialise(add_position(rows.drop("frame_pos")), "comparison-rows")
    total = stored.count()
    inputs = training_inputs(stored, features, weight=weight) if chronological else None

    def judged(model_id: str, fraction: float) -> DataFrame:
        if inputs is None:
            parts = split(stored, fraction, chronological=False, seed=seed)
            metrics, _ = evaluate_holdout(
                parts, model_id, features, settings, weight=weight, positive_label=positive_label, seed=seed)
            return metrics
        cut = int(total * float(fraction))
        model, learned = train_prefix(inputs, cut, model_id, features, settings, seed=seed)
        test = stored.where((F.col("frame_pos") >= cut) & F.col("label").isNotNull())
        return prediction_metrics(classify(test, model, features), positive_label).withColumn("train_examples", F.lit(learned))

    def cell(model_id: str, fraction: float) -> tuple:
        started = time.perf_counter()
        m = judged(model_id, fraction).first()
        values = [m[c] for c in ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc",
                                 "pr_auc")]
        return (model_id, float(fraction), int(m["train_examples"]), int(m["n_examples"]),
                *values, MODEL_MAPPINGS[model_id], round(time.perf_counter() - started, 6))

    with ThreadPoolExecutor(parallel) as pool:
        done = [pool.submit(cell, m, f) for m in models for f in fractions]
        out = [d.result() for d in done]
    schema = ("model_id string, train_fraction double, train_rows long, test_rows long, "
              "accuracy double, precision double, recall double, f1 double, mcc double, "
              "roc_auc double, pr_auc double, model_mapping string, elapsed_seconds double")
    return local_frame(spark, out, schema).select(*COMPARISON_COLUMNS)


def top_by_f1(results: DataFrame, count: int = 10) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("f1"), "model_id", "train_fraction").limit(count)


def calibration_input(
    preds: DataFrame | None, labelled: DataFrame | None, model: Model | None,
    features: FeatureSettings = FeatureSettings(), *, explicit: bool = True,
) -> DataFrame:
    """Predictions that all carry a truth, else the labelled set scored by the model.

    Predictions that were asked for (``explicit``) and lack a truth are an error; only those that happened to lie
    there may be replaced.
    """
    from ethersense.operators.calibrate import truth_coverage

    if preds is not None:
        if truth_coverage(preds).first()["usable"]:
            return preds
        if explicit:
            raise ValueError("the predictions for calibration must all have a ground truth")
    if labelled is None or model is None:
        raise ValueError("calibration needs predictions with truth, or labelled rows and a model")
    return classify(labelled, model, features)


def inspect_captures(
    spark: SparkSession, paths: Sequence[str], folder: str, targets: DataFrame | None = None, mode: str = "errorifexists"
) -> JobResult:
    """Reads captures into the ``records`` layer and reports on them: totals, families, field coverage, addresses,
    and the warnings they raise. Paths without any capture are an error."""
    files = discover(spark, paths)
    count = files.count()
    if count == 0:
        raise ValueError("no capture files found below: " + ", ".join(paths))
    tables = {n: f"{folder}/{n}" for n in ("records", "summary", "families", "coverage", "addresses", "warnings")}
    records, scanned = write_layer(ingest(spark, paths), tables["records"], mode)
    summary = ins.capture_summary(records).withColumn("capture_file_count", F.lit(count))
    write_document(summary, tables["summary"], mode)
    facts = ins.warning_facts(records, targets)
    write_layer(ins.family_counts(records), tables["families"], mode)
    write_layer(ins.field_coverage(records), tables["coverage"], mode)
    write_layer(ins.address_counts(records), tables["addresses"], mode)
    enabled = targets is not None and not targets.isEmpty()
    write_layer(ins.capture_warnings(facts, file_count=count, has_enabled_targets=enabled), tables["warnings"], mode)
    parsed = spark.read.json(tables["summary"]).first()["parse_successes"]
    counts = {"capture_files": count, "packets_scanned": scanned, "dot11_frames": parsed}
    return JobResult(_manifest(spark, counts), tables)


def prepare_captures(
    spark: SparkSession, paths: Sequence[str], targets: DataFrame, folder: str, *, mode: str = "errorifexists", **settings
) -> JobResult:
    """From capture files to train and test rows: inspect, then ``prepare`` on the stored records."""
    seen = inspect_captures(spark, paths, f"{folder}/inspect", targets, mode)
    done = prepare(spark.read.parquet(seen.tables["records"]), targets, folder, mode=mode, **settings)
    return JobResult(seen.manifest.unionByName(done.manifest), {**done.tables, **{f"inspect_{k}": v for k, v in seen.tables.items()}})


__all__ = [
    "JobResult", "calibration_input", "classify_dataset", "compare_models",
    "comparison_plan", "evaluate_holdout", "inspect_captures", "prepare_captures", "prediction_metrics", "prepare", "top_by_f1",
    "train_eval", "write_layer",
]
