"""Jobs: inspecting captures, metrics documents, what calibration takes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ethersense.operators import calibrate as cal
from ethersense.operators import evaluate as ev
from ethersense.operators.labels import broadcastable_targets, registry_frame
from ethersense.plans import jobs
from ethersense.session import work_path
from tests.test_sources import beacon, write_pcap
from tests.test_streams import FEATURED, feature_rows, rule_model


def test_captures_to_split(spark):
    folder = work_path(spark, "captures")
    os.makedirs(folder)
    for name in ("a", "b"):
        write_pcap(f"{folder}/{name}.pcap", [beacon(i) for i in range(30)] + [b"\0\0\x12\0"])
    targets = broadcastable_targets(registry_frame(spark, [{"target_id": "p", "mac_addresses": ["02:00:00:00:00:05"]}]))
    run = work_path(spark, "run")
    done = jobs.prepare_captures(spark, [folder], targets, run)
    counts = {r["stage"]: r["row_count"] for r in done.manifest.collect()}
    assert counts["capture_files"] == 2 and counts["packets_scanned"] == 62 and counts["dot11_frames"] == 60
    assert counts["records"] == 62 and counts["features"] == 60 and counts["train"] + counts["test"] == counts["labels"]
    summary = spark.read.json(done.tables["inspect_summary"]).first()
    assert summary["capture_file_count"] == 2 and summary["parse_failures"] == 2
    rows = spark.read.parquet(done.tables["split"])
    order = [(r["file_ordinal"], r["packet_index"]) for r in rows.orderBy("frame_pos").collect()]
    assert order == sorted(order) and len({f for f, _ in order}) == 2
    with pytest.raises(ValueError, match="no capture files"):
        jobs.inspect_captures(spark, [work_path(spark, "nothing")], work_path(spark, "run"))


def test_metrics_document(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("c", "c")]
    df = spark.createDataFrame(rows, "ground_truth string, predicted_class string")
    path = work_path(spark, "document")
    from ethersense.sources.datasets import write_document

    write_document(ev.metrics_document(df), path)
    name = next(f for f in os.listdir(path) if f.endswith(".json"))
    doc = json.loads(open(f"{path}/{name}").read())
    assert doc["n_examples"] == 5 and doc["labels"] == ["a", "b", "c"]
    assert doc["confusion_matrix"] == {"labels": ["a", "b", "c"], "matrix": [[1, 1, 0], [0, 1, 0], [1, 0, 1]]}
    assert doc["per_class"]["a"] == {"precision": 0.5, "recall": 0.5, "f1": 0.5, "support": 2}
    empty = ev.metrics_document(df.limit(0)).first()
    assert empty["labels"] == [] and empty["n_examples"] == 0 and empty["confusion_matrix"]["matrix"] == []


def test_calibration_takes_only_predictions_with_truth(spark):
    labelled = spark.createDataFrame(feature_rows(1, 6, lambda f, i: -50), FEATURED).withColumn("label", F.lit("target"))
    scored = jobs.calibration_input(None, labelled, rule_model())
    assert scored.count() == 6 and scored.where("ground_truth = 'target'").count() == 6
    assert jobs.calibration_input(scored, None, None) is scored
    bare = scored.withColumn("ground_truth", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="ground truth"):
        jobs.calibration_input(bare, labelled, rule_model())
    assert jobs.calibration_input(bare, labelled, rule_model(), explicit=False).count() == 6
    with pytest.raises(ValueError):
        jobs.calibration_input(None, labelled, None)


def test_synthetic_inputs_are_told_by_name(spark):
    rows = spark.createDataFrame(feature_rows(2, 15, lambda f, i: -50), FEATURED)
    assert not cal.looks_synthetic(rows, ["/data/run"])
    assert cal.looks_synthetic(rows, ["/data/Synthetic/run"])
    named = F.when(F.col("file_ordinal") == 1, F.lit("my-synthetic.pcap")).otherwise(F.col("source_file"))
    assert cal.looks_synthetic(rows.withColumn("source_file", named))
    late = F.when((F.col("file_ordinal") == 1) & (F.col("packet_index") > 5), F.lit("synthetic")).otherwise(F.lit("x"))
    assert not cal.looks_synthetic(rows.withColumn("source_file", late))
