import math
import random

import pytest
from pyspark.sql import functions as F

from ethersense.operators import learn, sampling, trees
from ethersense.operators.learn import LearnerSettings
from ethersense.plans import jobs
from ethersense.session import work_path

FAST = LearnerSettings(chunks=4, n_models=3)


@pytest.fixture(scope="module")
def rows(spark):
    """Strong data frames are targets; one row in twenty is mislabelled."""
    n = F.col("id")
    base = spark.range(6000).select(
        F.lit(0).alias("file_ordinal"), n.alias("packet_index"), n.cast("double").alias("timestamp"),
        (n % 24).cast("int").alias("hour"), (F.pmod(F.hash(n), F.lit(60)) + 1.0).alias("data_rate"),
        (-90.0 + F.pmod(F.hash(n, F.lit(1)), F.lit(60))).alias("ssi"),
        F.pmod(F.hash(n, F.lit(2)), F.lit(3)).alias("frame_type"),
        F.pmod(F.hash(n, F.lit(3)), F.lit(16)).alias("frame_subtype"),
        F.pmod(F.hash(n, F.lit(4)), F.lit(200)).alias("data_size"),
    )
    hit = (F.col("ssi") > -60) & (F.col("frame_type") == 2)
    flipped = F.col("packet_index") % 20 == 7
    return base.withColumn("label", F.when(hit != flipped, "target").otherwise("other"))


@pytest.mark.parametrize("model_id", list(learn.MODEL_MAPPINGS))
def test_models_beat_the_majority(spark, rows, model_id):
    model, count = learn.train(rows, model_id, settings=FAST)
    assert count == 6000 and any(len(t.leaves()) > 1 for t in model.trees)
    m = jobs.prediction_metrics(trees.classify(rows, model)).first()
    majority = rows.where("label = 'other'").count() / 6000
    assert m.accuracy > majority + 0.03 and m.roc_auc > 0.85


def test_prequential_scores_before_learning(spark, rows):
    _model, preds = learn.prequential(rows, "adaptive_hoeffding_tree", settings=FAST)
    first = preds.where(F.col("packet_index") < 1500)
    assert {r[0] for r in first.select("predicted_class").distinct().collect()} == {"__none__"}
    assert first.where("confidence is not null").count() == 0
    assert preds.count() == 6000
    last = preds.where(F.col("packet_index") >= 4500)
    hit = last.where(F.col("predicted_class") == F.col("ground_truth")).count() / 1500
    assert hit > 0.88


def test_training_does_not_depend_on_partitioning(spark, rows):
    one, _ = learn.train(rows.repartition(1), "leveraging_bag", settings=FAST)
    seven, _ = learn.train(rows.repartition(7), "leveraging_bag", settings=FAST)
    shape = [[(n.feature, n.kind, n.code, n.left, n.right) for n in t.nodes.values()]
             for t in one.trees]
    assert shape == [[(n.feature, n.kind, n.code, n.left, n.right) for n in t.nodes.values()]
                     for t in seven.trees]


def test_every_row_of_a_gappy_part_is_learned(spark, rows):
    part = rows.withColumn("frame_pos", F.col("packet_index")).where("packet_index % 3 = 1")
    _, count = learn.train(part, "adaptive_hoeffding_tree", settings=LearnerSettings(chunks=2))
    assert count == 2000


def test_round_trip_and_version(spark, rows):
    model, _ = learn.train(rows, "oza_boost", settings=LearnerSettings(chunks=2, n_models=2))
    path = work_path(spark, "model-test")
    trees.save_model(spark, model, path)
    assert trees.load_model(spark, path) == model
    other = work_path(spark, "model-test")
    trees.save_model(spark, model, other, version=2)
    with pytest.raises(ValueError):
        trees.load_model(spark, other)


def test_weights_and_leakage_features(spark, rows):
    from ethersense.functions.columns import FeatureSettings

    with_macs = rows.withColumn("source_mac", F.concat(F.lit("02:"), F.col("hour").cast("string")))
    model, count = learn.train(
        with_macs.withColumn("w", F.lit(2.0)), "adaptive_hoeffding_tree",
        FeatureSettings(leakage_debug=True, missing_indicators=True),
        LearnerSettings(chunks=2), weight="w")
    total = sum(sum(n.weights.values()) for t in model.trees for n in t.nodes.values()
                if n.depth == 0)
    # weight 2 on every row the root has learned: one chunk when it split there, else both
    assert count == 6000 and total in (6000.0, 12000.0)


def test_poisson_ladder():
    import math

    cuts = learn.poisson_cuts()
    mean = sum(k * (c - p) for k, (c, p) in enumerate(zip(cuts, [0] + cuts))) / 2**32
    assert math.isclose(mean, 6.0, abs_tol=1e-3)


def test_drift_replaces_a_branch():
    monitor = learn.DriftMonitor(0.002)
    assert not any(monitor.update((0, 0), 1000, 100 + i) for i in range(5))
    assert monitor.update((0, 0), 1000, 600)
    tree = trees.Tree()
    tree.nodes = {0: trees.Node("ssi", "number", 1.0, None, 1, 2),
                  1: trees.Node(weights={"a": 1.0}, depth=1), 2: trees.Node(weights={"b": 2.0},
                                                                             depth=1)}
    tree.next_id = 3
    learn._replace_branch(tree, 0)
    assert tree.root == 3 and tree.nodes == {3: trees.Node(weights={"a": 1.0, "b": 2.0})}


def test_layers_and_modes(spark, rows):
    folder = work_path(spark, "layer-test")
    _, n = jobs.write_layer(rows, folder)
    assert n == 6000
    with pytest.raises(Exception):
        jobs.write_layer(rows, folder)
    assert jobs.write_layer(rows.limit(5), folder, "skip")[1] == 6000
    assert jobs.write_layer(rows.limit(5), folder, "overwrite")[1] == 5


def test_comparison(spark, rows):
    out = jobs.compare_models(
        rows, ["adaptive_hoeffding_tree", "oza_boost"], [0.5],
        settings=LearnerSettings(chunks=2, n_models=2)).collect()
    assert [(r.model_id, r.train_rows, r.test_rows) for r in out] == [
        ("adaptive_hoeffding_tree", 3000, 3000), ("oza_boost", 3000, 3000)]
    with pytest.raises(ValueError):
        jobs.comparison_plan(rows, ["nope"], [0.5])


def drifting(seed, n=300):
    rng = random.Random(seed)
    out, rate = [], 0.1
    for _ in range(n):
        if rng.random() < 0.02:
            rate = rng.choice([0.05, 0.1, 0.3, 0.5])
        rows = rng.randrange(200, 400)
        out.append((float(rows), float(sum(rng.random() < rate for _ in range(rows)))))
    return out


def test_error_window_is_the_series_in_few_buckets():
    """Buckets are sums of neighbouring chunks, few of them, and raise the alarms of the plain rule on the whole
    series; where a cut would fall inside a bucket one may be missed."""
    missed = 0
    for seed in range(6):
        series = drifting(seed)
        window, monitor = learn.ErrorWindow(), learn.DriftMonitor(0.002)
        plain, alarms, plain_alarms = [], set(), set()
        for i, (n, e) in enumerate(series):
            window.add(n, e)
            if monitor.update((0, 0), n, e):
                alarms.add(i)
            plain.append((n, e))
            while (at := learn.window_cut(plain, 0.002)) is not None:
                old, new = plain[:at], plain[at:]
                if sum(e for _, e in new) / sum(n for n, _ in new) > sum(e for _, e in old) / sum(n for n, _ in old):
                    plain_alarms.add(i)
                del plain[:at]
        buckets = window.buckets()
        assert len(buckets) <= 5 * (math.log2(len(series)) + 1)
        totals = [sum(n for n, _ in series[:i]) for i in range(len(series) + 1)]
        ends = [sum(n for n, _ in buckets[:i]) for i in range(len(buckets) + 1)]
        assert set(ends) <= set(totals) and ends[-1] == totals[-1]
        assert sum(e for _, e in buckets) == sum(e for _, e in series)
        assert alarms <= plain_alarms and len(alarms) >= 2
        missed += len(plain_alarms - alarms)
    assert missed <= 1


def test_error_window_of_few_chunks_is_exact():
    """Up to five chunks stand for themselves, so cuts equal those on the series."""
    for seed in range(40):
        rng = random.Random(seed)
        monitor, plain = learn.DriftMonitor(0.002), []
        for _ in range(5):
            n = rng.randrange(50, 5000)
            e = float(int(n * rng.choice([0.05, 0.06, 0.4])))
            plain.append((float(n), e))
            monitor.update((0, 0), float(n), e)
            while (at := learn.window_cut(plain, 0.002)) is not None:
                del plain[:at]
        assert monitor.windows[0, 0].buckets() == plain


def test_cells_learn_from_one_table(spark, monkeypatch):
    """All cells of a chronological comparison read one stored table and find what training on a copy finds."""
    rng = random.Random(3)
    rows = [(0, i, 1000.0 + i, float(rng.choice([-50, -70])), 2, 0, 40, rng.choice(["target", "other"])) for i in range(600)]
    df = spark.createDataFrame(rows, "file_ordinal int, packet_index long, timestamp double, ssi double, frame_type int, "
                                     "frame_subtype int, data_size int, label string")
    df = df.withColumn("label", F.when(F.col("ssi") == -50, "target").otherwise("other")).withColumn("hour", F.lit(1)).withColumn("data_rate", F.lit(1.0))
    settings = learn.LearnerSettings(chunks=2, n_models=2)
    names = []
    kept = jobs.materialise
    monkeypatch.setattr(learn, "materialise", lambda d, name, *a: names.append(name) or kept(d, name, *a))
    out = jobs.compare_models(df, ["adaptive_hoeffding_tree", "oza_boost"], [0.3, 0.7], settings=settings, parallel=2).collect()
    assert names.count("training-inputs") == 1 and "training-rows" not in names
    for r in out:
        parts = sampling.chronological_split(df, r["train_fraction"])
        metrics, _ = jobs.evaluate_holdout(parts, r["model_id"], settings=settings)
        m = metrics.first()
        assert (r["train_rows"], r["test_rows"], r["accuracy"], r["f1"]) == (m["train_examples"], m["n_examples"], m["accuracy"], m["f1"])
