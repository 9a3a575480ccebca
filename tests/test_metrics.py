import hashlib
import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from ethersense.operators import calibrate as cal
from ethersense.operators import evaluate as ev
from ethersense.operators import inspect as ins
from ethersense.operators import labels as lab
from ethersense.operators import ranking, sampling
from ethersense.operators.labels import LabelSettings, resolve_targets
from ethersense.operators.windows import WindowSettings, presence_windows
from ethersense.session import materialise

PRED = "ground_truth string, predicted_class string, score double"


def test_known_metrics(spark):
    df = spark.createDataFrame(
        [("target", "target", 0.9), ("target", "other", 0.4), ("other", "other", 0.2),
         ("other", "other", 0.1)], PRED)
    m = ev.classification_metrics(df, score="score").first()
    assert (m.accuracy, m.precision, m.recall, m.n_examples) == (0.75, 1.0, 0.5, 4)
    assert m.roc_auc == 1.0 and m.pr_auc == 1.0


def test_multiclass_has_no_areas(spark):
    df = spark.createDataFrame(
        [("a", "a", 0.0), ("b", "c", 0.0), ("c", "c", 0.0)], PRED)
    m = ev.classification_metrics(df, score="score").first()
    assert m.roc_auc is None and m.pr_auc is None
    assert math.isclose(m.accuracy, 2 / 3) and math.isclose(m.precision, 0.5)


def test_empty_metrics(spark):
    m = ev.classification_metrics(spark.createDataFrame([], PRED), score="score").first()
    assert m.n_examples == 0 and m.accuracy == 0.0 and m.mcc is None and m.f1 == 0.0


def test_areas_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["target", "other"]), "x", round(rng.random(), 1)) for _ in range(200)]
    m = ev.areas(ev.ranked_scores(ev.score_table(
        spark.createDataFrame(rows, PRED).repartition(5)))).first()
    pos = [s for t, _, s in rows if t == "target"]
    neg = [s for t, _, s in rows if t != "target"]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for cut in sorted({s for *_, s in rows}, reverse=True):
        tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
        ap += (tp / len(pos) - before) * tp / (tp + fp)
        before = tp / len(pos)
    assert math.isclose(m.roc_auc, auc) and math.isclose(m.pr_auc, ap)


REC = ("parse_ok boolean, frame_type int, protected boolean, data_rate double, "
       "channel_frequency int, rssi double, ssi double, source_mac string, destination_mac string")


def test_inspection_without_warnings(spark):
    df = spark.createDataFrame(
        [(True, 2, True, 54.0, 2412, -40.0, None, "aa", "bb"),
         (True, 0, False, 1.0, 2412, None, 20.0, "cc", "bb")], REC)
    macs = lab.mac_targets(lab.registry_frame(
        spark, [{"target_id": "phone", "mac_addresses": ["AA"]}]))
    s = ins.capture_summary(df).first()
    assert (s.packets_scanned, s.parse_failures, s.channel_frequencies) == (2, 0, "2412")
    assert (s.source_mac_count, s.destination_mac_count) == (2, 1)
    assert {r.field: r.coverage for r in ins.field_coverage(df).collect()} == {
        "data_rate": 1.0, "channel_frequency": 1.0, "rssi_or_ssi": 1.0}
    families = {r.family: r.frames for r in ins.family_counts(df).collect()}
    assert families == {"management": 1, "control": 0, "data": 1, "extension": 0, "unknown": 0}
    assert {r.target_id: r.frames for r in ins.target_matches(df, macs).collect()} == {
        "phone": 1, "__all__": 1}
    facts = ins.warning_facts(df, macs)
    assert ins.capture_warnings(facts, has_enabled_targets=True).count() == 0


def test_inspection_warnings(spark):
    df = spark.createDataFrame(
        [(True, 0, False, None, None, None, None, "zz", None),
         (False, None, None, None, None, None, None, None, None)], REC)
    macs = lab.mac_targets(lab.registry_frame(
        spark, [{"target_id": "phone", "mac_addresses": ["AA"]}]))
    out = ins.capture_warnings(ins.warning_facts(df, macs), has_enabled_targets=True).collect()
    assert [r.rule for r in out] == [3, 4, 5, 6, 7]


def test_candidate_ranks(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "source_mac string")
    out = ins.device_candidates(df).orderBy("rank").collect()
    assert [(r["rank"], r.mac, r.frames) for r in out] == [(1, "b", 2), (2, "a", 1), (3, "c", 1)]


LABELLED = "file_ordinal int, packet_index long, label string"


def labelled(spark):
    return spark.createDataFrame(
        [(0, i, lb) for i, lb in enumerate(["target", "target", "other", "other", "other"], 1)],
        LABELLED)


def test_balancing(spark):
    df = labelled(spark)
    down = sampling.balance(df, "downsample").groupBy("label").count().collect()
    assert sorted(r["count"] for r in down) == [2, 2]
    up = sampling.balance(df, "upsample").groupBy("label").count().collect()
    assert sorted(r["count"] for r in up) == [3, 3]
    weights = {r.label: r.sample_weight for r in sampling.balance(df, "weights").collect()}
    assert math.isclose(weights["target"], 5 / 4) and math.isclose(weights["other"], 5 / 6)
    assert sampling.balance(df, "none") is df


def test_upsample_spreads_a_tiny_class(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRAW_BLOCK", 16)
    rows = [(0, i, "big") for i in range(200)] + [(0, 999, "tiny")]
    out = sampling.upsample(spark.createDataFrame(rows, LABELLED))
    tiny = out.where("label = 'tiny'").select("copy").collect()
    assert sorted(r[0] for r in tiny) == list(range(200))


def test_splits(spark):
    parts = sampling.chronological_split(labelled(spark), 0.6).collect()
    assert sorted(r.packet_index for r in parts if r.is_train) == [1, 2, 3]
    shuffled = sampling.shuffled_split(labelled(spark), 0.6).collect()
    assert sum(r.is_train for r in shuffled) == 3
    assert sampling.sample_percent(labelled(spark), 100).count() == 5
    assert sampling.sample_percent(labelled(spark), 0).count() == 0


def test_large_sample_path_equals_top_k(spark, monkeypatch):
    df = spark.range(500).select(F.lit(0).alias("file_ordinal"), F.col("id").alias("packet_index"))
    small = {r.packet_index for r in sampling.sample_k(df, 50).collect()}
    monkeypatch.setattr(sampling, "TOP_K_LIMIT", 10)
    assert {r.packet_index for r in sampling.sample_k(df, 50).collect()} == small


def test_feature_rank_finds_the_informative_feature(spark):
    rows = [("a" if i % 2 else "b", float(i % 2), i % 3, None) for i in range(60)]
    df = spark.createDataFrame(rows, "label string, ssi double, frame_type int, hour int")
    out = ranking.feature_rank(df, ["hour", "frame_type", "ssi"]).collect()
    assert out[0].feature == "ssi" and math.isclose(out[0].score, 1.0)
    assert abs(out[1].score) < 1e-9 and {r.feature for r in out} == {"ssi", "frame_type", "hour"}


CAL = ("file_ordinal int, packet_index long, timestamp double, predicted_class string, "
       "confidence double, ground_truth string, probabilities_json string")


def test_calibration_case(spark):
    rows = [(0, i, float(i), c, 0.9, t, None) for i, (c, t) in enumerate(
        [("target", "target"), ("target", "target"), ("other", "other"), ("other", "other")])]
    df = spark.createDataFrame(rows, CAL)
    w = WindowSettings(frame_count=2, time_seconds=2, min_frames=1)
    stats, results, best = cal.calibrate(
        df, ["target"], w, cal.CalibrationSettings((0.5,), (0.5,), (0.8,)), ["frame_count"])
    assert [r.truth_present for r in stats.orderBy("window_start").collect()] == [True, False]
    assert best.first().f1 == 1.0 and results.count() == 2
    missing = df.withColumn("ground_truth", F.lit(None).cast("string"))
    try:
        cal.calibrate(missing, ["target"], w)
        raise AssertionError("no error")
    except ValueError:
        pass
    try:
        cal.calibration_windows(df, ["target"], w, kinds=["session"])
        raise AssertionError("no error")
    except ValueError:
        pass


def test_grid_includes_current_value():
    r, m, x = cal.grids(WindowSettings(present_ratio_threshold=0.55),
                        cal.CalibrationSettings((0.5, 0.5), (0.5,), (0.9, 0.8)))
    assert (r, m, x) == ([0.5, 0.55], [0.5], [0.8, 0.9])


def test_cuts_rank_only_the_cut_bucket(spark):
    """Splits and balancing agree with ranking all rows, and do not exchange the data."""
    rng = random.Random(6)
    rows = [(f, i, rng.choice(["a", "a", "a", "b", "c"])) for f in range(3) for i in rng.sample(range(60_000), 400)]
    df = materialise(spark.createDataFrame(rows, "file_ordinal int, packet_index long, label string"), "cut-test")
    order = sorted((f, i) for f, i, _ in rows)
    for fraction in (0.0, 0.3, 0.9, 1.0):
        cut = int(len(rows) * fraction)
        split = sampling.chronological_split(df, fraction)
        assert {(r["file_ordinal"], r["packet_index"]) for r in split.where("is_train").collect()} == set(order[:cut])
        shuffled = sampling.shuffled_split(df, fraction)
        digest = {(f, i): hashlib.md5(f"42-{f}-{i}".encode()).hexdigest() for f, i in order}
        best = sorted(order, key=lambda k: digest[k])[:cut]
        assert {(r["file_ordinal"], r["packet_index"]) for r in shuffled.where("is_train").collect()} == set(best)
    for plan in (split, shuffled, sampling.downsample(df)):
        assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    least = min(Counter(x for _, _, x in rows).values())
    want = {k for x in "abc" for k in sorted(((f, i) for f, i, y in rows if y == x), key=lambda k: digest[k])[:least]}
    assert {(r["file_ordinal"], r["packet_index"]) for r in sampling.downsample(df).collect()} == want


def test_sweep_is_every_candidate_on_every_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["time", "frame_count"]), rng.random() < 0.4, rng.randrange(1, 9),
             rng.random(), rng.choice([0.2, 0.5, rng.random()]), rng.random()) for _ in range(300)]
    stats = spark.createDataFrame(rows, "target_id string, window_type string, truth_present boolean, frame_count long, "
                                        "positive_prediction_ratio double, mean_probability double, max_probability double")
    w, c = WindowSettings(min_frames=3), cal.CalibrationSettings((0.2, 0.5), (0.5, 0.3), (0.9,))
    out = cal.sweep(stats, w, c)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    grid = list(itertools.product(*cal.grids(w, c)))
    want = {}
    for target, kind, truth, n, ratio, mean, top in rows:
        for k, (r, m, x) in enumerate(grid):
            present = n >= 3 and ratio >= r and (mean >= m or top >= x)
            for key in ((target, kind, k), ("__all__", "__all__", k)):
                cell = want.setdefault(key, [0, 0, 0, 0])
                cell[(0 if truth else 1) if present else (3 if truth else 2)] += 1
    got = {(r["target_id"], r["window_type"], r["candidate_index"]): [
        r["true_positive"], r["false_positive"], r["true_negative"], r["false_negative"]] for r in out.collect()}
    assert got == want


def test_windows_of_very_many_targets(spark):
    rows = [(0, i, float(i), rng_class, 0.7, '{"t5": 0.25, "t99999": 0.5}' if i % 2 else None, "t7")
            for i, rng_class in enumerate(["t5", "t6", "nobody", "t5"] * 5)]
    df = spark.createDataFrame(rows, "file_ordinal int, packet_index long, timestamp double, predicted_class string, "
                                     "confidence double, probabilities_json string, ground_truth string")
    registry = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("target_id"), F.lit(True).alias("enabled"))
    targets = resolve_targets(LabelSettings(mode="multiclass_with_other"), registry, all_targets=True)
    w = WindowSettings(frame_count=8, time_seconds=100.0)
    some = ["t5", "t6", "t7", "t99999", "t123"]
    out = presence_windows(df, targets, w)
    assert out.count() == 100_000 * 4
    names = [c for c in out.columns]
    few = {str(r) for r in presence_windows(df, some, w).select(names).collect()}
    assert {str(r) for r in out.where(F.col("target_id").isin(some)).collect()} == few
    rest = out.where(~F.col("target_id").isin(some)).agg(F.max("max_probability"), F.max("positive_prediction_ratio"), F.min("frame_count")).first()
    assert tuple(rest) == (0.0, 0.0, 4)
