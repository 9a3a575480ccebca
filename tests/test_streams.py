"""Windows that flush, chained state changes, the live engine, and file order in stored data."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.operators import windows as win
from ethersense.operators.position import ensure_position
from ethersense.operators.windows import WindowSettings
from ethersense.plans import jobs
from ethersense.schemas import FEATURES, PREDICTIONS
from ethersense.session import work_path
from ethersense.sources import datasets
from ethersense.streaming import presence, windows

SCHEMA = T.StructType([
    T.StructField("timestamp", T.DoubleType()), T.StructField("packet_index", T.LongType()),
    T.StructField("predicted_class", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities_json", T.StringType()), T.StructField("end_of_stream", T.BooleanType()),
])


def stream_rows(n=200, seed=1):
    rng = random.Random(seed)
    return [(1000 + i * 0.013, i, rng.choice(["a", "b"]), rng.random(), None, None) for i in range(n)]


def brute_windows(rows, seconds):
    out = {}
    for r in rows:
        for target in "ab":
            out.setdefault((target, int(r[0] // seconds)), []).append(r[3] if r[2] == target else 0.0)
    return out


def run_stream(spark, rows, cuts, changes=False, seconds=0.1, end=True):
    settings = WindowSettings(time_seconds=seconds, min_frames=1)
    landing = work_path(spark, "land")
    sink = windows.WindowSink(spark, ["a", "b"], settings, "1 seconds", work_path(spark, "sink"), changes)
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[low:high], SCHEMA).repartition(3).write.mode("append").parquet(landing)
        sink.run(presence.landing_stream(spark, landing, SCHEMA))
    if end:
        windows.mark_end(spark, landing)
        sink.run(presence.landing_stream(spark, landing, SCHEMA))
    return sink.windows().collect()


def test_windows_of_fractions_of_a_second_flush(spark):
    rows = stream_rows()
    got = run_stream(spark, [*rows, (None, 999, "a", 1.0, None, None)], [120])
    want = brute_windows(rows, 0.1)
    assert {(r["target_id"], r["window_seq"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        values = want[r["target_id"], r["window_seq"]]
        assert r["frame_count"] == len(values) and abs(r["mean_probability"] - sum(values) / len(values)) < 1e-9
        assert r["max_probability"] == max(values) and abs(r["window_start"] - r["window_seq"] * 0.1) < 1e-6
    last = max(b for _, b in want)
    final = {(r["target_id"], r["window_seq"]) for r in got if r["final_window"]}
    assert ("a", last) in final and ("b", last) in final and len(final) < len(want)


def test_changes_behind_windows(spark):
    rows = stream_rows(seed=3)
    plain = run_stream(spark, rows, [70])
    got = run_stream(spark, rows, [70], changes=True)
    want = set()
    for target in "ab":
        before = None
        for r in sorted((r for r in plain if r["target_id"] == target), key=lambda r: r["window_seq"]):
            if r["state"] != before:
                want.add((target, r["window_seq"], r["state"]))
            before = r["state"]
    assert {(r["target_id"], r["window_seq"], r["state"]) for r in got} == want and len(got) == len(want)


def feature_rows(files, rows_per_file, ssi):
    """Rows whose signal decides the class; packet indexes begin anew in each file."""
    return [
        (1000.0 + 10 * f + i, f"f{f}.pcap", i, 1, 1.0, float(ssi(f, i)), 2, 0, "m", "n", 40, 60, 42, 10, 2412, False, False, f)
        for f in range(files) for i in range(rows_per_file)
    ]


FEATURED = T.StructType([*FEATURES.fields, T.StructField("file_ordinal", T.IntegerType())])


def rule_model():
    from ethersense.checks import _rule_model

    return _rule_model()


def test_live_engine_scores_caps_and_flushes(spark):
    rng = random.Random(2)
    rows = feature_rows(1, 90, lambda f, i: rng.choice([-50, -70]))
    settings = WindowSettings(frame_count=7, time_seconds=4.0, min_frames=2)
    landing = work_path(spark, "land")
    engine = presence.LiveEngine(spark, rule_model(), ["target"], settings, work_path(spark, "live"), max_packets=64, block_bits=3)
    for low, high in ((0, 33), (33, 60), (60, 80), (80, 90)):
        spark.createDataFrame(rows[low:high], FEATURED).repartition(2).write.mode("append").parquet(landing)
        engine.run(presence.landing_stream(spark, landing, FEATURED))
    engine.finish()
    preds = engine.predictions().orderBy("packet_index").collect()
    assert [r["packet_index"] for r in preds] == list(range(64))
    assert [r["predicted_class"] for r in preds] == ["target" if r[5] == -50 else "other" for r in rows[:64]]
    events = engine.events().collect()
    counted = [r for r in events if r["window_type"] == "frame_count"]
    assert sorted(r["frame_count"] for r in counted) == [1] + [7] * 9 and sum(r["final_window"] for r in counted) == 1
    timed = [r for r in events if r["window_type"] == "time"]
    assert sum(r["frame_count"] for r in timed) == 64 and len(timed) == 16
    replay = win.replay_windows(
        spark.createDataFrame(preds, PREDICTIONS).withColumn("file_ordinal", F.lit(0)), ["target"], settings)
    keys = ["target_id", "window_type", "window_seq", "state", "frame_count", "final_window"]
    assert sorted(map(str, replay.select(keys).collect())) == sorted(map(str, engine.events().select(keys).collect()))
    with pytest.raises(ValueError, match="max_packets"):
        presence.LiveEngine(spark, rule_model(), ["target"], settings, work_path(spark, "live"), max_packets=0)


@pytest.mark.parametrize("suffix", ["parquet", "jsonl", "csv"])
def test_two_files_keep_their_order(spark, suffix):
    """File a is all target, file b all other: windows of a file's length are 1.0 and 0.0."""
    rows = spark.createDataFrame(feature_rows(2, 4, lambda f, i: -70 if f else -50), FEATURED).repartition(3)
    source = work_path(spark, "features") + f".{suffix}"
    assert datasets.write_dataset(rows, source, FEATURES) == 8
    files = sorted(map(tuple, datasets.read_files(spark, source).collect()))
    assert files == [(0, "f0.pcap", 4, 0), (1, "f1.pcap", 4, 4)]
    destination = work_path(spark, "preds") + f".{suffix}"
    preds = jobs.classify_dataset(spark, source, destination, rule_model())
    assert set(preds.columns) == {*PREDICTIONS.names, "file_ordinal"}
    out = win.presence_windows(preds, ["target"], WindowSettings(frame_count=4), [win.FRAME_COUNT])
    assert [r["positive_prediction_ratio"] for r in out.orderBy("window_start").collect()] == [1.0, 0.0]


def test_stored_order_over_three_files(spark):
    rng = random.Random(5)
    data = feature_rows(3, 50, lambda f, i: rng.choice([-50, -70]))
    rows = spark.createDataFrame(data, FEATURED).repartition(4)
    source = work_path(spark, "features") + ".parquet"
    datasets.write_dataset(rows, source, FEATURES)
    stored = datasets.read_dataset(spark, source, FEATURES)
    placed = {(r["file_ordinal"], r["packet_index"]): r["frame_pos"] for r in ensure_position(stored).collect()}
    assert placed == {(r[-1], r[2]): i for i, r in enumerate(data)}
    with pytest.raises(ValueError, match="file_ordinal"):
        ensure_position(stored.drop("file_ordinal"))
    with pytest.raises(ValueError, match="extra"):
        datasets.write_dataset(rows.withColumn("extra", F.lit(1)), work_path(spark, "x") + ".csv", FEATURES)


def test_classify_sink_keeps_file_order(spark):
    landing = work_path(spark, "land")
    rows = spark.createDataFrame(feature_rows(2, 4, lambda f, i: -70 if f else -50), FEATURED)
    rows.repartition(3).write.parquet(landing)
    sink = presence.ClassifySink(spark, rule_model(), work_path(spark, "classified"))
    sink.run(presence.landing_stream(spark, landing, FEATURED))
    out = win.presence_windows(sink.predictions(), ["target"], WindowSettings(frame_count=4), [win.FRAME_COUNT])
    assert [r["positive_prediction_ratio"] for r in out.orderBy("window_start").collect()] == [1.0, 0.0]


def test_replay_of_fractions(spark):
    """Buckets of a tenth of a second keep their numbers in the engine."""
    rng = random.Random(8)
    rows = [(9.1 + 0.03 * i, i, rng.choice(["target", "other"]), 0.5, None) for i in range(40)]
    schema = "timestamp double, packet_index long, predicted_class string, confidence double, probabilities_json string"
    settings = WindowSettings(frame_count=9, time_seconds=0.1, min_frames=1)
    landing = work_path(spark, "land")
    engine = presence.ReplayEngine(spark, ["target"], settings, work_path(spark, "replay"), block_bits=3)
    for low, high in ((0, 17), (17, 40)):
        spark.createDataFrame(rows[low:high], schema).write.mode("append").parquet(landing)
        engine.run(presence.landing_stream(spark, landing, T.StructType.fromDDL(schema)))
    engine.finish()
    batch = win.replay_windows(spark.createDataFrame(rows, schema), ["target"], settings)
    keys = ["window_type", "window_seq", "frame_count", "state", "final_window", F.round("window_start", 6).alias("s")]
    assert sorted(map(str, engine.events().select(keys).collect())) == sorted(map(str, batch.select(keys).collect()))




def test_engines_store_marks_instead_of_texts(spark):
    """Both kinds of windows read the stored batch, so texts of probabilities are parsed before it is stored."""
    rows = [(1000.0 + i, i, "a", 0.5, '{"a": 0.7, "b": 0.3}', None) for i in range(5)]
    batch = spark.createDataFrame(rows, SCHEMA)
    engine = presence.ReplayEngine(spark, ["a", "b"], WindowSettings(), work_path(spark, "replay"))
    placed, count = engine._place(batch, 0, 10)
    assert count == 5 and "probabilities_json" not in placed.columns
    got = {r["frame_pos"]: {m["target_id"]: m["p"] for m in r["_marks"]} for r in placed.collect()}
    assert got == {10 + i: {"a": 0.7, "b": 0.3} for i in range(5)}


def test_record_layer_is_compiled(spark, tmp_path):
    """No method of the record projections is beyond the 8000 bytes up to which the JVM compiles one."""
    from ethersense import demo

    spark.sql("""SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, id % 20 AS user_id, 'click' AS event_type,
                 1.5D AS value, '{"k": 3}' AS props FROM range(50)""").write.parquet(f"{tmp_path}/events.parquet")
    plan = demo.make_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    parts = getattr(debug, "MODULE$").codegenStringSeq(plan)
    assert parts.size() and max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000
