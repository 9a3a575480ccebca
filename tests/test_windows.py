import random

import pytest
from pyspark.sql import functions as F

from ethersense.operators import position as pos
from ethersense.operators import windows as win
from ethersense.operators.windows import WindowSettings
from ethersense.streaming import presence as stream
from ethersense.session import work_path

SCHEMA = ("file_ordinal int, packet_index long, timestamp double, predicted_class string, "
          "confidence double, probabilities_json string")


def predictions(spark, rows):
    return spark.createDataFrame(
        [(0, i, t, c, p, None) for i, (t, c, p) in enumerate(rows)], SCHEMA)


def brute_replay(rows, target, s):
    """Row by row: (type, seq, start, end, n, final, positives)."""
    out, frame, bucket, timed, start, seq = [], [], None, [], 0, 0

    def close_time(final):
        nonlocal seq
        out.append(("time", seq, bucket * s.time_seconds, (bucket + 1) * s.time_seconds,
                    len(timed), final, sum(c == target for c in timed)))
        seq += 1

    def close_frame(final):
        out.append(("frame_count", start // s.frame_count, start, start + len(frame) - 1,
                    len(frame), final, sum(c == target for c in frame)))

    for t, c, _p in rows:
        frame.append(c)
        if len(frame) >= s.frame_count:
            close_frame(False)
            start += len(frame)
            frame = []
        if t is not None:
            b = int(t // s.time_seconds)
            if bucket is not None and b != bucket:
                close_time(False)
                timed = []
            bucket = b
            timed.append(c)
    if frame:
        close_frame(True)
    if timed:
        close_time(True)
    return sorted(out)


def as_rows(df):
    return sorted(
        (r.window_type, r.window_seq, r.window_start, r.window_end, r.frame_count, r.final_window,
         round(r.positive_prediction_ratio * r.frame_count)) for r in df.collect())


def disordered(seed, count=300):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(count):
        t += rng.choice([0.1, 0.5, 3.0])
        stamp = None if rng.random() < 0.1 else t - (8.0 if rng.random() < 0.1 else 0.0)
        cls = rng.choice(["target", "other"])
        rows.append((stamp, cls, rng.random()))
    return rows


def test_small_engine_case(spark):
    rows = [(0.0, "target", 0.9), (1.0, "target", 0.8), (2.0, "target", 0.95)]
    s = WindowSettings(frame_count=3, time_seconds=10, min_frames=1)
    out = as_rows(win.replay_windows(predictions(spark, rows), ["target"], s))
    assert out == [("frame_count", 0, 0, 2, 3, False, 3), ("time", 0, 0.0, 10.0, 3, True, 3)]


def test_time_window_closes_on_next_bucket(spark):
    rows = [(0.0, "target", 0.9), (12.0, "target", 0.9)]
    s = WindowSettings(frame_count=100, time_seconds=10, min_frames=1)
    out = as_rows(win.replay_windows(predictions(spark, rows), ["target"], s))
    assert ("time", 0, 0.0, 10.0, 1, False, 1) in out and ("time", 1, 10.0, 20.0, 1, True, 1) in out


@pytest.mark.parametrize("bits", [2, 4, 14])
def test_replay_of_disordered_rows(spark, bits):
    s = WindowSettings(frame_count=7, time_seconds=5, min_frames=1)
    for seed in (1, 2):
        rows = disordered(seed)
        df = predictions(spark, rows).repartition(7)
        got = as_rows(win.replay_windows(df, ["target"], s, block_bits=bits))
        assert got == brute_replay(rows, "target", s)


def test_state_changes_across_blocks(spark):
    rng = random.Random(3)
    states = [rng.choice(["present", "present", "absent"]) for _ in range(100)]
    df = spark.createDataFrame(
        [("a", "time", i, st) for i, st in enumerate(states)],
        "target_id string, window_type string, window_seq long, state string")
    want = [i for i, st in enumerate(states) if i == 0 or st != states[i - 1]]
    for bits in (1, 3, 14):
        got = sorted(r.window_seq for r in win.state_changes(df, block_bits=bits).collect())
        assert got == want


def test_stream_equals_batch(spark):
    s = WindowSettings(frame_count=7, time_seconds=5, min_frames=1)
    rows = disordered(5)
    df = predictions(spark, rows)
    folder = work_path(spark, "stream-test")
    engine = stream.ReplayEngine(spark, ["target", "other"], s, folder, block_bits=4)
    landing = work_path(spark, "landing-test")
    for low, high in ((0, 3), (3, 150), (150, 151), (151, 300)):
        df.where(F.col("packet_index").between(low, high - 1)).coalesce(1).write.mode(
            "append").parquet(landing)
        # a new engine each time: everything it needs is in the folder
        engine = stream.ReplayEngine(spark, ["target", "other"], s, folder, block_bits=4)
        engine.run(stream.landing_stream(spark, landing, df.schema))
    engine.finish()
    events = engine.events()
    batch = win.replay_windows(df, ["target", "other"], s)
    for t in ("target", "other"):
        assert as_rows(events.where(F.col("target_id") == t)) == brute_replay(rows, t, s)
    keys = ["target_id", "window_type", "window_seq", "state"]
    assert sorted(map(tuple, engine.changes().select(keys).collect())) == sorted(
        map(tuple, win.state_changes(batch).select(keys).collect()))


def test_positions_do_not_depend_on_partitioning(spark):
    rows = [(f, i) for f in range(3) for i in range(50)]
    base = spark.createDataFrame(rows, "file_ordinal int, packet_index long").where(
        "packet_index % 7 <> 3")
    want = {k: i for i, k in enumerate(sorted(map(tuple, base.collect())))}
    for parts in (1, 7):
        for bits in (2, 14):
            out = pos.add_position(base.repartition(parts), pos.packet_bucket(bits)).collect()
            assert {(r.file_ordinal, r.packet_index): r.frame_pos for r in out} == want


def test_prefix_paths_agree(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(p, b, rng.randrange(5), rng.choice("xyz")) for p in "ab" for b in
            rng.sample(range(5000), 60)]
    df = spark.createDataFrame(rows, "p string, bucket long, n long, c string")
    few = pos.prefix_buckets(df, ["n"], partition=["p"], carry=["c"]).collect()
    monkeypatch.setattr(pos, "FEW_BUCKETS", 10)
    many = pos.prefix_buckets(df, ["n"], partition=["p"], carry=["c"]).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_presence_states(spark):
    s = WindowSettings(min_frames=2)
    df = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0), (5, 0.6, 0.6, 0.1), (5, 0.6, 0.1, 0.9), (5, 0.6, 0.1, 0.1),
         (5, 0.1, 0.1, 0.1), (5, 0.1, 0.1, 0.9), (5, None, None, None)],
        "n long, r double, m double, x double")
    state = win.presence_state(F.col("n"), F.col("r"), F.col("m"), F.col("x"), s)
    assert [r[0] for r in df.select(state).collect()] == [
        "uncertain", "present", "present", "uncertain", "absent", "uncertain", "absent"]
