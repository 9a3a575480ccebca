"""Removal of long repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that overlap by the compared length. Equal text has equal
triggers, so repeats show in the dictionary of distinct phrases and in how often the parse uses each; only
phrases that share a trigger but differ are compared window by window, and each distinct phrase once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.llm.textwork import _BYTE, mix64, signed
from ethersense.session import materialise

SEGMENT = 1 << 18
#: Distinct phrases of one trigger that are compared inside a task (a phrase has at most ``length - gram + 1``
#: windows, so about 20 MB of hashes); more are compared by a shuffle.
TOGETHER = 16384
_BASE = np.uint64(0xB5297A4D3F84D5B5)
_INVERSE = np.uint64(pow(0xB5297A4D3F84D5B5, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


class _Rolling:
    """Hashes of substrings of one buffer from prefix sums; grows its tables with the longest buffer."""

    size = 0
    up = down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if _Rolling.size < len(data) + 1:
            _Rolling.size = max(2 * len(data), 2 * SEGMENT)
            _Rolling.up, _Rolling.down = _powers(_BASE, _Rolling.size), _powers(_INVERSE, _Rolling.size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return low if span == width else np.minimum(low[: len(low) - (width - span)], low[width - span :])


def _segments(batches, length: int):
    """Groups of texts, and overlapping parts of texts above ``SEGMENT`` bytes, with their row and offset."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        held, rows, bases, total = [], [], [], 0
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
            for base in range(0, max(1, len(raw) - length + 1), SEGMENT):
                part = raw[base : base + SEGMENT + length - 1]
                if len(part) < length:
                    continue
                held.append(part), rows.append(i), bases.append(base)
                total += len(part)
                if total >= SEGMENT:
                    yield batch, held, np.array(rows), np.array(bases)
                    held, rows, bases, total = [], [], [], 0
        if held:
            yield batch, held, np.array(rows), np.array(bases)


def _phrases(length: int, gram: int):
    """One row per phrase: trigger, phrase hash, where its windows start, how many it has.

    A window belongs to the smallest hashed ``gram`` inside it, the first one on a tie.
    """
    width = length - gram + 1

    def run(batches):
        for batch, held, rows, bases in _segments(batches, length):
            data = np.frombuffer(b"".join(held), np.uint8)
            size = np.array([len(x) for x in held])
            start = np.cumsum(size) - size
            roll = _Rolling(data)
            grams = roll.windows(gram)
            rank = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            owner = (_window_minimum(rank, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size - length + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[: len(owner)])
            own = owner[at]
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            lo, hi, trigger = at[first], at[last], own[first]
            part = np.searchsorted(start, lo, side="right") - 1
            phrase = mix64(
                roll.spans(lo, hi + length) + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + (trigger - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            )
            row = pa.array(rows[part])
            yield pa.record_batch([
                pa.array(signed(grams[trigger])), pa.array(signed(phrase)), batch.column("doc_id").take(row),
                batch.column("text_key").take(row), pa.array(lo - start[part] + bases[part]), pa.array((hi - lo + 1).astype(np.int32)),
            ], names=["trigger", "phrase", "doc_id", "text_key", "lo", "n"])

    return run


def _cut_out(length: int):
    """The bytes of the listed phrases of each text."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(wanted), 2000):
                    some = wanted[at : at + 2000]
                    yield pa.record_batch([
                        pa.array([w["trigger"] for w in some], pa.int64()), pa.array([w["phrase"] for w in some], pa.int64()),
                        pa.array([w["uses"] for w in some], pa.int64()), pa.array([w["kinds"] for w in some], pa.int64()),
                        pa.array([raw[w["lo"] : w["lo"] + w["n"] + length - 1] for w in some], pa.binary()),
                    ], names=["trigger", "phrase", "uses", "kinds", "part"])

    return run


def _phrase_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of every phrase, and the number of windows of each phrase."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    count = size - length + 1
    start = np.cumsum(size) - size
    place = np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)
    return _Rolling(data).windows(length)[place], count


def _runs(hit: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _compare(length: int):
    """Phrases arrive sorted by trigger; equal windows of one trigger's dictionary are found by sorting."""

    def judge(rows: list[tuple]):
        hashes, count = _phrase_windows([r[3] for r in rows], length)
        trigger = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        mark = mix64(hashes ^ np.repeat(mix64(trigger), count))
        _, back, times = np.unique(mark, return_inverse=True, return_counts=True)
        hit = times[back] > 1
        end = np.cumsum(count)
        runs = [[0, int(c)] if r[2] > 1 else _runs(hit[e - c : e]) for r, c, e in zip(rows, count, end)]
        return pa.record_batch([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array(runs, pa.list_(pa.int32())),
        ], names=["trigger", "phrase", "runs"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "phrase", "uses", "part"))):
                if held and held[-1][:2] == row[:2]:  # a repeated row of the table gave it again
                    continue
                if len(held) >= 1000 and held[-1][0] != row[0]:
                    yield judge(held)
                    held = []
                held.append(row)
        if held:
            yield judge(held)

    return run


def _spread(length: int):
    """Windows of phrases whose trigger has many: one row each, to be counted by a shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, count = _phrase_windows(part.column("part").to_pylist(), length)
                row = pa.array(np.repeat(np.arange(len(count)), count))
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.record_batch([
                    part.column("trigger").take(row), part.column("phrase").take(row), part.column("uses").take(row),
                    pa.array(signed(hashes)), pa.array(place.astype(np.int32)),
                ], names=["trigger", "phrase", "uses", "window", "place"])

    return run


def _merge(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), merged, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.list_(pa.list_(pa.int64()))), pa.array([o[3] for o in out], pa.string()),
                pa.array([o[4] for o in out], pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, keep_text: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256, kept)`` per row of ``docs`` (``doc_id``, ``text``).

    A byte goes when some ``length``-byte string that covers it also starts elsewhere in the table, in the
    same row too; strings never cross rows and are judged on the input. ``spans`` are the maximal removed
    byte ranges, ``kept`` the other bytes (null unless ``keep_text``). Null counts as empty; texts shorter than
    ``length`` lose nothing. Repeated rows are occurrences of each other, so each loses all. Other
    columns are ignored.

    Windows of one trigger are told apart by 64-bit hashes, next to the trigger's own; the order among them
    is that of the hashes, as only equality of ``length`` bytes counts and not which suffix is smaller.
    """
    gram = max(1, length * 8 // 25)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("doc_id", "text"))
    parse = materialise(docs.mapInArrow(
        _phrases(length, gram), "trigger long, phrase long, doc_id long, text_key long, lo long, n int"
    ), "parse")
    seen = parse.groupBy("trigger").agg(
        F.count("*").alias("uses"), F.min("phrase").alias("x"), F.max("phrase").alias("y")
    ).where("uses > 1").select("trigger", (F.col("x") != F.col("y")).alias("mixed"))
    parse = materialise(parse.join(seen, "trigger"), "repeated-parse")

    dictionary = parse.where("mixed").groupBy("trigger", "phrase").agg(
        F.count("*").alias("uses"), F.min(F.struct("doc_id", "text_key", "lo", "n")).alias("at")
    )
    dictionary = materialise(dictionary, "dictionary")
    kinds = dictionary.groupBy("trigger").agg(F.count("*").alias("kinds"))
    wanted = dictionary.join(kinds, "trigger").groupBy("at.doc_id", "at.text_key").agg(
        F.collect_list(F.struct("trigger", "phrase", "uses", "kinds", "at.lo", "at.n")).alias("wanted")
    ).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "wanted")
    same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    parts = materialise(docs.join(wanted, same).select("text", "wanted").mapInArrow(
        _cut_out(length), "trigger long, phrase long, uses long, kinds long, part binary"
    ), "phrases")

    few = parts.where(F.col("kinds") <= TOGETHER).select("trigger", "phrase", "uses", "part").repartition("trigger")
    found = few.sortWithinPartitions("trigger", "phrase").mapInArrow(_compare(length), "trigger long, phrase long, runs array<int>")
    crowd = parts.where(F.col("kinds") > TOGETHER).dropDuplicates(["trigger", "phrase"])
    window = crowd.select("trigger", "phrase", "uses", "part").mapInArrow(
        _spread(length), "trigger long, phrase long, uses long, window long, place int"
    )
    twice = window.groupBy("trigger", "window").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    many = window.join(twice, ["trigger", "window"]).select("trigger", "phrase", "place").union(
        window.where("uses > 1").select("trigger", "phrase", "place")
    ).groupBy("trigger", "phrase").agg(F.array_sort(F.collect_set("place")).alias("places")).select(
        "trigger", "phrase", F.flatten(F.transform("places", lambda p: F.array(p, p + 1))).alias("runs")
    )
    runs = materialise(found.union(many), "phrase-runs")

    whole = parse.where("not mixed").select("doc_id", "text_key", F.col("lo").alias("lo"), (F.col("lo") + F.col("n") + length - 1).alias("hi"))
    pair = F.explode(F.expr("transform(sequence(0, size(runs) div 2 - 1), i -> struct(runs[2 * i] as a, runs[2 * i + 1] as b))"))
    partly = parse.where("mixed").join(runs.where("size(runs) > 0"), ["trigger", "phrase"]).select(
        "doc_id", "text_key", "lo", pair.alias("run")
    ).select("doc_id", "text_key", (F.col("lo") + F.col("run.a")).alias("lo"), (F.col("lo") + F.col("run.b") + length - 1).alias("hi"))
    spans = whole.union(partly).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans")
    )
    return docs.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(
        _merge(length, keep_text),
        "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept binary",
    )
