"""Time windows and state changes as stateful steps of one streaming query.

Rows are added up per task, target and window before the state store sees them, so a busy sensor costs it a few
rows a batch. One processor keeps each target's open windows and closes them by event-time timers, or all of
them when an end marker arrives; a second one behind it keeps each target's last state and passes on
changes. The watermark of the rows reaches both.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ethersense.functions.columns import time_bucket
from ethersense.operators.windows import TIME, WindowSettings, per_target, with_state
from ethersense.schemas import column_or_null

# Spark first calls the processors in a Python process of the driver, which lacks the files shipped to executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_OF_STREAM = "end_of_stream"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SUMS = "n long, sum_p double, max_p double, hits long, truths long"
_PARTIAL = f"target_id string, tb long, {_SUMS}, ends boolean"
_CLOSED = f"target_id string, window_seq long, {_SUMS}, final_window boolean, closed_at timestamp"


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums per target and window; end markers pass as they are."""
    for frame in frames:
        markers = frame[frame["ends"]]
        rows = frame[~frame["ends"]]
        if len(rows):
            sums = rows.groupby(["target_id", "tb"], as_index=False).agg(
                n=("p", "size"), sum_p=("p", "sum"), max_p=("p", "max"), hits=("hit", "sum"), truths=("truth", "sum"))
            yield sums.assign(ends=False)
        if len(markers):
            yield markers[["target_id"]].drop_duplicates().assign(
                tb=0, n=0, sum_p=0.0, max_p=0.0, hits=0, truths=0, ends=True)


class OpenWindows(StatefulProcessor):
    """Sums of each open window of a target; a timer at its end, or an end marker, closes it."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "tb long", _SUMS)

    def _end(self, tb: int) -> int:
        return math.ceil((tb + 1) * self.seconds * 1000)

    def _closed(self, key: tuple, windows: list[int], final: bool) -> pd.DataFrame:
        rows = []
        for tb in sorted(windows):
            rows.append((key[0], tb, *self.open.getValue((tb,)), final, pd.Timestamp(self._end(tb), unit="ms")))
            self.open.removeKey((tb,))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CLOSED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ends = False
        for frame in rows:
            ends |= bool(frame["ends"].any())
            for r in frame[~frame["ends"]].itertuples(index=False):
                if self._end(r.tb) <= mark:
                    continue  # its window has closed
                at = (int(r.tb),)
                own = (int(r.n), float(r.sum_p), float(r.max_p), int(r.hits), int(r.truths))
                if self.open.containsKey(at):
                    n, sum_p, max_p, hits, truths = self.open.getValue(at)
                    own = (n + own[0], sum_p + own[1], max(max_p, own[2]), hits + own[3], truths + own[4])
                else:
                    self.handle.registerTimer(self._end(int(r.tb)))
                self.open.updateValue(at, own)
        if ends:
            yield self._closed(key, [at[0] for at in self.open.keys()], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        yield self._closed(key, [at[0] for at in self.open.keys() if self._end(at[0]) <= due], False)

    def close(self) -> None:
        pass


class LastStates(StatefulProcessor):
    """Passes on the windows whose state is not that of the window before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("window_seq", kind="stable")
        known = self.last.get()[0] if self.last.exists() else None
        before = events["state"].shift(1, fill_value=known)
        self.last.update((events["state"].iloc[-1],))
        yield events[events["state"] != before]

    def close(self) -> None:
        pass


def flushing_windows(preds: DataFrame, targets: Sequence[str], settings: WindowSettings, watermark: str) -> DataFrame:
    """Tumbling windows with their states, closed by the watermark or by a row whose ``end_of_stream`` is true.

    Rows of windows that have closed are dropped, as are rows without time. After an end marker a stream may go on.
    """
    seconds = float(settings.time_seconds)
    marker = F.coalesce(column_or_null(preds, END_OF_STREAM, "boolean"), F.lit(False))
    timed = preds.withColumn("_ends", marker).where(F.col("_ends") | F.col("timestamp").isNotNull()).withColumn(
        "_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    ).withWatermark("_time", watermark).withColumn("tb", F.coalesce(time_bucket(F.col("timestamp"), seconds), F.lit(0)))
    rows = per_target(timed, targets, keep=["tb", "_ends"]).select(
        "target_id", "tb", "p", "hit", "truth", F.col("_ends").alias("ends"))
    closed = rows.mapInPandas(_add_up, _PARTIAL).groupBy("target_id").transformWithStateInPandas(
        OpenWindows(seconds), _CLOSED, "Append", "EventTime", eventTimeColumnName="closed_at")
    start = F.col("window_seq") * seconds
    stats = closed.withColumn("window_type", F.lit(TIME)).withColumn("window_start", start).withColumn(
        "window_end", start + seconds)
    return with_state(stats, settings, "final_window", "closed_at")


def changed_states(events: DataFrame) -> DataFrame:
    """Of windows in a stream, those whose state differs from the one before in their target and kind."""
    return events.groupBy("target_id", "window_type").transformWithStateInPandas(
        LastStates(), events.schema, "Append", "None")


def mark_end(spark: SparkSession, landing: str) -> None:
    """Lands an end marker: windows that are open when it is read close as final ones."""
    spark.range(1).select(F.lit(True).alias(END_OF_STREAM)).coalesce(1).write.mode("append").parquet(landing)


class WindowSink:
    """Runs windows, or only their changes, into a Parquet table; exactly once through its checkpoint."""

    def __init__(self, spark: SparkSession, targets: Sequence[str], settings: WindowSettings,
                 watermark: str, folder: str, changes: bool = False) -> None:
        self.spark, self.targets, self.settings = spark, list(targets), settings
        self.watermark, self.folder, self.changes = watermark, folder, changes

    def run(self, preds: DataFrame) -> None:
        out = flushing_windows(preds, self.targets, self.settings, self.watermark)
        if self.changes:
            out = changed_states(out)
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)
        try:
            (
                out.drop("closed_at").writeStream.outputMode("append").format("parquet")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True).start(f"{self.folder}/windows").awaitTermination()
            )
        finally:
            self.spark.conf.set(STORE, before)

    def windows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/windows")
