"""Structured Streaming: frames landing as files, classified and turned into presence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.functions.columns import FeatureSettings
from ethersense.operators.position import BLOCK_BITS, add_position
from ethersense.operators.trees import Model, classify
from ethersense.operators.windows import (
    FRAME_COUNT,
    TIME,
    WindowSettings,
    frame_window_stats,
    marked,
    merge_stats,
    replay_time_stats,
    state_changes,
    with_state,
)
from ethersense.schemas import PREDICTIONS
from ethersense.session import discard, local_frame, materialise


def landing_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Frames that arrive as files in a landing folder."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


# --- classification --------------------------------------------------------------------------


class ClassifySink:
    """Scores arriving feature rows and appends predictions as JSON lines.

    Arriving rows pass no parse or filter gate, as the live path has none.
    """

    def __init__(self, spark: SparkSession, model: Model, folder: str,
                 features: FeatureSettings = FeatureSettings(), label_mode: str = "unknown") -> None:
        self.spark, self.model, self.folder = spark, model, folder
        self.features, self.label_mode = features, label_mode

    def run(self, rows: DataFrame) -> None:
        preds = classify(rows, self.model, self.features, label_mode=self.label_mode, keep=("file_ordinal",))
        kept = [c for c in preds.columns if c == "file_ordinal"]  # the order of files, as folders
        (
            preds.select(*sorted(f.name for f in PREDICTIONS.fields), *kept)
            .writeStream.outputMode("append").format("json").partitionBy(*kept)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .option("ignoreNullFields", "false")
            .trigger(availableNow=True).start(f"{self.folder}/predictions").awaitTermination()
        )

    def predictions(self) -> DataFrame:
        return self.spark.read.schema(PREDICTIONS).json(f"{self.folder}/predictions")


# --- count windows and replay ----------------------------------------------------------------

_OPEN = T.StructType([
    T.StructField("target_id", T.StringType()), T.StructField("window_type", T.StringType()),
    T.StructField("window_seq", T.LongType()), T.StructField("tb", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("sum_p", T.DoubleType()),
    T.StructField("max_p", T.DoubleType()), T.StructField("hits", T.LongType()),
    T.StructField("truths", T.LongType()),
])
_LAST = T.StructType([
    T.StructField(c, T.StringType()) for c in ("target_id", "window_type", "state")])
_STATE = T.StructType([
    T.StructField("position", T.LongType()), T.StructField("open_tb", T.LongType()),
    T.StructField("open_seq", T.LongType()), T.StructField("open", T.ArrayType(_OPEN)),
    T.StructField("last", T.ArrayType(_LAST)),
])
_STATS = ["n", "sum_p", "max_p", "hits", "truths"]


class ReplayEngine:
    """Count and time windows over a stream in arrival order, exact like a row-by-row replay.

    A count window depends on every row before it, so a keyed state operator would run one busy
    sensor in one task. Here each micro-batch is numbered in parallel and only the open windows,
    one per target and kind, are carried over as sums. What batch ``k`` leaves is stored under its
    number, so a batch that is run again starts from the same state and rewrites the same output.
    """

    def __init__(self, spark: SparkSession, targets: Sequence[str], settings: WindowSettings,
                 folder: str, block_bits: int = BLOCK_BITS) -> None:
        self.spark, self.settings, self.folder = spark, settings, folder
        self.targets = targets if isinstance(targets, DataFrame) else list(dict.fromkeys(targets))
        self.block_bits = block_bits

    def run(self, preds: DataFrame) -> None:
        """Process everything that has arrived since the last run."""
        (
            preds.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True).start().awaitTermination()
        )

    def process(self, batch: DataFrame, number: int) -> None:
        spark, s = self.spark, self.settings
        cursor, open_rows, last = self._state(number - 1)
        placed, count = self._place(batch, number, cursor["position"])
        if count == 0:
            self._store(number, cursor, open_rows, last)
            return
        opened = local_frame(spark, open_rows, _OPEN)
        frames = frame_window_stats(placed, self.targets, s).select(
            "target_id", "window_type", "window_seq", F.lit(None).cast("long").alias("tb"), *_STATS)
        local = replay_time_stats(placed, self.targets, s, self.block_bits).select(
            "target_id", "window_type", "window_seq",
            F.rint(F.col("window_start") / s.time_seconds).cast("long").alias("tb"), *_STATS)
        local = materialise(local, "batch-islands")
        # null when no row of the batch carries a time
        ends = local.agg(F.min_by("tb", "window_seq").alias("first_tb"),
                         F.max("window_seq").alias("last")).first()
        base = cursor["open_seq"]
        if ends["last"] is not None and cursor["open_tb"] != ends["first_tb"]:
            base += 1
        shifted = local.withColumn("window_seq", F.col("window_seq") + F.lit(base))
        merged = materialise(
            frames.unionByName(shifted).unionByName(opened)
            .groupBy("target_id", "window_type", "window_seq", "tb").agg(*merge_stats()),
            "batch-windows",
        )
        open_seq = cursor["open_seq"] if ends["last"] is None else base + ends["last"]
        is_time = F.col("window_type") == TIME
        still_open = F.when(is_time, F.col("window_seq") == open_seq).otherwise(
            F.col("n") < s.frame_count)
        # at most one open window per target and kind
        open_rows = [tuple(r) for r in merged.where(still_open).select(*_OPEN.names).collect()]
        open_tb = next((r[3] for r in open_rows if r[1] == TIME), cursor["open_tb"])
        closed = self._shape(merged.where(~still_open), final=False)
        last = self._emit(closed, number, last)
        discard(placed, local, merged)
        self._store(
            number,
            {"position": cursor["position"] + count, "open_tb": open_tb, "open_seq": open_seq},
            open_rows, last,
        )

    def _place(self, batch: DataFrame, number: int, position: int) -> tuple[DataFrame, int]:
        """The batch's marks with their places in the stream, stored, and how many rows there are.

        Both kinds of windows read them, so the texts of probabilities are parsed once and never exchanged.
        """
        numbered = add_position(marked(_with_ordinal(batch), self.targets))
        counted = Observation()
        placed = materialise(
            numbered.withColumn("frame_pos", F.col("frame_pos") + F.lit(position))
            .observe(counted, F.count(F.lit(1)).alias("rows")),
            "batch",
        )
        return placed, counted.get["rows"]

    def finish(self) -> None:
        """Flush the open windows as final ones."""
        number = self._latest()
        _cursor, open_rows, last = self._state(number)
        rest = local_frame(self.spark, open_rows, _OPEN)
        self._emit(self._shape(rest, final=True), number + 1, last)

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events/*")

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/changes/*")

    def _shape(self, stats: DataFrame, *, final: bool) -> DataFrame:
        s = self.settings
        is_time = F.col("window_type") == TIME
        start = F.when(is_time, F.col("tb") * F.lit(float(s.time_seconds))).otherwise(
            (F.col("window_seq") * s.frame_count).cast("double"))
        end = F.when(is_time, (F.col("tb") + 1) * F.lit(float(s.time_seconds))).otherwise(
            start + F.col("n") - 1)
        shaped = stats.withColumn("window_start", start).withColumn("window_end", end).withColumn(
            "final_window", F.lit(final))
        return with_state(shaped, s, "final_window")

    def _emit(self, events: DataFrame, number: int, last: list[tuple]) -> list[tuple]:
        """Write the batch's events and state changes; returns the last state per target and kind."""
        path = f"{self.folder}/events/batch={number}"
        events.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(events.schema).parquet(path)
        before = local_frame(self.spark, last, _LAST).select(
            "target_id", "window_type", "state", F.lit(-1).cast("long").alias("window_seq"))
        known = before.unionByName(stored.select("target_id", "window_type", "state", "window_seq"))
        changed = state_changes(known, block_bits=self.block_bits, stored=True).where(F.col("window_seq") >= 0)
        changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        latest = known.groupBy("target_id", "window_type").agg(
            F.max_by("state", "window_seq").alias("state"))
        return [tuple(r) for r in latest.collect()]

    def _state(self, number: int) -> tuple[dict, list[tuple], list[tuple]]:
        if number < 0:
            return {"position": 0, "open_tb": None, "open_seq": -1}, [], []
        row = self.spark.read.schema(_STATE).json(f"{self.folder}/state/batch={number}").first()
        cursor = {k: row[k] for k in ("position", "open_tb", "open_seq")}
        return cursor, [tuple(r) for r in row["open"]], [tuple(r) for r in row["last"]]

    def _store(self, number: int, cursor: dict, open_rows: list, last: list) -> None:
        row = (cursor["position"], cursor["open_tb"], cursor["open_seq"], open_rows, last)
        local_frame(self.spark, [row], _STATE).coalesce(1).write.mode("overwrite").json(
            f"{self.folder}/state/batch={number}")

    def _latest(self) -> int:
        """Number of the last batch whose state is complete."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return -1
        numbers = [
            int(status.getPath().getName().split("=")[1])
            for status in fs.listStatus(root)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        ]
        return max(numbers, default=-1)


def _with_ordinal(batch: DataFrame) -> DataFrame:
    return batch if "file_ordinal" in batch.columns else batch.withColumn("file_ordinal", F.lit(0))


class LiveEngine(ReplayEngine):
    """Feature rows in; predictions, windows and state changes out, in one streaming query.

    Rows are scored in arrival order and numbered through all batches; ``packet_index`` of a stored prediction is
    that number. ``max_packets`` ends the work after so many rows: later ones are read and ignored.
    """

    def __init__(self, spark: SparkSession, model: Model, targets: Sequence[str], settings: WindowSettings,
                 folder: str, *, features: FeatureSettings = FeatureSettings(), label_mode: str = "unknown",
                 max_packets: int | None = None, block_bits: int = BLOCK_BITS) -> None:
        super().__init__(spark, targets, settings, folder, block_bits)
        if max_packets is not None and max_packets < 1:
            raise ValueError("max_packets must be greater than 0")
        self.model, self.features, self.label_mode, self.max_packets = model, features, label_mode, max_packets

    def _place(self, batch: DataFrame, number: int, position: int) -> tuple[DataFrame, int]:
        left = None if self.max_packets is None else self.max_packets - position
        if left == 0:
            return batch, 0
        numbered = add_position(_with_ordinal(batch), below=left)
        if left is not None:
            numbered = numbered.where(F.col("frame_pos") < left)
        rows = numbered.withColumn("packet_index", F.col("frame_pos") + F.lit(position))
        preds = classify(rows, self.model, self.features, label_mode=self.label_mode, keep=())
        path = f"{self.folder}/predictions/batch={number}"
        counted = Observation()
        preds.select(*sorted(f.name for f in PREDICTIONS.fields)).observe(
            counted, F.count(F.lit(1)).alias("rows")
        ).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        stored = self.spark.read.schema(PREDICTIONS).json(path).withColumn("frame_pos", F.col("packet_index"))
        return materialise(marked(stored, self.targets), "batch"), counted.get["rows"]

    def predictions(self) -> DataFrame:
        return self.spark.read.schema(PREDICTIONS).json(f"{self.folder}/predictions/*")


__all__ = ["FRAME_COUNT", "ClassifySink", "LiveEngine", "ReplayEngine", "landing_stream"]
