"""Incremental tree learners as chunked Spark jobs.

Rows are cut into chunks in file order. Each chunk is one aggregate: score the rows to leaves with
the current model, then sum class, number and code statistics per leaf. The split test itself also
runs in Spark on those sums; the driver receives one row per leaf, whose number is limited by
``max_leaves``, and edits the small model. Within a chunk the model is fixed, so per-row order turns
into chunk order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethersense.functions.columns import CODE_FEATURES, FeatureSettings, model_feature_names
from ethersense.operators.position import PACKET_ORDER, ensure_position
from ethersense.operators.trees import (
    CODE,
    NUMBER,
    Model,
    Node,
    Tree,
    classify,
    is_code,
    leaf_column,
    majority_column,
    model_inputs,
)
from ethersense.schemas import column_or_null
from ethersense.session import local_frame, materialise, work_path

# What each model id stands for.
MODEL_MAPPINGS = {
    "adaptive_hoeffding_tree": "Hoeffding tree, branches replaced on drift",
    "leveraging_bag": "Hoeffding trees under Poisson(6) weights, worst member reset on drift",
    "oza_boost": "Hoeffding trees under online boosting weights",
    "oza_boost_adwin": "Hoeffding trees under online boosting weights, members reset on drift",
}
POISSON_RATE = 6.0
UNIFORM_DIGITS = 8


@dataclass(frozen=True)
class LearnerSettings:
    chunks: int = 8
    n_models: int = 10
    grace_weight: float = 200.0
    delta: float = 1e-7
    tie: float = 0.05
    max_depth: int = 10
    max_leaves: int = 64
    cut_points: int = 10
    min_branch: float = 0.01
    drift_delta: float = 0.002


def new_model(
    model_id: str,
    features: FeatureSettings = FeatureSettings(),
    *,
    n_models: int = 10,
    seed: int = 42,
) -> Model:
    if model_id not in MODEL_MAPPINGS:
        raise ValueError(f"unsupported model_id: {model_id}")
    members = 1 if model_id == "adaptive_hoeffding_tree" else n_models
    names = model_feature_names(features)
    if features.missing_indicators:
        names = names + [f"{n}__missing" for n in names if "mac" not in n]
    return Model(
        model_id, names, [], [Tree() for _ in range(members)], [0.0] * members, [0.0] * members,
        boosted=model_id.startswith("oza_boost"), seed=seed,
    )


# --- weights ---------------------------------------------------------------------------------


def poisson_cuts(rate: float = POISSON_RATE) -> list[int]:
    """Upper ends, on a 32-bit scale, of the intervals that stand for 0, 1, 2, ... events."""
    cuts, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        cut = int(total * 2**32)
        if cuts and cut <= cuts[-1] or cut >= 2**32:
            return cuts
        cuts.append(cut)
        k += 1
        term *= rate / k


def poisson_weight(uniform: Column, rate: float = POISSON_RATE) -> Column:
    """Number of events for 32 random bits, as a balanced search over the interval ends."""
    cuts = poisson_cuts(rate)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(float(low))
        middle = (low + high) // 2
        return F.when(uniform < cuts[middle], search(low, middle)).otherwise(
            search(middle + 1, high))

    return search(0, len(cuts))


def with_uniforms(rows: DataFrame, n_models: int, seed: int) -> DataFrame:
    """Add ``_u0`` .. with the random bits of every member.

    Digests and bits are columns of their own, so that the search above does not evaluate them
    once per comparison.
    """
    per_digest = 32 // UNIFORM_DIGITS
    staged = rows.select("*", *[
        F.md5(F.concat_ws("-", F.lit(f"{seed}.{d}"), *[F.col(k).cast("string")
                                                       for k in PACKET_ORDER])).alias(f"_digest{d}")
        for d in range((n_models + per_digest - 1) // per_digest)
    ])
    bits = [
        F.conv(F.substring(F.col(f"_digest{m // per_digest}"),
                           1 + UNIFORM_DIGITS * (m % per_digest), UNIFORM_DIGITS), 16, 10)
        .cast("long").alias(f"_u{m}")
        for m in range(n_models)
    ]
    return staged.select(*rows.columns, *bits)


def bag_weights(rows: DataFrame, n_models: int, seed: int = 42) -> DataFrame:
    """One row per (frame, member) with the member's Poisson(6) weight."""
    bits = with_uniforms(rows.select(*PACKET_ORDER), n_models, seed)
    entries = F.array(*[
        F.struct(F.lit(m).alias("member"), F.col(f"_u{m}").alias("u")) for m in range(n_models)
    ])
    # exploded before the search, so that its code exists once and not once per member
    return bits.select(*PACKET_ORDER, F.explode(entries).alias("e")).select(
        *PACKET_ORDER, "e.member", F.col("e.u").alias("u")
    ).select(*PACKET_ORDER, "member", poisson_weight(F.col("u")).alias("weight"))


def with_members(rows: DataFrame, model: Model) -> DataFrame:
    """One row per (training row, member): leaf, weight ``w`` and whether the member was right.

    Leaves and hits are columns of their own before the weights use them, as a boosting weight
    depends on the hits of all members before it.
    """
    m_all = range(len(model.trees))
    staged = rows.select(
        "*",
        *[leaf_column(model.trees[m]).alias(f"_leaf{m}") for m in m_all],
        *[majority_column(model.trees[m]).eqNullSafe(F.col("label")).alias(f"_hit{m}")
          for m in m_all],
    )
    bagged = model.model_id == "leveraging_bag"
    if bagged:
        staged = with_uniforms(staged, len(model.trees), model.seed)
    weights = [F.lit(1.0)] * len(model.trees)
    if model.boosted:
        share = F.lit(1.0)
        for m in m_all:
            weights[m] = share
            right, wrong = model.right_weight[m], model.wrong_weight[m]
            up = (right + wrong) / (2 * wrong) if wrong > 0 else 1.0
            down = (right + wrong) / (2 * right) if right > 0 else 1.0
            # expected value of the Poisson draw the row-wise learner makes
            share = share * F.when(F.col(f"_hit{m}"), F.lit(down)).otherwise(F.lit(up))
    entries = F.array(*[
        F.struct(F.lit(m).alias("member"), F.col(f"_leaf{m}").alias("leaf"),
                 weights[m].alias("share"), F.col(f"_hit{m}").cast("int").alias("correct"),
                 (F.col(f"_u{m}") if bagged else F.lit(None).cast("long")).alias("u"))
        for m in m_all
    ])
    opened = staged.select(*rows.columns, F.explode(entries).alias("e")).select(
        *rows.columns, "e.*")
    draw = poisson_weight(F.col("u")) if bagged else F.lit(1.0)
    return opened.withColumn("w", F.col("weight") * F.col("share") * draw).drop("share", "u")


# --- statistics ------------------------------------------------------------------------------


def leaf_cells(chunk: DataFrame, model: Model) -> DataFrame:
    """Sums per (member, leaf, label, code values); everything the split test needs.

    Frame codes have at most 5 x 17 combinations, so grouping by them jointly keeps one aggregate
    with map-side combine instead of one expansion per feature.
    """
    numbers = [f for f in model.features if not is_code(f)]
    codes = [f for f in model.features if is_code(f)]
    keys = PACKET_ORDER if model.model_id == "leveraging_bag" else ()
    rows = with_members(chunk.select(*keys, "label", "weight", *numbers, *codes), model)
    w = F.col("w")
    seen = [F.when(w > 0, F.col(f)) for f in numbers]
    return rows.groupBy("member", "leaf", "label", *codes).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum("correct").alias("hits"),
        F.sum(w * F.col("correct")).alias("w_hits"),
        *[F.sum(w * F.col(f)).alias(f"sx_{f}") for f in numbers],
        *[F.sum(w * F.col(f) * F.col(f)).alias(f"sxx_{f}") for f in numbers],
        *[F.min(s).alias(f"lo_{f}") for s, f in zip(seen, numbers)],
        *[F.max(s).alias(f"hi_{f}") for s, f in zip(seen, numbers)],
    )


def _entropy_term(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _normal_below(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error < 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
                + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * F.lit(1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def split_tests(
    cells: DataFrame, model: Model, settings: LearnerSettings, fresh: Column | None = None
) -> DataFrame:
    """Per leaf: class weights, the best split and the gain of the runner-up feature.

    The ``fresh_*`` columns sum what the current chunk added.
    """
    fresh = F.lit(True) if fresh is None else fresh
    cells = cells.withColumn("fresh", fresh)
    if all(f in CODE_FEATURES for f in model.features if is_code(f)):
        # a leaf has at most labels x 85 cells here, so one exchange by leaf serves every
        # grouping, window and join below; address features have no such limit
        cells = cells.repartition("member", "leaf")
    numbers = [f for f in model.features if not is_code(f)]
    codes = [f for f in model.features if is_code(f)]
    leaf = ["member", "leaf"]
    per_label = cells.groupBy(*leaf, "label").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"),
        *[F.sum(F.when(F.col("fresh"), F.col(c)).otherwise(0)).alias(f"fresh_{c}")
          for c in ("n", "hits", "w", "w_hits")],
        *[F.sum(f"sx_{f}").alias(f"sx_{f}") for f in numbers],
        *[F.sum(f"sxx_{f}").alias(f"sxx_{f}") for f in numbers],
        *[F.min(f"lo_{f}").alias(f"lo_{f}") for f in numbers],
        *[F.max(f"hi_{f}").alias(f"hi_{f}") for f in numbers],
    )
    totals = per_label.groupBy(*leaf).agg(
        F.sum("n").alias("n"), F.sum("w").alias("total"),
        F.sum(_entropy_term(F.col("w"))).alias("total_wlw"),
        F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("weights"),
        *[F.sum(f"fresh_{c}").alias(f"fresh_{c}") for c in ("n", "hits", "w", "w_hits")],
    )
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.try_divide(F.col(f"sx_{f}"), F.col("w")).alias("mean"),
            F.try_divide(F.col(f"sxx_{f}"), F.col("w")).alias("square"),
            F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi"),
        ) for f in numbers
    ])
    at_feature = Window.partitionBy(*leaf, "feature")  # one row per label
    spread = per_label.select(*leaf, "label", "w", F.explode(entries).alias("e")).select(
        *leaf, "label", "w", "e.*"
    )
    ranged = spread.select(
        "*", F.min("lo").over(at_feature).alias("low"), F.max("hi").over(at_feature).alias("high")
    ).where((F.col("w") > 0) & (F.col("high") > F.col("low")))
    steps = F.sequence(F.lit(1), F.lit(settings.cut_points))
    cut = ranged.select("*", F.explode(steps).alias("i")).withColumn(
        "threshold",
        F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (settings.cut_points + 1),
    )
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    below = (
        F.when(F.col("threshold") < F.col("lo"), F.lit(0.0))
        .when(F.col("threshold") >= F.col("hi"), F.lit(1.0))
        .otherwise(_normal_below((F.col("threshold") - F.col("mean"))
                                 / F.greatest(deviation, F.lit(1e-9))))
    )
    number_rows = cut.select(
        *leaf, "feature", F.lit(NUMBER).alias("kind"), "threshold",
        F.lit(None).cast("string").alias("code"), "label", F.col("w").alias("t"),
        (F.col("w") * below).alias("l"),
    )
    code_entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("code"))
                             for f in codes])
    label_total = F.sum("l").over(Window.partitionBy(*leaf, "feature", "label"))
    code_rows = (
        cells.select(*leaf, "label", "w", F.explode(code_entries).alias("e"))
        .groupBy(*leaf, "label", "e.feature", "e.code").agg(F.sum("w").alias("l"))
        .select(*leaf, "feature", F.lit(CODE).alias("kind"),
                F.lit(None).cast("double").alias("threshold"), "code", "label",
                label_total.alias("t"), "l")
    )
    right = F.greatest(F.col("t") - F.col("l"), F.lit(0.0))
    # labels without any row on the left are absent here; their share of the right side is
    # already part of the leaf's own sum
    candidates = number_rows.unionByName(code_rows).groupBy(
        *leaf, "feature", "kind", "threshold", "code"
    ).agg(
        F.sum("l").alias("left"),
        F.sum(_entropy_term(F.col("l"))).alias("left_wlw"),
        F.sum(_entropy_term(right) - _entropy_term(F.col("t"))).alias("right_shift"),
        F.map_from_entries(F.collect_list(F.struct("label", "l"))).alias("left_weights"),
    )
    w, lw = F.col("total"), F.col("left")
    rw = w - lw
    gain = (
        (F.log2(w) * w - F.col("total_wlw"))
        - (F.log2(lw) * lw - F.col("left_wlw"))
        - (F.log2(rw) * rw - (F.col("total_wlw") + F.col("right_shift")))
    ) / w
    narrow = settings.min_branch
    judged = candidates.join(totals.select(*leaf, "total", "total_wlw"), leaf).where(
        (lw >= narrow * w) & (rw >= narrow * w)
    ).withColumn("gain", gain)
    choice = F.struct("gain", "feature", "kind", "threshold", "code", "left_weights")
    rank = F.struct("gain", "feature", F.coalesce("threshold", F.lit(0.0)),
                    F.coalesce("code", F.lit("")))
    per_feature = judged.groupBy(*leaf, "feature").agg(F.max_by(choice, rank).alias("best"))
    top = per_feature.groupBy(*leaf).agg(
        F.max_by("best", F.struct("best.gain", "best.feature")).alias("best"),
        F.sort_array(F.collect_list("best.gain"), asc=False).alias("gains"),
    )
    return totals.join(top, leaf, "left").select(
        *leaf, "n", "total", "weights", "best", F.try_element_at("gains", F.lit(2)).alias("second"),
        *[f"fresh_{c}" for c in ("n", "hits", "w", "w_hits")],
    )


# --- model edits on the driver (bounded by the leaf limit) ----------------------------------------


def window_cut(series: list[tuple[float, float]], delta: float) -> int | None:
    """Adaptive windowing over (rows, errors) per bucket, oldest first: where the old part should be dropped."""
    n_all, e_all = sum(n for n, _ in series), sum(e for _, e in series)
    if n_all <= 0:
        return None
    mean_all = e_all / n_all
    spread = mean_all * (1 - mean_all)
    log_term = math.log(2 * math.log(max(n_all, 3)) / delta)
    n0 = e0 = 0.0
    for i, (n, e) in enumerate(series[:-1], 1):
        n0, e0 = n0 + n, e0 + e
        n1, e1 = n_all - n0, e_all - e0
        if n0 <= 0 or n1 <= 0:
            continue
        m = 1 / (1 / n0 + 1 / n1)
        bound = math.sqrt(2 / m * spread * log_term) + 2 / (3 * m) * log_term
        if abs(e0 / n0 - e1 / n1) > bound:
            return i
    return None


class ErrorWindow:
    """An adaptive window whose memory is logarithmic in the chunks it spans.

    Buckets of level ``k`` sum up ``2**k`` chunks. At most ``PER_LEVEL`` of a level are kept; with one more, the two
    oldest become one of the next level. The window is cut between buckets, from the oldest on.
    """

    PER_LEVEL = 5

    def __init__(self) -> None:
        self.levels: list[list[tuple[float, float]]] = []  # by level, oldest first

    def buckets(self) -> list[tuple[float, float]]:
        return [b for level in reversed(self.levels) for b in level]

    def add(self, rows: float, errors: float) -> None:
        carried, level = [(rows, errors)], 0
        while carried:
            if level == len(self.levels):
                self.levels.append([])
            own = self.levels[level]
            own += carried
            carried = []
            if len(own) > self.PER_LEVEL:
                (n0, e0), (n1, e1) = own[:2]
                del own[:2]
                carried = [(n0 + n1, e0 + e1)]
            level += 1

    def drop(self, count: int) -> None:
        """Forgets the ``count`` oldest buckets."""
        for level in reversed(self.levels):
            gone = min(count, len(level))
            del level[:gone]
            count -= gone
        while self.levels and not self.levels[-1]:
            self.levels.pop()

    def mean(self) -> float:
        values = self.buckets()
        return sum(e for _, e in values) / max(sum(n for n, _ in values), 1e-9)


class DriftMonitor:
    """One adaptive error window per tree or node."""

    def __init__(self, delta: float) -> None:
        self.delta = delta
        self.windows: dict[tuple[int, int], ErrorWindow] = defaultdict(ErrorWindow)

    def update(self, key: tuple[int, int], rows: float, errors: float) -> bool:
        """True when the recent error is significantly higher than the older one."""
        if rows <= 0:
            return False
        window = self.windows[key]
        window.add(rows, errors)
        worse = False
        while (at := window_cut(window.buckets(), self.delta)) is not None:
            before = window.buckets()[:at]
            window.drop(at)
            rate = sum(e for _, e in before) / max(sum(n for n, _ in before), 1e-9)
            worse = worse or window.mean() > rate
        return worse

    def mean(self, key: tuple[int, int]) -> float:
        return self.windows[key].mean()

    def forget(self, key: tuple[int, int]) -> None:
        self.windows.pop(key, None)


def _add(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in {*a, *b}}


def _grow(model: Model, tests: list, settings: LearnerSettings) -> None:
    for row in tests:
        tree = model.trees[row["member"]]
        node = tree.nodes.get(row["leaf"])
        if node is None or node.feature is not None:
            continue
        node.weights = dict(row["weights"])
        best = row["best"]
        total = row["total"] or 0.0
        if best is None or total < settings.grace_weight or node.depth >= settings.max_depth:
            continue
        if len(tree.leaves()) >= settings.max_leaves:
            continue
        span = math.log2(max(len(model.classes), 2))
        bound = math.sqrt(span**2 * math.log(1 / settings.delta) / (2 * total))
        lead = best["gain"] - max(row["second"] or 0.0, 0.0)
        if best["gain"] <= 0 or not (lead > bound or bound < settings.tie):
            continue
        left = {k: v for k, v in best["left_weights"].items()}
        right = {k: max(v - left.get(k, 0.0), 0.0) for k, v in node.weights.items()}
        node.left = tree.new_node(weights=left, depth=node.depth + 1)
        node.right = tree.new_node(weights=right, depth=node.depth + 1)
        node.feature, node.kind = best["feature"], best["kind"]
        node.threshold, node.code = best["threshold"], best["code"]


def _node_errors(tree: Tree, leaf_rows: dict[int, tuple[float, float]]) -> dict[int, tuple]:
    """Rows and errors of every node, rolled up from the leaves."""
    out: dict[int, tuple[float, float]] = {}

    def walk(i: int) -> tuple[float, float]:
        node = tree.nodes[i]
        if node.feature is None:
            out[i] = leaf_rows.get(i, (0.0, 0.0))
        else:
            (n0, e0), (n1, e1) = walk(node.left), walk(node.right)
            out[i] = (n0 + n1, e0 + e1)
        return out[i]

    walk(tree.root)
    return out


def _replace_branch(tree: Tree, node_id: int) -> None:
    """Turn a test back into a fresh leaf that starts from the classes below it."""
    below = reduce(_add, (tree.nodes[i].weights for i in tree.leaves(node_id)), {})
    fresh = tree.new_node(weights=below, depth=tree.nodes[node_id].depth)
    for node in tree.nodes.values():
        if node.left == node_id:
            node.left = fresh
        if node.right == node_id:
            node.right = fresh
    if tree.root == node_id:
        tree.root = fresh
    keep, stack = set(), [tree.root]
    while stack:
        i = stack.pop()
        keep.add(i)
        if tree.nodes[i].feature is not None:
            stack += [tree.nodes[i].left, tree.nodes[i].right]
    tree.nodes = {i: n for i, n in tree.nodes.items() if i in keep}


def _react_to_drift(model: Model, errors: dict[int, dict[int, tuple[float, float]]],
                    monitor: DriftMonitor) -> None:
    drifted = []
    for m, tree in enumerate(model.trees):
        by_node = _node_errors(tree, errors.get(m, {}))
        if model.model_id == "adaptive_hoeffding_tree":
            for i in sorted(by_node, key=lambda i: tree.nodes[i].depth):
                if i in tree.nodes and tree.nodes[i].feature is not None:
                    if monitor.update((m, i), *by_node[i]):
                        _replace_branch(tree, i)
        elif monitor.update((m, -1), *by_node[tree.root]):
            drifted.append(m)
    if not drifted or model.model_id == "oza_boost":
        return
    if model.model_id == "leveraging_bag":
        drifted = [max(range(len(model.trees)), key=lambda m: monitor.mean((m, -1)))]
    for m in drifted:
        old = model.trees[m]
        root = Node(weights=reduce(_add, (old.nodes[i].weights for i in old.leaves()), {}))
        # ids are never reused, so stored statistics of the dropped tree stay out of the new one
        model.trees[m] = Tree(nodes={old.next_id: root}, root=old.next_id, next_id=old.next_id + 1)
        model.right_weight[m] = model.wrong_weight[m] = 0.0
        monitor.forget((m, -1))


# --- jobs ------------------------------------------------------------------------------------


def _last_position(placed: DataFrame) -> DataFrame:
    """One row with the end of the position range; positions may have gaps, as in a train part."""
    return placed.agg((F.coalesce(F.max("frame_pos"), F.lit(0)) + 1).alias("_total"))


def _inputs_of(
    rows: DataFrame, features: FeatureSettings, label: str, weight: str | None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Labelled rows with their place, label, weight and model inputs."""
    placed = ensure_position(rows.where(F.col(label).isNotNull()))
    if "file_ordinal" not in placed.columns:
        placed = placed.withColumn("file_ordinal", F.lit(0))
    share = F.lit(1.0) if weight is None else F.coalesce(
        column_or_null(placed, weight, "double"), F.lit(1.0))
    return placed.select(
        *PACKET_ORDER, "frame_pos",
        F.col(label).cast("string").alias("label"), share.cast("double").alias("weight"),
        *[c.alias(n) for n, c in model_inputs(placed, features).items()],
        *[F.col(c).alias(f"row_{c}") for c in keep],
    )


def training_inputs(
    rows: DataFrame, features: FeatureSettings, *, label: str = "label", weight: str | None = None
) -> DataFrame:
    """Labelled model inputs stored once in file order; every prefix of it can be trained on (``train_prefix``), as a
    range of positions only touches the files and row groups it lies in."""
    placed = _inputs_of(rows, features, label, weight)
    return materialise(placed.repartitionByRange("frame_pos").sortWithinPartitions("frame_pos"), "training-inputs")


def training_table(
    rows: DataFrame,
    features: FeatureSettings,
    *,
    chunks: int,
    label: str = "label",
    weight: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Labelled model inputs stored by chunk, so every pass reads only its own chunk."""
    placed = _inputs_of(rows, features, label, weight, keep)
    chunk = F.floor(F.col("frame_pos") * chunks / F.col("_total")).cast("int")
    out = placed.crossJoin(F.broadcast(_last_position(placed))).withColumn("chunk", chunk).drop("_total")
    return materialise(out, "training-rows", ("chunk",))


def learn_chunk(rows: DataFrame, chunk: int, model: Model, monitor: DriftMonitor,
                settings: LearnerSettings, store: str) -> int:
    """Learn the rows of one chunk and edit the model; returns the rows learned."""
    spark = rows.sparkSession
    cells = leaf_cells(rows, model)
    cells.write.parquet(f"{store}/chunk={chunk}")
    # statistics of a leaf live in the chunks since it was created
    history = spark.read.option("basePath", store).schema(cells.schema).parquet(
        *[f"{store}/chunk={c}" for c in range(chunk + 1)])
    active = [(m, i) for m, t in enumerate(model.trees) for i in t.leaves()]
    current = local_frame(spark, active, "member int, leaf int")
    fresh = F.col("chunk") == chunk
    mine = history.join(F.broadcast(current), ["member", "leaf"])
    # new nodes are numbered in this order, so it must not depend on how the rows were dealt
    tests = sorted(split_tests(mine, model, settings, fresh).collect(), key=lambda r: (r["member"], r["leaf"]))
    errors: dict[int, dict[int, tuple[float, float]]] = defaultdict(dict)
    learned = 0
    for r in tests:
        model.classes = sorted({*model.classes, *r["weights"]})
        errors[r["member"]][r["leaf"]] = (r["fresh_n"], r["fresh_n"] - r["fresh_hits"])
        model.right_weight[r["member"]] += r["fresh_w_hits"]
        model.wrong_weight[r["member"]] += r["fresh_w"] - r["fresh_w_hits"]
        learned += r["fresh_n"] if r["member"] == 0 else 0
    _grow(model, tests, settings)
    _react_to_drift(model, errors, monitor)
    return learned


def train(
    rows: DataFrame,
    model_id: str,
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    *,
    label: str = "label",
    weight: str | None = None,
    seed: int = 42,
) -> tuple[Model, int]:
    """Train in file order; returns the model and the number of rows learned."""
    table = training_table(rows, features, chunks=settings.chunks, label=label, weight=weight)
    parts = [table.where(F.col("chunk") == c) for c in range(settings.chunks)]
    return _learn(parts, new_model(model_id, features, n_models=settings.n_models, seed=seed), settings)


def _learn(parts: list[DataFrame], model: Model, settings: LearnerSettings) -> tuple[Model, int]:
    monitor = DriftMonitor(settings.drift_delta)
    store = work_path(parts[0].sparkSession, "leaf-cells")
    learned = sum(learn_chunk(rows, c, model, monitor, settings, store) for c, rows in enumerate(parts))
    return model, learned


def train_prefix(
    inputs: DataFrame,
    end: int,
    model_id: str,
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    *,
    seed: int = 42,
) -> tuple[Model, int]:
    """As ``train`` on the rows of ``training_inputs`` that stand before position ``end``, without a copy of them."""
    last = inputs.where(F.col("frame_pos") < end).agg(F.max("frame_pos")).first()[0]
    total = 1 if last is None else last + 1
    edges = [-(-c * total // settings.chunks) for c in range(settings.chunks + 1)]
    parts = [inputs.where((F.col("frame_pos") >= lo) & (F.col("frame_pos") < hi)) for lo, hi in zip(edges, edges[1:])]
    return _learn(parts, new_model(model_id, features, n_models=settings.n_models, seed=seed), settings)


def prequential(
    rows: DataFrame,
    model_id: str,
    features: FeatureSettings = FeatureSettings(),
    settings: LearnerSettings = LearnerSettings(),
    *,
    label: str = "label",
    weight: str | None = None,
    seed: int = 42,
) -> tuple[Model, DataFrame]:
    """Test, then train: every chunk is scored by the model of the chunks before it."""
    spark = rows.sparkSession
    placed = ensure_position(rows.where(F.col(label).isNotNull()))
    stored = materialise(
        placed.crossJoin(F.broadcast(_last_position(placed))).withColumn(
            "chunk", F.floor(F.col("frame_pos") * settings.chunks / F.col("_total")).cast("int")
        ).drop("_total"),
        "labelled-rows", ("chunk",),
    )
    if "file_ordinal" not in stored.columns:
        stored = stored.withColumn("file_ordinal", F.lit(0))
    inputs = model_inputs(stored, features)
    share = F.lit(1.0) if weight is None else F.coalesce(
        column_or_null(stored, weight, "double"), F.lit(1.0))
    table = stored.select(
        *PACKET_ORDER, F.col(label).cast("string").alias("label"), share.alias("weight"),
        *[c.alias(n) for n, c in inputs.items()], "chunk",
    )
    model = new_model(model_id, features, n_models=settings.n_models, seed=seed)
    monitor = DriftMonitor(settings.drift_delta)
    store = work_path(spark, "leaf-cells")
    out = work_path(spark, "prequential")
    schema = None
    for c in range(settings.chunks):
        scored = classify(stored.where(F.col("chunk") == c), model, features, label=label)
        schema = scored.schema
        scored.write.parquet(f"{out}/part={c}")
        learn_chunk(table.where(F.col("chunk") == c), c, model, monitor, settings, store)
    return model, spark.read.schema(schema).parquet(
        *[f"{out}/part={c}" for c in range(settings.chunks)])
