"""Decision-tree models as small tables, compiled to Column expressions for scoring."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense.functions.columns import (
    FeatureSettings,
    features_struct,
    map_json,
    model_feature_columns,
    resolve_confidence,
    resolve_prediction,
)
from ethersense.schemas import column_or_null
from ethersense.session import local_frame

FORMAT_VERSION = 1
NUMBER, CODE = "number", "code"


@dataclass
class Node:
    """A leaf (no feature) or a binary test; the left side is ``<= threshold`` or ``= code``."""

    feature: str | None = None
    kind: str | None = None
    threshold: float | None = None
    code: str | None = None
    left: int | None = None
    right: int | None = None
    weights: dict[str, float] = field(default_factory=dict)
    depth: int = 0


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=lambda: {0: Node()})
    root: int = 0
    next_id: int = 1

    def leaves(self, start: int | None = None) -> list[int]:
        node_id = self.root if start is None else start
        node = self.nodes[node_id]
        if node.feature is None:
            return [node_id]
        return self.leaves(node.left) + self.leaves(node.right)

    def new_node(self, **kw) -> int:
        node_id, self.next_id = self.next_id, self.next_id + 1
        self.nodes[node_id] = Node(**kw)
        return node_id


@dataclass
class Model:
    model_id: str
    features: list[str]
    classes: list[str] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=lambda: [Tree()])
    right_weight: list[float] = field(default_factory=lambda: [0.0])
    wrong_weight: list[float] = field(default_factory=lambda: [0.0])
    boosted: bool = False
    seed: int = 42

    def votes(self) -> list[float]:
        """Vote of each member: 1, or log(1/beta) of its weighted error when boosted."""
        if not self.boosted:
            return [1.0] * len(self.trees)
        out = []
        for right, wrong in zip(self.right_weight, self.wrong_weight):
            if right + wrong == 0:
                out.append(1.0)
                continue
            error = min(max(wrong / (right + wrong), 1e-6), 0.5)
            out.append(math.log((1 - error) / error))
        return out if any(out) else [1.0] * len(self.trees)


def is_code(name: str) -> bool:
    return name in ("frame_type", "frame_subtype") or name.startswith(
        ("source_mac", "destination_mac")
    )


def _walk(tree: Tree, node_id: int, leaf) -> Column:
    node = tree.nodes[node_id]
    if node.feature is None:
        return leaf(node_id)
    value = F.col(node.feature)
    test = value <= F.lit(node.threshold) if node.kind == NUMBER else value == F.lit(node.code)
    return F.when(test, _walk(tree, node.left, leaf)).otherwise(_walk(tree, node.right, leaf))


def leaf_column(tree: Tree) -> Column:
    """Leaf id of a row of model features, as nested CASE WHEN that stays in codegen."""
    return _walk(tree, tree.root, lambda i: F.lit(i))


def _shares(weights: dict[str, float], classes: list[str]) -> list[float]:
    total = sum(weights.values())
    if total <= 0:
        return [0.0] * len(classes)
    return [max(weights.get(c, 0.0), 0.0) / total for c in classes]


def probability_array(tree: Tree, classes: list[str]) -> Column:
    return _walk(
        tree,
        tree.root,
        lambda i: F.array(*[F.lit(p) for p in _shares(tree.nodes[i].weights, classes)]),
    )


def majority_column(tree: Tree) -> Column:
    """Class predicted by one tree; null while a leaf has seen nothing."""
    def leaf(i: int) -> Column:
        weights = tree.nodes[i].weights
        known = {c: w for c, w in weights.items() if w > 0}
        if not known:
            return F.lit(None).cast("string")
        return F.lit(min(known, key=lambda c: (-known[c], c)))

    return _walk(tree, tree.root, leaf)


def with_probabilities(features: DataFrame, model: Model, name: str = "probabilities") -> DataFrame:
    """Add map<class, probability>; an untrained model gives an empty map."""
    if not model.classes:
        return features.withColumn(name, F.create_map().cast("map<string,double>"))
    votes = model.votes()
    staged = features.select(
        "*",
        *[probability_array(t, model.classes).alias(f"_tree{m}")
          for m, t in enumerate(model.trees)],
    )
    sums = [
        sum(
            (F.col(f"_tree{m}")[c] * F.lit(votes[m]) for m in range(1, len(votes))),
            F.col("_tree0")[c] * F.lit(votes[0]),
        )
        for c in range(len(model.classes))
    ]
    staged = staged.withColumn("_votes", F.array(*sums))
    total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
    shares = F.when(total > 0, F.transform("_votes", lambda v: v / total))
    probs = F.coalesce(
        F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes]), shares),
        F.create_map().cast("map<string,double>"),
    )
    return staged.withColumn(name, probs).drop(
        "_votes", *[f"_tree{m}" for m in range(len(model.trees))]
    )


def classify(
    rows: DataFrame,
    model: Model,
    settings: FeatureSettings = FeatureSettings(),
    *,
    label_mode: str = "unknown",
    label: str = "label",
    keep: tuple[str, ...] = ("file_ordinal", "frame_pos"),
) -> DataFrame:
    """Feature rows to prediction rows. Narrow: no shuffle and no Python in the row path."""
    carried = [c for c in keep if c in rows.columns]
    prepared = rows.select(
        *carried,
        column_or_null(rows, "timestamp", "double").alias("_timestamp"),
        F.coalesce(column_or_null(rows, "packet_index", "long"), F.lit(0)).alias("_packet_index"),
        F.coalesce(column_or_null(rows, "label_mode", "string"), F.lit(label_mode)).alias("_mode"),
        column_or_null(rows, label, "string").cast("string").alias("_truth"),
        column_or_null(rows, "source_mac", "string").alias("_source"),
        column_or_null(rows, "destination_mac", "string").alias("_destination"),
        features_struct(rows, settings).alias("_features"),
    )
    scored = with_probabilities(prepared.select("*", "_features.*"), model)
    resolved = resolve_prediction(F.lit(None).cast("string"), F.col("probabilities"))
    out = scored.withColumn("predicted_class", resolved)
    return out.select(
        *carried,
        F.col("_timestamp").alias("timestamp"),
        F.col("_packet_index").alias("packet_index"),
        F.col("_mode").alias("label_mode"),
        "predicted_class",
        resolve_confidence(F.col("predicted_class"), F.col("probabilities")).alias("confidence"),
        F.col("_truth").alias("ground_truth"),
        F.col("_source").alias("source_mac"),
        F.col("_destination").alias("destination_mac"),
        F.to_json("_features").alias("features_json"),
        map_json(F.col("probabilities")).alias("probabilities_json"),
        "probabilities",
    )


def model_inputs(rows: DataFrame, settings: FeatureSettings) -> dict[str, Column]:
    return model_feature_columns(rows, settings)


NODE_SCHEMA = T.StructType([
    T.StructField("member", T.IntegerType()), T.StructField("node_id", T.IntegerType()),
    T.StructField("is_root", T.BooleanType()), T.StructField("depth", T.IntegerType()),
    T.StructField("feature", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("code", T.StringType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
])
META_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("model_id", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("right_weight", T.ArrayType(T.DoubleType())),
    T.StructField("wrong_weight", T.ArrayType(T.DoubleType())),
    T.StructField("next_ids", T.ArrayType(T.IntegerType())),
    T.StructField("boosted", T.BooleanType()), T.StructField("seed", T.LongType()),
])


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [
        (m, i, i == tree.root, n.depth, n.feature, n.kind, n.threshold, n.code, n.left, n.right,
         {k: float(v) for k, v in n.weights.items()})
        for m, tree in enumerate(model.trees)
        for i, n in sorted(tree.nodes.items())
    ]
    return local_frame(spark, rows, NODE_SCHEMA)


def save_model(spark: SparkSession, model: Model, path: str, version: int = FORMAT_VERSION) -> None:
    meta = [(
        version, model.model_id, model.features, model.classes, model.right_weight,
        model.wrong_weight, [t.next_id for t in model.trees], model.boosted, model.seed,
    )]
    node_table(spark, model).coalesce(1).write.mode("errorifexists").parquet(f"{path}/nodes")
    local_frame(spark, meta, META_SCHEMA).coalesce(1).write.parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Model:
    meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
    if meta["version"] != FORMAT_VERSION:
        raise ValueError(f"unsupported model version: {meta['version']}")
    trees = [Tree(nodes={}, next_id=i) for i in meta["next_ids"]]
    # a model has at most members x leaf limit nodes
    for r in spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toLocalIterator():
        trees[r["member"]].nodes[r["node_id"]] = Node(
            r["feature"], r["kind"], r["threshold"], r["code"], r["left"], r["right"],
            dict(r["weights"] or {}), r["depth"],
        )
        if r["is_root"]:
            trees[r["member"]].root = r["node_id"]
    return Model(
        meta["model_id"], list(meta["features"]), list(meta["classes"]), trees,
        list(meta["right_weight"]), list(meta["wrong_weight"]), meta["boosted"], meta["seed"],
    )
