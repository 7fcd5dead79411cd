"""Boosted trees: training with Spark ML, text dumps of trees, and scoring of a dump as one column expression.

A dump has ``feature_names=...`` and blocks ``Tree=i`` with lines ``split_feature``, ``threshold``, ``decision_type``, ``left_child``, ``right_child``,
``leaf_value``, and for sets of categories ``cat_boundaries`` and ``cat_threshold``. Child -k is leaf k - 1. Bit 0 of the decision type says that the
split is by category, bit 1 that missing values go left, bits 2 and 3 what is missing (0 none, 1 zero, 2 NaN).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    decision: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[float] = field(default_factory=list)
    cat_boundaries: list[int] = field(default_factory=list)
    cat_threshold: list[int] = field(default_factory=list)


LOWEST = -1.7976931348623157e308

FIELDS = {"split_feature": ("feature", int), "threshold": ("threshold", float), "decision_type": ("decision", int), "left_child": ("left", int), "right_child": ("right", int), "leaf_value": ("leaf", float), "cat_boundaries": ("cat_boundaries", int), "cat_threshold": ("cat_threshold", int)}


def parse(text: str) -> tuple[list[str], list[Tree]]:
    """Feature names and trees of a dump."""
    names, trees = [], []
    for line in text.splitlines():
        key, _, value = line.partition("=")
        if key == "Tree":
            trees.append(Tree())
        elif key == "end of trees":
            break
        elif key == "feature_names":
            names = value.split()
        elif trees and key in FIELDS:
            name, kind = FIELDS[key]
            setattr(trees[-1], name, [kind(float(x)) if kind is int else float(x) for x in value.split()])
    return names, trees


def dump(names: list[str], trees: list[Tree]) -> str:
    """The text that ``parse`` reads back as the same trees."""
    lines = ["feature_names=" + " ".join(names)]
    for i, tree in enumerate(trees):
        lines += ["", f"Tree={i}"] + [f"{key}=" + " ".join(map(repr, getattr(tree, name))) for key, (name, _) in FIELDS.items() if getattr(tree, name)]
    return "\n".join([*lines, "", "end of trees", ""])


def _goes_left(tree: Tree, i: int, x: Column) -> Column:
    kind, number = tree.decision[i], x.cast("double")
    unknown = number.isNull() | F.isnan(number)
    if kind & 1:
        at = int(tree.threshold[i])
        words = tree.cat_threshold[tree.cat_boundaries[at] : tree.cat_boundaries[at + 1]]
        members = [32 * k + b for k, w in enumerate(words) for b in range(32) if w >> b & 1]
        return F.when(unknown, F.lit(False)).otherwise(F.floor(number).isin(members))
    absent, default = kind >> 2 & 3, bool(kind & 2)
    below = F.coalesce(F.when(F.isnan(number), F.lit(0.0)).otherwise(number), F.lit(0.0)) <= tree.threshold[i]
    if absent == 2:
        return F.when(unknown, F.lit(default)).otherwise(number <= tree.threshold[i])
    if absent == 1:
        return F.when(unknown | (F.abs(number) <= 1e-35), F.lit(default)).otherwise(number <= tree.threshold[i])
    return below


def tree_column(tree: Tree, columns: list[Column]) -> Column:
    """A tree as nested conditions."""

    def node(i: int) -> Column:
        if i < 0:
            return F.lit(tree.leaf[-i - 1])
        return F.when(_goes_left(tree, i, columns[tree.feature[i]]), node(tree.left[i])).otherwise(node(tree.right[i]))

    return node(0) if tree.feature else F.lit(tree.leaf[0])


def score_column(text: str, columns: dict[str, str] | None = None, first: int = 0, count: int | None = None, raw: bool = False) -> Column:
    """Probability (or the raw sum) from the trees first, first + 1, ...; ``columns`` renames features."""
    names, trees = parse(text)
    used = trees[first : None if count is None else first + count]
    inputs = [F.col((columns or {}).get(n, n)) for n in names]
    total = F.lit(0.0)
    for t in used:
        total = total + tree_column(t, inputs)
    return total if raw else sigmoid(total)


def _assembled(df: DataFrame, features: list[str], categorical: dict[str, int]) -> DataFrame:
    """A vector of the features; a categorical one of k values, from -1 or 0 on, is marked as such and split by sets of its values. A missing number is the lowest there is, as vectors may hold no NaN."""
    numbers = {c: F.col(c).cast("double") for c in features}
    numbers |= {c: F.coalesce(F.when(~F.isnan(x), x), F.lit(LOWEST)) for c, x in numbers.items() if c not in categorical}
    kind = lambda c: {"metadata": {"ml_attr": {"type": "nominal", "num_vals": categorical[c] + 1}}} if c in categorical else {}
    rows = df.select("*", *[(F.coalesce(x, F.lit(-1.0)) + 1 if c in categorical else x).alias(f"_{c}", **kind(c)) for c, x in numbers.items()])
    return VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="features").transform(rows).drop(*[f"_{c}" for c in features])


def train_gbt(df: DataFrame, label: str, weight: str | None = None, rounds: int = 10, step: float = 0.05, depth: int = 5, seed: int = 1, categorical: dict[str, int] | None = None) -> tuple[list[str], GBTClassificationModel]:
    """Gradient-boosted trees on all other columns; nulls and NaN lie below every number. ``categorical``: features that are classes, such as the bins, with their number of values.

    A tree of depth 5 has at most 32 leaves.
    """
    features = [c for c in df.columns if c not in (label, weight)]
    rows = _assembled(df, features, categorical or {})
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed, maxBins=max(32, *(k + 1 for k in (categorical or {}).values()), 0), **({"weightCol": weight} if weight else {}))
    return features, model.fit(rows.withColumn(label, F.col(label).cast("double")))


def predict_gbt(df: DataFrame, features: list[str], model: GBTClassificationModel, categorical: dict[str, int] | None = None) -> DataFrame:
    """Adds y_pred, the probability of class 1; ``categorical`` as in training."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(_assembled(df, features, categorical or {})).withColumn("y_pred", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def trees_of(features: list[str], model: GBTClassificationModel, categorical: dict[str, int] | None = None) -> list[Tree]:
    """A trained model's trees, such that ``score_column`` of their dump is ``predict_gbt``; ``categorical`` as in training.

    A missing number goes left at every threshold, a missing class is -1, which no set of classes holds: a split that sends it left is turned round.
    """
    out = []
    for trained, weight in zip(model.trees, model.treeWeights, strict=True):
        tree = Tree()

        def add(node, tree: Tree = tree, weight: float = weight) -> int:
            if node.getClass().getSimpleName() == "LeafNode":
                tree.leaf.append(2 * weight * node.prediction())
                return -len(tree.leaf)
            at, split = len(tree.feature), node.split()
            left, right = node.leftChild(), node.rightChild()
            tree.feature.append(split.featureIndex())
            if features[split.featureIndex()] in (categorical or {}):
                classes = {int(c) for c in split.leftCategories()}
                if 0 in classes:
                    classes, left, right = {int(c) for c in split.rightCategories()}, right, left
                tree.cat_boundaries = tree.cat_boundaries or [0]
                tree.threshold.append(float(len(tree.cat_boundaries) - 1))
                tree.decision.append(1)
                words = [0] * ((max(classes) - 1) // 32 + 1)
                for c in classes:  # class c stands for the value c - 1
                    words[(c - 1) // 32] |= 1 << (c - 1) % 32
                tree.cat_threshold += words
                tree.cat_boundaries.append(len(tree.cat_threshold))
            else:
                tree.threshold.append(split.threshold())
                tree.decision.append(8 | 2)
            tree.left.append(0)
            tree.right.append(0)
            tree.left[at] = add(left)
            tree.right[at] = add(right)
            return at

        add(trained._java_obj.rootNode())
        out.append(tree)
    return out


def save_gbt(features: list[str], model: GBTClassificationModel, path: str) -> None:
    """The model, and beside it its features in order."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.builder.getOrCreate()
    spark.createDataFrame(list(enumerate(features)), "i int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_gbt(spark: SparkSession, path: str) -> tuple[list[str], GBTClassificationModel]:
    rows = spark.read.parquet(f"{path}/features").orderBy("i").collect()
    return [r["name"] for r in rows], GBTClassificationModel.load(f"{path}/model")
