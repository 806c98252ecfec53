"""Tree ensembles fitted by Spark ML, as plain arrays that tasks can apply to batches of feature rows."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark takes the places of splits from all rows up to the square of this number (the largest it can square), from a sample
#: beyond. Bins are made for values that occur, so a feature of few values has few.
MOST_BINS = 46_340


class Forest:
    """``weights`` and, per tree, feature (-1 at leaves), threshold, children and value of every node."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float], boosted: bool):
        self.weights, self.boosted = weights, boosted
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of every row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees):
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            total += weight * value[node]
        return 1 / (1 + np.exp(-2 * total)) if self.boosted else total / sum(self.weights)


def _nodes(root, leaf_value) -> list[tuple[int, float, int, int, float]]:
    out: list[tuple[int, float, int, int, float]] = []

    def add(node) -> int:
        number = len(out)
        out.append((-1, 0.0, 0, 0, 0.0))
        if node.getClass().getSimpleName() == "LeafNode":
            out[number] = (-1, 0.0, 0, 0, leaf_value(node))
        else:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            out[number] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return number

    add(root)
    return out


def _share(node) -> float:
    stats = list(node.impurityStats().stats())
    return stats[1] / max(sum(stats), 1e-9) if len(stats) > 1 else 0.0


def _prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (x array<double>, y) in one partition: a bounded training set, and the same model at any parallelism."""
    return rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")).coalesce(1).cache()


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length without NULL, at least one."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _residuals(made: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = batch.column(1).to_numpy() - made.scores(matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(4096 * left) / 1024)], names=["x", "label"])

    return run


def boosted(rows: DataFrame, trees: int = 12, depth: int = 4, rate: float = 0.3) -> Forest:
    """Gradient boosting (log loss) on all ``rows`` (x array<double>, y 0 or 1), dealt over tasks as they come. Residuals are
    multiples of 2^-10, so their sums and those of their squares are exact up to 2^29 rows: the same model at any parallelism."""
    learner = DecisionTreeRegressor(maxDepth=depth, maxBins=MOST_BINS, minInstancesPerNode=2, seed=7)
    made = Forest([], [], True)
    nodes: list[list[tuple[int, float, int, int, float]]] = []
    for _ in range(trees):
        data = rows.select("x", "y").mapInArrow(_residuals(made), "x array<double>, label double")
        data = data.select(array_to_vector("x").alias("features"), "label").cache()
        nodes.append(_nodes(learner.fit(data)._call_java("rootNode"), lambda n: n.prediction()))
        data.unpersist()
        made = Forest(nodes, [0.5] + [rate] * (len(nodes) - 1), True)
    return made


def random_forest(rows: DataFrame, trees: int = 20, depth: int = 6) -> Forest:
    data = _prepared(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=2).fit(data)
    made = [_nodes(t._call_java("rootNode"), _share) for t in model.trees]
    data.unpersist()
    return Forest(made, [1.0] * len(made), False)
