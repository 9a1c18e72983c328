"""Exact additive contributions of a boosted tree model.

The trees are read back from the saved model, a table bounded by the model's size.  Inside tasks
every tree is walked once for a whole batch of rows.  On the way down a path is a polynomial with
one factor per feature: the share of training cover that goes the path's way, plus one power for
rows that go it themselves.  Leaves below a node share the polynomial of its path; a split adds a
factor, a feature that is met again has its factor taken out first, and at a leaf the factor of
each feature is divided out in turn, which gives its Shapley value.  Rows between the same
thresholds of a tree share its values, so of a batch it walks one row for each such cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from casemill.session import shared_dir


@dataclass
class Tree:
    """Nodes by number: children (-1 at leaves), split feature and threshold, training cover, value of a leaf."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def expected(self) -> float:
        """Mean value over the training cover."""
        leaf = self.left < 0
        return float((self.value[leaf] * self.cover[leaf]).sum() / self.cover[0])


def read_trees(model: Model, spark) -> list[Tree]:
    """The trees of a model, scaled to log-odds.  Splits on categories are an error."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    node = "nodeData."
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{node}id", f"{node}prediction", F.col(f"{node}impurityStats")[0].alias("cover"),
        f"{node}leftChild", f"{node}rightChild", F.col(f"{node}split.featureIndex").alias("f"),
        F.get(F.col(f"{node}split.leftCategoriesOrThreshold"), F.lit(0)).alias("t"), F.col(f"{node}split.numCategories").alias("categories"),
    ).toPandas()
    if ((table["leftChild"] >= 0) & (table["categories"] >= 0)).any():
        raise ValueError("the model splits on categories: only thresholds have intervals")
    trees = []
    for number, rows in table.sort_values(["treeID", "id"]).groupby("treeID"):
        # The probability is the logistic function of twice the weighted sum.
        value = 2.0 * model.treeWeights[number] * rows["prediction"].to_numpy()
        left, right, feature = (rows[c].to_numpy(dtype=np.int64) for c in ("leftChild", "rightChild", "f"))
        trees.append(Tree(left, right, feature, rows["t"].fillna(0.0).to_numpy(dtype=float), rows["cover"].to_numpy(dtype=float), value))
    return trees


def _extend(poly: np.ndarray, cover: float, met: np.ndarray) -> np.ndarray:
    """Times one factor more: ``cover``, and for rows that meet it a power."""
    out = np.zeros((len(poly), poly.shape[1] + 1))
    out[:, :-1] = poly * cover
    out[:, 1:] += poly * met[:, None]
    return out


def _unwind(poly: np.ndarray, cover: float, met: np.ndarray) -> np.ndarray:
    """Without one of its factors: division from the top where the factor has a power, else by the cover."""
    m = poly.shape[1] - 1
    out = np.empty((len(poly), m))
    out[:, m - 1] = poly[:, m]
    for k in range(m - 1, 0, -1):
        out[:, k - 1] = poly[:, k] - cover * out[:, k]
    return np.where(met[:, None], out, poly[:, :m] / cover)


def _cells(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """One row of every cell between the thresholds of ``tree``, and the cell of every row."""
    inner = tree.left >= 0
    code = np.zeros(len(x), np.int64)
    for f in np.unique(tree.feature[inner]):
        cuts = np.unique(tree.threshold[inner & (tree.feature == f)])
        place = np.searchsorted(cuts, x[:, f], side="left")  # a value at a threshold goes left
        # Codes met so far are numbered anew, which keeps them below the number of rows.
        code = np.unique(code, return_inverse=True)[1] * (len(cuts) + 1) + place
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def tree_values(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Shapley value of every feature for every row of ``x``."""
    first, cell = _cells(x, tree)
    return _walk(x[first], tree)[cell]


def _walk(x: np.ndarray, tree: Tree) -> np.ndarray:
    phi = np.zeros_like(x)

    def walk(node: int, path: dict[int, tuple[float, np.ndarray]], poly: np.ndarray) -> None:
        if tree.left[node] < 0:
            m = len(path)
            share = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
            for f, (cover, met) in path.items():
                phi[:, f] += tree.value[node] * (met - cover) * (_unwind(poly, cover, met) @ share)
            return
        f = int(tree.feature[node])
        goes_left = x[:, f] <= tree.threshold[node]
        for child, way in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            cover, met, rest = tree.cover[child] / tree.cover[node], way, poly
            if f in path:
                rest = _unwind(poly, *path[f])
                cover, met = cover * path[f][0], way & path[f][1]
            walk(int(child), {**path, f: (cover, met)}, _extend(rest, cover, met))

    walk(0, {}, np.ones((len(x), 1)))
    return phi


def tree_contributions(model: Model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``contributions`` (var, value, contrib) and ``bias``; with the bias they sum to the log-odds."""
    spark, names = df.sparkSession, list(cols)
    trees = read_trees(model, spark)
    bias = sum(t.expected() for t in trees)
    shared = spark.sparkContext.broadcast(trees)  # bounded by the model

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            yield pdf.assign(_phi=list(sum((tree_values(x, t) for t in shared.value), np.zeros_like(x))))

    schema = StructType([*df.schema.fields, StructField("_phi", ArrayType(DoubleType()))])
    out = df.mapInPandas(explain, schema)
    parts = [
        F.struct(
            F.lit(c).alias("var"), F.col(c).cast("double").alias("value"), F.get("_phi", F.lit(i)).alias("contrib")
        )
        for i, c in enumerate(names)
    ]
    return out.withColumn("contributions", F.array(*parts)).withColumn("bias", F.lit(float(bias))).drop("_phi")
