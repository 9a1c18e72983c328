"""Isolation forest: small samples grow trees in parallel, the forest scores partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from casemill import constants as K
from casemill.functions.hashing import hash32
from casemill.operators.profile import minmax_by_batch
from casemill.operators.ranks import before, order_statistics
from casemill.session import durable

_NODE = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth); leaves have feature -1."""
    nodes: list[tuple] = [()]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        at, rows, depth = stack.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + average_path(len(rows)))
            continue
        f = int(rng.choice(usable))
        lo, hi = x[rows, f].min(), x[rows, f].max()
        t = float(rng.uniform(lo, hi))
        mask = x[rows, f] <= t
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (f, t, left, right, 0.0)
        stack += [(left, rows[mask], depth + 1), (right, rows[~mask], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    trees: list[tuple[np.ndarray, ...]]
    cols: list[str]
    scale: dict[str, tuple[float, float]]
    sample: int

    def score(self, df: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
        """Add ``score_anomalia`` in 0..1, min-max over the batch being scored."""
        if not batch:
            # Scored once; the two extremes are numbers, so no key gathers the whole table.
            raw = durable(self.raw(df))
            lo, hi = raw.agg(F.min("_raw"), F.max("_raw")).first()
            span = (hi - lo) if lo is not None and hi > lo else None
            scaled = (F.col("_raw") - F.lit(lo)) / F.lit(span) if span else F.lit(0.0)
            return raw.withColumn("score_anomalia", scaled).drop("_raw")
        return minmax_by_batch(self.raw(df), "_raw", batch, "score_anomalia").drop("_raw")

    def raw(self, df: DataFrame) -> DataFrame:
        """Add ``_raw``, higher for rows that isolate early."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        centre = np.array([self.scale[c][0] for c in self.cols])
        width = np.array([self.scale[c][1] for c in self.cols])
        cols, norm = self.cols, average_path(self.sample)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = (pdf[cols].to_numpy(dtype=float) - centre) / width
                rows = np.arange(len(x))
                total = np.zeros(len(x))
                for feature, threshold, left, right, depth in shared.value:
                    at = np.zeros(len(x), dtype=int)
                    while True:
                        inner = feature[at] >= 0
                        if not inner.any():
                            break
                        goes = x[rows, feature[at]] <= threshold[at]
                        at = np.where(inner, np.where(goes, left[at], right[at]), at)
                    total += depth[at]
                mean = total / max(len(shared.value), 1)
                yield pdf.assign(_raw=2.0 ** (-mean / max(norm, 1e-12)))

        return df.mapInPandas(run, StructType([*df.schema.fields, StructField("_raw", DoubleType())]))


def population_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; one row of numbers."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    return {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in cols}


def fit_isolation_forest(
    df: DataFrame, cols: Sequence[str], row_id: str, n_trees: int = 200, sample: int = 256, seed: int = K.SEED
) -> IsolationForest:
    """Grow ``n_trees`` trees on samples of at most ``sample`` rows, without labels.

    The pool is the first n_trees * sample rows in hash order, or all of a smaller table.
    Every tree takes the ``sample`` pool rows that come first in a hash order of its own.
    """
    cols = list(cols)
    scale = population_scale(df, cols)
    scaled = [((F.col(c) - scale[c][0]) / scale[c][1]).cast("double").alias(c) for c in cols]
    keyed = df.select(row_id, *scaled).withColumn("_h", hash32(seed, F.col(row_id)))
    n, want = df.count(), n_trees * sample
    # A hash cut keeps exactly the pool; no task gathers candidates from all partitions.
    cut = order_statistics(keyed, ["_h", row_id], [(None, want)])[0] if n > want else None
    pool = keyed if cut is None else keyed.filter(before(["_h", row_id], cut))
    every = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    order = hash32(seed, F.col("tree"), F.col(row_id))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(order, row_id))
    dealt = every.withColumn("_r", rank).filter(F.col("_r") <= sample)
    limit = max(ceil(log2(max(sample, 2))), 1)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = pdf.sort_values(row_id)[cols].to_numpy(dtype=float)
        nodes = grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    table = dealt.groupBy("tree").applyInPandas(build, _NODE).toPandas().sort_values(["tree", "node"])
    trees = [
        tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
        for _, g in table.groupby("tree")
    ]
    return IsolationForest(trees, cols, scale, min(sample, n))
