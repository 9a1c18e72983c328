"""Supervised detectors on MLlib, hyper-parameter search and ablations."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from math import ceil
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import risk_tier
from casemill.operators import boosting, metrics
from casemill.operators.splits import class_counts
from casemill.session import durable, ensure_checkpoints

#: Rows from which a training table is merged to cells, and rows per task of a fit, whose passes are short.
CELL_ROWS = 1 << 17
TASK_ROWS = 32_768
#: Values (rows or cells times features) up to which a boosted fit is one task; MLlib fits larger tables.
IN_TASK = 1 << 22
_BINS = 32  # MLlib's number of bins
_MARKS = 400  # quantiles read per class and feature

def _features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def _weighted(df: DataFrame, label: str, positive: float, negative: float = 1.0) -> DataFrame:
    """Weight of a row or cell: that of its class, times the rows it stands for."""
    weight = F.when(F.col(label) == 1, float(positive)).otherwise(float(negative))
    return df.withColumn("_weight", weight * F.col("_rows"))


def _class_rows(train: DataFrame, label: str) -> dict:
    """Rows per class; a cell counts for the rows it holds."""
    if "_rows" not in train.columns:
        return class_counts(train, label)
    return {r[label]: r["n"] for r in train.groupBy(label).agg(F.sum("_rows").alias("n")).collect()}


def positive_weight(train: DataFrame, label: str) -> float:
    n = _class_rows(train, label)
    return n.get(0, 0) / max(n.get(1, 0), 1)


def _bin_values(rows: DataFrame, cols: Sequence[str], label: str) -> list[list[float]]:
    """At most 32 values per feature: the ends, and quantiles of each class over all its rows."""
    marks = [i / _MARKS for i in range(_MARKS + 1)]
    per_class = rows.groupBy(label).agg(
        *[F.percentile_approx(c, marks, 2_000).alias(f"q{j}") for j, c in enumerate(cols)],
        *[F.struct(F.min(c), F.max(c)).alias(f"e{j}") for j, c in enumerate(cols)],
    ).limit(_BINS).collect()
    out = []
    for j in range(len(cols)):
        lists = [r[f"q{j}"] for r in per_class if r[f"q{j}"]]
        values = {v for r in per_class for v in r[f"e{j}"] if v is not None}.union(*lists)
        values = {v for v in values if v == v}
        if len(values) > _BINS:
            ends, each = {min(values), max(values)}, (_BINS - 2) // len(lists)
            values = ends | {q[(2 * i + 1) * _MARKS // (2 * each)] for q in lists for i in range(each)}
        out.append(sorted(v for v in values if v == v))
    return out


def _nearest(name: str, values: list[float]) -> Column:
    """The nearest of ``values``; a value half-way takes the lower one, as MLlib's thresholds do."""
    x = F.col(name)

    def among(a: int, b: int) -> Column:
        if a == b:
            return F.lit(values[a])
        half = (a + b) // 2
        return F.when(x <= (values[half] + values[half + 1]) / 2, among(a, half)).otherwise(among(half + 1, b))

    # Nulls and NaN stay, errors of the assembler as without bins.
    return (F.when(x.isNull() | F.isnan(x), x).otherwise(among(0, len(values) - 1)) if values else x).alias(name)


def training_cells(
    train: DataFrame, cols: Sequence[str], label: str, cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Training rows with the number of rows each stands for, ``_rows``, spread over the cores.

    MLlib sees a feature only by its bin, 32 a feature, so beyond ``cell_rows`` rows all rows of the
    same bins and class are one cell with their number as its weight.  A feature becomes the nearest of
    32 values, half-way between which MLlib puts its thresholds, so the model reads unbinned rows.  Large cells
    come in equal parts of at most ``n / cell_rows`` rows, which the draws of a tree take or leave.
    """
    if "_rows" in train.columns:
        return train
    spark = train.sparkSession
    doubles = train.select(label, *[F.col(c).cast("double").alias(c) for c in cols])
    n = train.count()
    if n > cell_rows:
        values = _bin_values(doubles, cols, label)
        most = ceil(n / cell_rows)
        cells = doubles.select(label, *[_nearest(c, v) for c, v in zip(cols, values, strict=True)])
        cells = cells.groupBy(label, *cols).agg(F.count("*").alias("_n"))
        cells = cells.withColumn("_parts", F.ceil(F.col("_n") / most))
        one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts")))
        rows = cells.withColumn("_part", one).select(label, *cols, (F.col("_n") / F.col("_parts")).alias("_rows"))
        rows = durable(rows)
        n = rows.count()
    else:
        rows = doubles.withColumn("_rows", F.lit(1.0))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, ceil(n / task_rows)))
    return durable(rows.repartition(tasks))


def train_boosted(
    train: DataFrame,
    cols: Sequence[str] = K.FEATURE_COLS,
    label: str = "Class",
    n_estimators: int = 400,
    max_depth: int = 5,
    learning_rate: float = 0.1,
    subsample: float = 0.8,
    colsample: float = 0.8,
    min_child_weight: int = 1,
    gamma: float = 0.0,
    pos_weight: float | None = None,
    seed: int = K.SEED,
) -> Model:
    """Boosted trees with the positive class weighted neg/pos unless told otherwise.

    ``colsample`` is the published share of columns per tree; MLlib subsamples them per node.
    ``min_child_weight`` and ``gamma`` become the least rows of a node and the least gain of a split,
    which is what MLlib offers: rows are counted, not their weights, and the gain is that of its impurity.
    Large tables are merged to cells.  Up to ``IN_TASK`` values the fit is one task by MLlib's rules (``boosting``),
    beyond it MLlib's own, over unmerged rows where a node's rows are counted.
    """
    ensure_checkpoints(train.sparkSession)
    rows = training_cells(train, cols, label, CELL_ROWS)
    ratio = positive_weight(rows, label) if pos_weight is None else pos_weight
    gbt = _estimator(label, n_estimators, max_depth, learning_rate, subsample, colsample, min_child_weight, gamma, seed)
    if _fits_task(rows, cols):
        return boosting.fit(rows, cols, label, gbt, ratio)
    if min_child_weight > 1:
        rows = training_cells(train, cols, label, sys.maxsize)
    return gbt.fit(_features(_weighted(rows, label, ratio), cols))


def _fits_task(rows: DataFrame, cols: Sequence[str]) -> bool:
    return rows.count() * len(cols) <= IN_TASK


def _estimator(
    label: str,
    n_estimators: int = 400,
    max_depth: int = 5,
    learning_rate: float = 0.1,
    subsample: float = 0.8,
    colsample: float = 0.8,
    min_child_weight: int = 1,
    gamma: float = 0.0,
    seed: int = K.SEED,
) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label,
        weightCol="_weight",
        maxIter=n_estimators,
        maxDepth=max_depth,
        stepSize=learning_rate,
        subsamplingRate=subsample,
        featureSubsetStrategy="all" if colsample >= 1.0 else str(colsample),
        minInstancesPerNode=max(int(min_child_weight), 1),
        minInfoGain=float(gamma),
        checkpointInterval=10,
        seed=seed,
    )


def train_forest(
    train: DataFrame,
    cols: Sequence[str] = K.FEATURE_COLS,
    label: str = "Class",
    n_estimators: int = 400,
    max_depth: int = 30,
    seed: int = K.SEED,
) -> Model:
    """Random forest with balanced class weights; MLlib caps the depth at 30.  Large tables are merged to cells."""
    ensure_checkpoints(train.sparkSession)
    rows = training_cells(train, cols, label, task_rows=TASK_ROWS // 8)  # a pass sees every tree
    n = _class_rows(rows, label)
    total = n.get(0, 0) + n.get(1, 0)
    balanced = [total / (2.0 * max(n.get(c, 0), 1)) for c in (0, 1)]
    forest = RandomForestClassifier(
        labelCol=label,
        weightCol="_weight",
        numTrees=n_estimators,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return forest.fit(_features(_weighted(rows, label, balanced[1], balanced[0]), cols))


def score(model: Model, df: DataFrame, cols: Sequence[str] = K.FEATURE_COLS) -> DataFrame:
    """Add ``prob`` and ``tier``."""
    out = model.transform(_features(df, cols))
    return (
        out.withColumn("prob", vector_to_array("probability")[1])
        .withColumn("tier", risk_tier(F.col("prob")))
        .drop("features", "rawPrediction", "probability", "prediction")
    )


def evaluate(model: Model, test: DataFrame, cols: Sequence[str], label: str, row_id: str, name: str) -> DataFrame:
    # The block reads its rows several times; they are scored once.
    scored = durable(score(model, test, cols).select(row_id, label, "prob")).withColumn("model", F.lit(name))
    return metrics.metric_block(scored, "prob", label, row_id, by=["model"])


def average_precision(model: Model, test: DataFrame, cols: Sequence[str], label: str) -> float:
    scored = score(model, test, cols).select(label, "prob")
    return metrics.curve_areas(scored, "prob", label).first()["auc_pr"] or 0.0


def draws(space: Mapping[str, Sequence], n: int, seed: int = K.SEED) -> Iterator[dict]:
    """Random combinations, each choice a function of (seed, draw, name)."""
    for i in range(n):
        yield {
            k: v[int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest()[:8], 16) % len(v)]
            for k, v in space.items()
        }


def folds_of(df: DataFrame, k: int, column: str, past_only: bool) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, validation) pairs: the other folds, or only the blocks before."""
    fold = F.col(column)
    for i in range(1, k + 1) if past_only else range(k):
        yield df.filter(fold < i if past_only else fold != i), df.filter(fold == i)


def _fold_arrays(trains: Sequence[DataFrame], helds: Sequence[DataFrame], cols: Sequence[str], label: str) -> list | None:
    """Arrays of the cells to learn and of the rows to judge per fold; None where some are more than a task takes.

    Judged rows between the same cuts have the same score: beside merged cells they are counted per cell.
    """
    if not all(_fits_task(t, cols) for t in trains):
        return None
    out = []
    for train, held in zip(trains, helds, strict=True):
        learnt = boosting.arrays(train.toArrow(), cols, label, "_rows")
        values = [np.unique(c[~np.isnan(c)]).tolist() for c in learnt[0].T]
        doubles = held.select(label, *[F.col(c).cast("double").alias(c) for c in cols])
        seen = [_nearest(c, v) if len(v) <= _BINS else F.col(c) for c, v in zip(cols, values, strict=True)]
        counted = durable(doubles.select(label, *seen).groupBy(label, *cols).agg(F.count("*").alias("_rows")))
        if not _fits_task(counted, cols):
            return None
        out.append((learnt, boosting.arrays(counted.toArrow(), cols, label, "_rows")))
    return out


def _fits_in_tasks(spark: SparkSession, folds: list, wanted: Sequence[tuple[dict, int]], label: str, n_features: int) -> list[float]:
    """Average precision of each (parameters, fold), a task each, the longest first."""
    fits = []
    for params, i in wanted:
        size = boosting.Size.of(_estimator(label, **{k: v for k, v in params.items() if k != "pos_weight"}), n_features)
        fits.append((i, size, params["pos_weight"]))
    order = sorted(range(len(fits)), key=lambda j: -fits[j][1].trees * fits[j][1].depth)
    shared = spark.sparkContext.broadcast(folds)  # of at most IN_TASK values a side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                i, size, positive = fits[order[place]]
                area = boosting.search_fit(*shared.value[i], size, positive)
                yield pa.RecordBatch.from_pydict({"fit": pa.array([order[place]], pa.int32()), "area": [area]})

    found = spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, "fit int, area double").collect()
    shared.unpersist()
    areas = {r["fit"]: r["area"] for r in found}
    return [areas[j] for j in range(len(fits))]


def random_search(
    train: DataFrame,
    test: DataFrame,
    folded: DataFrame,
    fold_col: str,
    k: int,
    past_only: bool,
    cols: Sequence[str] = K.FEATURE_COLS,
    label: str = "Class",
    space: Mapping[str, Sequence] = K.SEARCH_SPACE,
    base: Mapping = K.SEARCH_BASE,
    n_draws: int = 50,
    seed: int = K.SEED,
    parallelism: int = 4,
) -> dict:
    """Search on training data only, refit the best draw, compare on the held-out test.

    The fold table is written once and merged to cells once per fold; every (draw, fold) is a fit of its own under
    either scheme of folds.  Where the cells of each fold fit a task, a fit and its area are one task of one job;
    else ``parallelism`` fits run side by side.  Equal means go to the earlier draw.
    ``train`` may come as its cells where these fit a task or no draw counts the rows of a node.
    """
    ratio = positive_weight(train, label)
    full = {**space, "pos_weight": [1.0, round(ratio**0.5, 1), round(ratio, 1)]}
    kept = durable(folded.select(fold_col, label, *cols))
    sides = list(folds_of(kept, k, fold_col, past_only))

    merged = [(training_cells(side, cols, label, CELL_ROWS), side) for side in (*(s[0] for s in sides), train)]

    def learn(rows: tuple[DataFrame, DataFrame], params: Mapping) -> Model:
        by_rows = params.get("min_child_weight", 1) > 1 and not _fits_task(rows[0], cols)
        return train_boosted(rows[by_rows], cols, label, **params)

    def fit(params: dict, i: int) -> float:
        return average_precision(learn(merged[i], params), sides[i][1], cols, label)

    drawn = list(draws(full, n_draws, seed))
    wanted = [(params, i) for params in drawn for i in range(len(sides))]
    local = _fold_arrays([m[0] for m in merged[:-1]], [s[1] for s in sides], cols, label)
    if local is not None:
        values = _fits_in_tasks(train.sparkSession, local, wanted, label, len(cols))
    else:
        with ThreadPool(parallelism) as pool:
            values = pool.starmap(fit, wanted)
    tried = [(sum(values[i * len(sides) : (i + 1) * len(sides)]) / len(sides), params) for i, params in enumerate(drawn)]
    best_cv, best = max(tried, key=lambda t: t[0])
    reference = average_precision(learn(merged[-1], base), test, cols, label)
    tuned = average_precision(learn(merged[-1], best), test, cols, label)
    gain = tuned - reference
    return {
        "best": best,
        "auc_pr_cv": best_cv,
        "auc_pr_reference": reference,
        "auc_pr_tuned": tuned,
        "gain": gain,
        "reading": "improves" if gain > 0.01 else "improves marginally" if gain > 0 else "does not improve",
        "n_draws": len(tried),
    }


def group_ablation(
    train: DataFrame, test: DataFrame, label: str, row_id: str, groups: Mapping[str, Sequence[str]] = K.FEATURE_GROUPS, **params
) -> DataFrame:
    """Retrain per feature group; difference to the full group and its reading."""
    blocks = [
        evaluate(train_boosted(train, cols, label, **params), test, cols, label, row_id, name).withColumn(
            "n_features", F.lit(len(cols))
        )
        for name, cols in groups.items()
    ]
    return ablation_deltas(reduce(DataFrame.unionByName, blocks), "model", "full", "auc_pr")


def ablation_deltas(rows: DataFrame, name: str, full: str, value: str) -> DataFrame:
    """Delta of every row to the full one: within the tolerance it adds nothing either way."""
    base = rows.filter(F.col(name) == full).select(value).scalar()
    out = rows.withColumn("delta", F.col(value) - base)
    d, tol = F.col("delta"), K.ABLATION_TOLERANCE
    return out.withColumn(
        "reading", F.when(d > tol, "better without").when(d < -tol, "worse without").otherwise("no difference")
    )
