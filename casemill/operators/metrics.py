"""Detector metrics over globally ordered scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import ratio_or_zero
from casemill.operators.ranks import prefix_sums, quantile_bounds


def score_steps(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, best first, with running positives and rows."""
    bounds = quantile_bounds(df, score)
    steps = df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")
    )
    return prefix_sums(steps, score, ["pos", "n"], by, descending=True, bounds=bounds)


def curve_areas(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum) and ROC area (ties count one half)."""
    pos, n = F.col("pos"), F.col("n")
    neg = n - pos
    cum_neg = F.col("cum_n") - F.col("cum_pos")
    areas = score_steps(df, score, label, by).groupBy(*by).agg(
        F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))).alias("_ap"),
        # Negatives ranked above each positive, half for those at its own score.
        F.sum(pos.cast("double") * (cum_neg - neg / 2)).alias("_above"),
        F.sum(pos).alias("n_pos"),
        F.sum(neg).alias("n_neg"),
    )
    p, m = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return areas.select(
        *by,
        F.try_divide(F.col("_ap"), p).alias("auc_pr"),
        (1 - F.try_divide(F.col("_above"), p * m)).alias("roc_auc"),
        "n_pos",
        "n_neg",
    )


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    total = df.agg(F.sum(label).cast("double")).scalar()
    return score_steps(df, score, label).select(
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), total).alias("recall"),
    )


def confusion(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.avg(label).alias("prevalence"),
        F.count("*").alias("n_rows"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "*",
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def head_ranks(df: DataFrame, score: str, row_id: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best rows (of each group), with their rank."""
    if not by:
        df = df.orderBy(F.desc(score), row_id).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc(score), row_id)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def precision_at(
    df: DataFrame,
    score: str,
    label: str,
    row_id: str,
    ns: Sequence[int] = K.TOP_N,
    by: Sequence[str] = (),
    divide_by_n: bool = False,
) -> DataFrame:
    """Hits and precision in the first N rows; N is capped at the rows there are."""
    head = head_ranks(df, score, row_id, max(ns), by)
    rank = F.col("rank")
    sums = head.groupBy(*by).agg(
        *[F.sum(F.when(rank <= n, F.col(label)).otherwise(0)).alias(f"hits_{n}") for n in ns],
        *[F.count_if(rank <= n).alias(f"_seen_{n}") for n in ns],
    )

    def share(n) -> Column:
        seen = F.lit(n) if divide_by_n else F.col(f"_seen_{n}")
        return ratio_or_zero(F.col(f"hits_{n}"), seen).alias(f"precision_{n}")

    return sums.select(*by, *[f"hits_{n}" for n in ns], *[share(n) for n in ns])


def metric_block(
    df: DataFrame,
    score: str,
    label: str,
    row_id: str,
    threshold: float = 0.5,
    by: Sequence[str] = (),
    ns: Sequence[int] = K.TOP_N,
) -> DataFrame:
    """The full block per group: areas, confusion, precision@N."""
    if not by:
        one = metric_block(df.withColumn("_g", F.lit(0)), score, label, row_id, threshold, ["_g"], ns)
        return one.drop("_g")
    parts = [
        curve_areas(df, score, label, by).drop("n_pos", "n_neg"),
        confusion(df, score, label, threshold, by),
        precision_at(df, score, label, row_id, ns, by),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by))
    return out


def precision_curve(df: DataFrame, score: str, label: str, row_id: str, n: int = 400) -> DataFrame:
    """Cumulative hits, precision and recall at every N up to ``n``."""
    head = head_ranks(df, score, row_id, n)
    total = df.agg(F.sum(label).cast("double")).scalar()
    run = F.sum(label).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("hits", run).select(
        "rank",
        "hits",
        (F.col("hits") / F.col("rank")).alias("precision"),
        F.try_divide(F.col("hits").cast("double"), total).alias("recall"),
    )
