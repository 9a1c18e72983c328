"""Profiles, scaling, encoding and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators.ranks import order_statistics, prefix_sums, quantile_bounds


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles from the two order statistics around each."""
    if not probs:
        return []
    spots = [lambda n, p=p: floor(p * (n - 1)) for p in probs] + [lambda n, p=p: min(floor(p * (n - 1)) + 1, n - 1) for p in probs]
    # The number of rows comes with the sketch; the last rank tells it back.
    sizes: list[int] = []
    spots.append(lambda n: sizes.append(n) or 0)
    found = [v[0] for v in order_statistics(df, [col], [(None, r) for r in spots])]
    shares = [p * (sizes[-1] - 1) % 1 for p in probs]
    return [lo + f * (hi - lo) for lo, hi, f in zip(found, found[len(probs) :], shares)]


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact interpolated quantiles per group, from running counts of distinct values."""
    by = list(by)
    bounds = quantile_bounds(df, col)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
    run = prefix_sums(counts, col, ["n"], by, bounds=bounds)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_n"))
    ranked = run.join(totals, by) if by else run.withColumn("_n", totals.select("_n").scalar())
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    picks: list[Column] = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.floor(spot)
        hi = F.least(lo + 1, F.col("_n") - 1)
        picks += [
            F.max(F.when(lo.between(first, last), F.col(col))).alias(f"_lo{i}"),
            F.max(F.when(hi.between(first, last), F.col(col))).alias(f"_hi{i}"),
            F.max(spot - lo).alias(f"_f{i}"),
        ]
    out = ranked.groupBy(*by).agg(*picks)
    return out.select(
        *by,
        *[
            (F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name)
            for i, name in enumerate(names)
        ],
    )


def dataset_profile(
    df: DataFrame,
    label: str,
    amount: str,
    watched: Sequence[str],
    rows: int = K.EXPECTED_ROWS,
    positives: int = K.EXPECTED_POSITIVES,
) -> DataFrame:
    """Rows, positives, nulls, amount range and whether the expectation holds."""
    median = exact_quantiles(df, amount, [0.5])[0]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in watched), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(label).alias("positives"),
        F.round(F.avg(label), 9).alias("positive_share"),
        nulls.cast("long").alias("nulls"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
    ).select(
        "*",
        F.round(F.lit(float(median)), 9).alias("median_amount"),
        ((F.col("n_rows") == rows) & (F.col("positives") == positives)).alias("as_expected"),
    )


def standardise(fit_rows: DataFrame, rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, constants left centred; fitted on ``fit_rows``."""
    stats = fit_rows.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
        )
    ).scalar()
    out = rows.withColumn("_stats", stats)
    for c in cols:
        dev = F.col(f"_stats.s_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_stats.m_{c}")) / F.when(dev > 0, dev).otherwise(1.0))
    return out.drop("_stats")


def minmax_by_batch(df: DataFrame, col: str, batch: Sequence[str], out: str) -> DataFrame:
    """Min-max over the batch being scored; 0 where the batch is constant.

    The extremes are aggregated map-side and joined back, so a batch that holds most
    of the rows never gathers in one task.
    """
    batch = list(batch)
    ends = df.groupBy(*batch).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(ends, batch).withColumn(
        out, F.when(span > 0, (F.col(col) - F.col("_lo")) / span).otherwise(0.0)
    ).drop("_lo", "_hi")


def one_hot(fit_rows: DataFrame, rows: DataFrame, col: str, out: str) -> DataFrame:
    """One-hot with sorted categories known to ``fit_rows``; unknown values are all zeros."""
    idx = f"_{col}_idx"
    stages = [
        StringIndexer(
            inputCol=col, outputCol=idx, stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        # The slot of unknown values is the last one, and it is the one dropped.
        OneHotEncoder(inputCol=idx, outputCol=out, dropLast=True),
    ]
    return Pipeline(stages=stages).fit(fit_rows).transform(rows).drop(idx)


def vector_array(col: str) -> Column:
    return vector_to_array(F.col(col))


def feature_group_totals(rows: DataFrame, row_id: str) -> DataFrame:
    """Each row under each feature group: how many columns it keeps and their sum."""
    groups = [
        F.struct(
            F.lit(name).alias("grp"),
            F.lit(len(cols)).alias("n_features"),
            sum((F.col(c) for c in cols), F.lit(0.0)).alias("total"),
        )
        for name, cols in K.FEATURE_GROUPS.items()
    ]
    return rows.select(row_id, F.inline(F.array(*groups)))


def versus_mean(df: DataFrame, col: str) -> DataFrame:
    mean = df.agg(F.avg(col)).scalar()
    return df.withColumn("side", F.when(F.col(col) > mean, "por encima").otherwise("por debajo"))


def quantile_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Score quantile at one minus the positive share."""
    share = df.agg(F.avg(label)).first()[0]
    value = exact_quantiles(df, score, [1.0 - share])[0]
    return df.agg(F.count("*").alias("n_rows")).withColumn("threshold", F.lit(float(value)))


def head_equivalence(precisions: DataFrame, by: str, pair: tuple[str, str], ns: Sequence[int]) -> DataFrame:
    """Largest precision@N gap between two models, and whether it is within 0.02."""
    first, second = pair

    def at(model: str, n: int) -> Column:
        return F.max(F.when(F.col(by) == model, F.col(f"precision_{n}")))

    gaps = [F.abs(at(first, n) - at(second, n)) for n in ns]
    gap = F.round(F.greatest(*gaps), 6)
    return precisions.agg(gap.alias("gap")).withColumn("equivalent", F.col("gap") <= 0.02)
