"""Batch summaries and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators.ranks import prefix_sums, quantile_bounds


def batch_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, tier counts, score range, total amount and amount at risk."""
    tier = F.col("tier")
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(tier == K.TIER_HIGH).alias("n_high"),
        F.count_if(tier == K.TIER_MEDIUM).alias("n_medium"),
        F.count_if(tier == K.TIER_LOW).alias("n_low"),
        F.max("prob").alias("prob_max"),
        F.avg("prob").alias("prob_mean"),
        F.sum("amount").alias("amount_total"),
        F.sum(F.when(tier != K.TIER_LOW, F.col("amount")).otherwise(0.0)).alias("amount_at_risk"),
    )


def batch_statistics(scored: DataFrame, level: str | Sequence[str] = "completo", by: Sequence[str] = ()) -> DataFrame:
    """The statistics view; tier counts and scores are null where the level hides them.

    Several levels are several rows made of one aggregation.
    """
    levels = [level] if isinstance(level, str) else list(level)
    if not set(levels) <= set(K.LEVELS):
        raise ValueError(f"level must be one of {K.LEVELS}")
    s = scored.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("tier") == K.TIER_HIGH).alias("n_high"),
        F.count_if(F.col("tier") == K.TIER_MEDIUM).alias("n_medium"),
        F.count_if(F.col("tier") == K.TIER_LOW).alias("n_low"),
        F.max("prob").alias("prob_max"),
        F.avg("prob").alias("prob_mean"),
        F.sum("amount").alias("amount_total"),
        F.avg("amount").alias("amount_mean"),
        F.min("hour").alias("hour_min"),
        F.max("hour").alias("hour_max"),
    )
    shown = s.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    tiers = {c: F.when(F.col("level") == "completo", F.col(c)) for c in ("n_high", "n_medium", "n_low")}
    scores = {c: F.when(F.col("level") != "ciego", F.col(c)) for c in ("prob_max", "prob_mean")}
    return shown.withColumns(tiers | scores)


def share_at_or_below(df: DataFrame, by: str, amount: str, limits: Sequence[float] = (1, 2, 5, 10)) -> DataFrame:
    """Share of each class at or below each limit; limits are columns until the end."""
    a = F.col(amount)
    wide = df.groupBy(by).agg(*[F.avg((a <= u).cast("double")).alias(f"s{i}") for i, u in enumerate(limits)])
    rows = [F.struct(F.lit(float(u)).alias("up_to"), F.col(f"s{i}").alias("share")) for i, u in enumerate(limits)]
    return wide.select(by, F.inline(F.array(*rows)))


def positive_ecdf(df: DataFrame, by: str, amount: str) -> DataFrame:
    """Cumulative share over positive amounts; the denominator is the whole class."""
    positive = df.filter(F.col(amount) > 0)
    bounds = quantile_bounds(positive, amount)
    counts = positive.groupBy(by, amount).agg(F.count("*").alias("n"))
    totals = df.groupBy(by).agg(F.count("*").alias("_n"))
    run = prefix_sums(counts, amount, ["n"], [by], bounds=bounds)
    return run.join(totals, by).select(by, amount, (F.col("cum_n") / F.col("_n")).alias("ecdf"))


def distinct_counts(
    df: DataFrame, cols: Sequence[str], time: str, approximate: bool = False
) -> DataFrame:
    """Distinct values per column and the period covered."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        *[count(F.col(c)).alias(f"n_{c}") for c in cols], F.min(time).alias("first"), F.max(time).alias("last")
    )


def distinct_sketches(df: DataFrame, period: Column, cols: Sequence[str], lg_size: int = 14) -> DataFrame:
    """(period, n_rows, and per column the HLL sketch of its values): kept, they answer any range of periods."""
    return df.groupBy(period.alias("period")).agg(
        F.count("*").alias("n_rows"), *[F.hll_sketch_agg(F.col(c), F.lit(lg_size)).alias(f"hll_{c}") for c in cols]
    )


def distinct_between(sketches: DataFrame, ranges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column over each range (columns first, last) of periods, from the sketches alone.

    Sketches are merged, so a value that occurs in several periods counts once.  The standard error
    is 1.04 / sqrt(2 ** lg_size): 0.8 % at the default size.
    """
    met = ranges.join(sketches, F.col("period").between(F.col("first"), F.col("last")))
    return met.groupBy(*ranges.columns).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(F.col(f"hll_{c}"))).alias(f"n_{c}") for c in cols],
    )
