"""Small-sample tests as closed forms over aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.ranks import prefix_sums

ALPHA = 0.05
EXACT_UP_TO = 50


def fisher_exact(tables: DataFrame, key: Sequence[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Two-sided exact test of each 2x2 table [[a, b], [c, d]].

    The support is exploded and weighted by running sums of log ratios of neighbouring
    probabilities; those not above the observed one (1e-7 slack) are summed.
    """
    key = list(key)
    r1, c1 = F.col(a) + F.col(b), F.col(a) + F.col(c)
    n = r1 + F.col(c) + F.col(d)
    base = tables.select(
        *key, F.col(a).alias("_a"), r1.cast("double").alias("_r"), c1.cast("double").alias("_c"),
        n.cast("double").alias("_n"),
        F.greatest(F.lit(0), c1 - (F.col(c) + F.col(d))).cast("long").alias("_lo"),
        F.least(r1, c1).cast("long").alias("_hi"),
    )
    support = base.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    j = F.col("_k") - 1
    step = F.when(
        F.col("_k") > F.col("_lo"),
        F.log((F.col("_r") - j) * (F.col("_c") - j))
        - F.log((j + 1) * (F.col("_n") - F.col("_r") - F.col("_c") + j + 1)),
    ).otherwise(0.0)
    w = Window.partitionBy(*key)
    run = support.withColumn("_s", step).withColumn("_l", F.sum("_s").over(w.orderBy("_k")))
    seen = run.withColumn("_at", F.max(F.when(F.col("_k") == F.col("_a"), F.col("_l"))).over(w)).withColumn(
        "_top", F.max("_l").over(w)
    )
    weight = F.exp(F.col("_l") - F.col("_top"))
    tail = F.when(F.col("_l") <= F.col("_at") + F.log(F.lit(1 + 1e-7)), weight).otherwise(0.0)
    return (
        seen.groupBy(*key)
        .agg(F.least(F.sum(tail) / F.sum(weight), F.lit(1.0)).alias("p_value"))
        .withColumn("significant", F.col("p_value") < ALPHA)
    )


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative column.

    A power series near zero, a continued fraction in the tail.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * x * x / (2 * n + 1)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * x * x / (2 * n + 1)).alias("sum"),
        ),
        lambda acc: 1.0 - F.lit(2.0 / sqrt(pi)) * F.exp(-x * x) * acc["sum"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1.0 + (k / (2.0 * x * x)) / acc
    )
    tail = F.exp(-x * x) / (x * sqrt(pi) * fraction)
    return F.when(x < 3.0, series).otherwise(tail)


def _exact_tail(n: Column, t: Column) -> Column:
    """P(W <= t) for the signed-rank sum of n untied differences, by counting subsets."""
    size = (n * (n + 1) / 2).cast("int") + 1
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        start,
        lambda acc, i: F.transform(
            acc, lambda v, s: v + F.when(s >= i, F.element_at(acc, F.greatest(s - i, F.lit(0)) + 1)).otherwise(0.0)
        ),
    )
    below = F.aggregate(F.slice(counts, 1, t.cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    return below / F.pow(F.lit(2.0), n)


def wilcoxon(
    pairs: DataFrame, diff: str, by: Sequence[str], tie_round: int | None = None, method: str = "auto"
) -> DataFrame:
    """Paired signed-rank test per group; zeros are dropped, ties take average ranks.

    ``method`` is "exact" (the exact distribution; no p value for groups with zeros or ties,
    which it does not cover), "normal" (the approximation with tie correction) or "auto", the
    published rule: exact without zeros or ties up to ``EXACT_UP_TO`` pairs, else normal.  The
    column ``method`` says which one a group got.  Ties are compared on the raw doubles
    unless ``tie_round`` asks for rounding.  A group of zeros only has no p value.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError("method must be auto, exact or normal")
    by = list(by)
    x = F.col(diff) if tie_round is None else F.round(diff, tie_round)
    rows = pairs.select(*by, x.alias("_d"))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("_d") < 0).alias("n_worse"),
        F.count_if(F.col("_d") == 0).alias("n_zero"),
    )
    groups = rows.filter(F.col("_d") != 0).groupBy(*by, F.abs("_d").alias("_m")).agg(
        F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_up")
    )
    ranked = prefix_sums(groups, "_m", ["_c"], by)
    c = F.col("_c").cast("double")
    rank = F.col("cum__c") - c + (c + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.sum("_c").cast("double").alias("_n"),
        F.sum(F.col("_up") * rank).alias("w_plus"),
        F.sum((F.col("_c") - F.col("_up")) * rank).alias("w_minus"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n, t = F.col("_n"), F.least("w_plus", "w_minus")
    dev = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    z = F.try_divide(t - n * (n + 1) / 4, dev)
    normal = erfc(F.abs(F.col("z")) / sqrt(2.0))
    covered = (F.col("n_zero") == 0) & (F.col("_ties") == 0)
    used = {
        "auto": F.when(covered & (n <= EXACT_UP_TO), "exact").otherwise("normal"), "exact": F.lit("exact"), "normal": F.lit("normal"),
    }[method]
    joined = counts.join(sums, by, "left").withColumn("z", z)
    exact = F.when(covered, F.least(2 * _exact_tail(n, t), F.lit(1.0)))
    p = F.when(used == "exact", exact).otherwise(normal)
    return joined.select(
        *by, "n_pairs", "n_worse", "n_zero", "w_plus", "w_minus", "z",
        F.when(F.col("_n") > 0, p).alias("p_value"), used.alias("method"),
    )


def comparison_reading(row: DataFrame) -> DataFrame:
    """Reading of a bootstrap comparison: columns significant, equivalent, mean_diff."""
    winner = F.when(F.col("mean_diff") > 0, "b").otherwise("a")
    return row.withColumn("winner", winner).withColumn(
        "reading",
        F.when(~F.col("significant"), "no evidence of a difference")
        .when(F.col("equivalent"), "significant but alike at the head of the ranking")
        .when(F.col("winner") == "a", "the chosen model wins at the head too")
        .otherwise("the other model wins at the head: reconsider the choice"),
    )
