"""Analytics over the experiment run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import ratio
from casemill.operators.ranks import prefix_sums


def valid_runs(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error").isNull() | (F.col("error") == ""))


def run_table(log: DataFrame, by: Sequence[str] = ("model", "mode")) -> DataFrame:
    """Mean and sample deviation of both recalls, losses, reliable runs, mean time."""

    def dev(c: str):
        return F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd")

    return log.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("recall_detector").alias("recall_detector_mean"),
        dev("recall_detector"),
        F.avg("recall_system").alias("recall_system_mean"),
        dev("recall_system"),
        F.sum("n_destroyed").alias("n_destroyed"),
        F.count_if("reliable").alias("n_reliable"),
        F.avg("seconds").alias("seconds_mean"),
    )


def wrong_discards(log: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Reviewed runs with at least one wrong discard, and positives lost in total."""
    return log.filter(F.col("mode") == K.MODE_REVIEW).groupBy(*by).agg(
        F.count_if(F.col("n_destroyed") > 0).alias("runs_with_loss"),
        F.count("*").alias("n_runs"),
        F.sum("n_destroyed").alias("positives_lost"),
    ).withColumn("share", ratio(F.col("runs_with_loss"), F.col("n_runs")))


def mode_pairs(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both modes of the same run side by side; incomplete pairs are dropped."""
    wide = log.groupBy(*keys).pivot("mode", [K.MODE_INTERPRET, K.MODE_REVIEW]).agg(F.max("recall_system"))
    a, b = F.col(K.MODE_INTERPRET), F.col(K.MODE_REVIEW)
    return wide.filter(a.isNotNull() & b.isNotNull()).withColumn("diff", b - a)


def reproducibility(log: DataFrame, by: str, batch: Sequence[str], value: str = "recall_system") -> DataFrame:
    """Per model: batches whose repetitions disagree, and the widest range."""
    ranges = log.filter(F.col("mode") == K.MODE_REVIEW).groupBy(by, *batch).agg(
        (F.max(value) - F.min(value)).alias("_range")
    )
    return ranges.groupBy(by).agg(
        F.count("*").alias("n_batches"),
        F.count_if(F.col("_range") > 0).alias("n_unstable"),
        F.max("_range").alias("worst_range"),
    ).withColumn("unstable_share", ratio(F.col("n_unstable"), F.col("n_batches")))


def reliable_rate(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(
        F.count_if("reliable").alias("n_reliable"), F.count("*").alias("n_runs")
    ).withColumn("rate", ratio(F.col("n_reliable"), F.col("n_runs")))


def cost_dispersion(log: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Upper median (the middle value, never interpolated), extremes and their ratio."""
    by = list(by)
    counts = log.groupBy(*by, value).agg(F.count("*").alias("n"))
    run = prefix_sums(counts, value, ["n"], by)
    totals = log.groupBy(*by).agg(F.count("*").alias("_n"), F.min(value).alias("low"), F.max(value).alias("high"))
    middle = F.floor(F.col("_n") / 2)
    at = middle.between(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)
    return run.join(totals, by).filter(at).select(
        *by, F.col(value).alias("upper_median"), "low", "high",
        (F.col("high") / F.greatest(F.col("low"), F.lit(1.0))).alias("dispersion"),
    )


def cost_per_case(
    log: DataFrame, by: str, seconds: str, cases: str, prior: Mapping[str, float], default: float = 5.0
) -> DataFrame:
    """Measured seconds per case, their extrapolation to the whole file, and the prior estimate."""
    per_case = F.col(seconds) / F.greatest(F.col(cases), F.lit(1))
    agg = log.withColumn("_s", per_case).groupBy(by).agg(
        F.avg("_s").alias("mean_seconds"),
        F.min("_s").alias("min_seconds"),
        F.max("_s").alias("max_seconds"),
        F.sum(seconds).alias("total_seconds"),
        F.sum(cases).alias("n_cases"),
    )
    known = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv]) if prior else None
    expected = F.coalesce(F.try_element_at(known, F.col(by)), F.lit(default)) if prior else F.lit(default)
    return agg.withColumns(
        {
            "extrapolated": F.col("mean_seconds") * F.col("n_cases"),
            "prior_seconds": expected * F.col("n_cases"),
        }
    )


def level_ablation(log: DataFrame, batch: Sequence[str], full: str = "completo") -> DataFrame:
    """Discards per information level, relative to the full level, and their quality."""
    rev = log.filter(F.col("mode") == K.MODE_REVIEW)
    per = rev.groupBy("level").agg(
        F.avg("n_discarded").alias("mean_discards"),
        F.try_divide(F.sum("n_right_discards"), F.sum("n_discarded")).alias("right_share"),
    )
    same = (
        rev.groupBy("level", *batch)
        .agg(F.min("n_discarded").alias("_a"), F.max("n_discarded").alias("_b"))
        .groupBy("level")
        .agg(F.count_if(F.col("_a") == F.col("_b")).alias("n_identical"), F.count("*").alias("n_batches"))
    )
    base = per.filter(F.col("level") == full).select("mean_discards").scalar()
    return per.join(same, "level").withColumn(
        "volume_pct", F.lit(100.0) * F.try_divide(F.col("mean_discards"), base)
    )


def timeout_suspected(seconds_per_task, outputs):
    """Close to the agent limit, or some output too short to be an answer."""
    from casemill.functions.text import is_short

    return (seconds_per_task > K.AGENT_LIMIT_SECONDS * 0.9) | F.exists(outputs, lambda o: is_short(o))


def experiment_grid(spark, models: Sequence[str], modes: Sequence[str], seeds: Sequence[int], repetitions: int) -> DataFrame:
    """Every planned run, as a table to be joined with the outputs."""
    plan = spark.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    )
    plan = plan.select("model", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    plan = plan.select("*", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    return plan.select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
