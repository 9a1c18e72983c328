"""The continuous regime over a finished table: windows, cost, latency, occupancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators.selection import select_cases_by


def with_window(df: DataFrame, time: str, seconds: float, start: Column | float | None = None) -> DataFrame:
    """Tumbling window number counted from the first timestamp."""
    origin = df.agg(F.min(time)).scalar() if start is None else start
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    return df.withColumn("start", origin).withColumn(
        "window_id", F.floor((F.col(time) - F.col("start")) / float(seconds))
    )


def window_counts(windowed: DataFrame) -> DataFrame:
    """Windows that hold rows, with or without cases."""
    return windowed.groupBy("window_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("label").cast("long")).alias("positives")
    )


def window_cases(windowed: DataFrame, capacity: int = 60, threshold: float = K.HIGH_FROM) -> DataFrame:
    """Cases of every window; a window may have none."""
    return select_cases_by(windowed, ["window_id"], "prob", "tx_id", capacity, threshold, 0)


def review_cost(n_cases: Column) -> Column:
    """Estimated seconds of review; nothing for an empty case file."""
    return F.when(n_cases > 0, (n_cases + K.FIXED_TASKS) * K.SECONDS_PER_TASK).otherwise(0.0)


def window_log(windowed: DataFrame, time: str, seconds: float, capacity: int = 60, threshold: float = K.HIGH_FROM) -> DataFrame:
    """One record per window: counts, cases, cost, status and alert latency in minutes."""
    cases = window_cases(windowed, capacity, threshold)
    end = F.col("start") + (F.col("window_id") + 1) * float(seconds)
    wait = end - F.col(time)
    pos = F.col("label") == 1
    per_case = cases.groupBy("window_id").agg(
        F.count("*").alias("n_cases"),
        F.count_if(pos).alias("positives_raised"),
        F.avg(F.when(pos, wait)).alias("_wait_mean"),
        F.max(F.when(pos, wait)).alias("_wait_max"),
    )
    log = window_counts(windowed).join(per_case, "window_id", "left").na.fill(0, ["n_cases", "positives_raised"])
    cost = review_cost(F.col("n_cases"))
    return log.withColumn("cost_sec", cost).select(
        "window_id", "n_rows", "positives", "n_cases", "positives_raised", "cost_sec",
        F.when(F.col("n_cases") > 0, "ESTIMADO").otherwise("sin casos").alias("status"),
        F.round((F.col("_wait_mean") + F.col("cost_sec")) / 60, 2).alias("latency_mean_min"),
        F.round((F.col("_wait_max") + F.col("cost_sec")) / 60, 2).alias("latency_max_min"),
    )


def occupancy(log: DataFrame, seconds: float) -> DataFrame:
    """Run summary over the window records."""
    return log.agg(
        F.count("*").alias("n_windows"),
        F.count_if(F.col("n_cases") > 0).alias("n_with_cases"),
        F.sum("cost_sec").alias("total_cost_sec"),
        F.count_if(F.col("cost_sec") > float(seconds)).alias("n_overflow"),
        F.avg("latency_mean_min").alias("latency_mean_min"),
        F.max("latency_max_min").alias("latency_max_min"),
    ).withColumn(
        "occupancy",
        F.col("total_cost_sec") / F.greatest(F.col("n_windows") * float(seconds), F.lit(1.0)),
    )


def size_sweep(df: DataFrame, time: str, minutes: Sequence[int]) -> DataFrame:
    """Mean wait until the window closes for several sizes, beside the expected half window.

    Sizes are columns of one aggregation, so rows are not multiplied.
    """
    start = df.agg(F.min(time)).scalar()
    since = df.select((F.col(time) - start).alias("_s"))
    aggs = []
    for m in minutes:
        size = m * 60.0
        window = F.floor(F.col("_s") / size)
        aggs.append(F.avg((window + 1) * size - F.col("_s")).alias(f"w{m}"))
    rows = [
        F.struct(
            F.lit(m).alias("minutes"), (F.col(f"w{m}") / 60).alias("mean_wait_min"), F.lit(m / 2).alias("expected_min")
        )
        for m in minutes
    ]
    return since.agg(*aggs).select(F.inline(F.array(*rows)))


def first_windows(log: DataFrame, n: int) -> DataFrame:
    """Records up to the n-th window with cases; all of them when there are fewer."""
    busy = log.filter(F.col("n_cases") > 0).select("window_id").orderBy("window_id").limit(n)
    last = busy.agg(F.when(F.count("*") >= n, F.max("window_id"))).scalar()
    return log.filter(last.isNull() | (F.col("window_id") <= last))
