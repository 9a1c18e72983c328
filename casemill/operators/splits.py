"""Splits and folds expressed as cuts: no row is ranked, only compared with a cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.hashing import hash32
from casemill.operators.ranks import before, order_statistics


def time_cut(df: DataFrame, time: str, row_id: str, share: float = K.TEST_SHARE) -> tuple:
    """(time, id) of the first test row; rows at the same time are ordered by id.

    Rows without a time have no place in the order and are an error.
    """
    return order_statistics(df, [time, row_id], [(None, lambda n: int(n * (1 - share)))], nulls="error")[0]


def temporal_split(df: DataFrame, time: str, row_id: str, share: float = K.TEST_SHARE) -> DataFrame:
    """Add ``split``: the earliest rows train, the latest ``share`` test."""
    cut = time_cut(df, time, row_id, share)
    return df.withColumn("split", F.when(before([time, row_id], cut), "train").otherwise("test"))


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def _blocks(df: DataFrame, keys: list[str], groups: list[tuple[Column, list]], nulls: str = "skip") -> Column:
    """Block number of a row: how many of its group's cuts it has reached; a rank without a row is no cut."""
    cuts = iter(order_statistics(df, keys, [(cond, r) for cond, ranks in groups for r in ranks], nulls))
    block = F.lit(None).cast("int")
    for cond, ranks in groups:
        own = [c for c in (next(cuts) for _ in ranks) if c is not None]
        reached = reduce(
            lambda a, b: a + b,
            [F.when(before(keys, c), 0).otherwise(1) for c in own],
            F.lit(0),
        )
        block = F.when(cond, reached).otherwise(block)
    return block


def _in_range(rank) -> Callable[[int], int | None]:
    """The rank as a function of the number of rows, None where there is no such row."""
    return lambda n: r if 0 <= (r := rank(n)) < n else None


def stratified_split(
    df: DataFrame, label: str, row_id: str, share: float = K.TEST_SHARE, seed: int = K.SEED
) -> DataFrame:
    """Add ``split``: in every class the first ``round(share * n)`` rows in hash order test."""
    keyed = df.withColumn("_h", hash32(seed, F.col(row_id)))
    groups = [
        (F.col(label) == F.lit(c), [_in_range(lambda n: round(share * n))]) for c in class_counts(df, label)
    ]
    block = _blocks(keyed, ["_h", row_id], groups)
    return keyed.withColumn("split", F.when(block == 0, "test").otherwise("train")).drop("_h")


def stratified_folds(
    df: DataFrame, label: str, row_id: str, k: int = 3, seed: int = K.SEED
) -> DataFrame:
    """Add ``fold`` 0..k-1: equal consecutive blocks of the hash order of each class."""
    keyed = df.withColumn("_h", hash32(seed, F.col(row_id)))
    ranks = [_in_range(lambda n, j=j: j * n // k) for j in range(1, k)]
    groups = [(F.col(label) == F.lit(c), ranks) for c in class_counts(df, label)]
    return keyed.withColumn("fold", _blocks(keyed, ["_h", row_id], groups)).drop("_h")


def time_folds(df: DataFrame, time: str, row_id: str, k: int = 3) -> DataFrame:
    """Add ``block`` 0..k: fold i trains on blocks before i and validates on block i."""
    ranks = [_in_range(lambda n, j=j: n - (k - j) * (n // (k + 1))) for j in range(k)]
    return df.withColumn("block", _blocks(df, [time, row_id], [(F.lit(True), ranks)], nulls="error"))


def hash_split(df: DataFrame, row_id: str, share: float, seed: int = K.SEED) -> DataFrame:
    """Add ``part``: the first ``max(1, int(share * n))`` rows in hash order validate."""
    keyed = df.withColumn("_h", hash32(seed, F.col(row_id)))
    block = _blocks(keyed, ["_h", row_id], [(F.lit(True), [_in_range(lambda n: max(1, int(n * share)))])])
    return keyed.withColumn("part", F.when(block == 0, "val").otherwise("train")).drop("_h")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Gradient weight neg/pos and its alternatives, and the balanced weight, per class."""
    # Two rows at most: the label has two values.
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    ratio = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    total = F.col("n_neg") + F.col("n_pos")
    side = F.explode(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("n_neg").alias("n")),
            F.struct(F.lit(1).alias("label"), F.col("n_pos").alias("n")),
        )
    )
    return counts.select("*", side.alias("s")).select(
        "s.label",
        "s.n",
        F.when(F.col("s.label") == 1, ratio).otherwise(F.lit(1.0)).alias("w_gradient"),
        F.when(F.col("s.label") == 1, F.sqrt(ratio)).otherwise(F.lit(1.0)).alias("w_sqrt"),
        (total / (F.lit(2) * F.greatest(F.col("s.n"), F.lit(1)))).alias("w_balanced"),
    )


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count("*").alias("n_rows"),
        F.sum(label).alias("positives"),
        F.avg(label).alias("prevalence"),
    )


def shift(df: DataFrame, time: str, start: float, hours: float = 4.0, offset_h: float = 0.0) -> DataFrame:
    """All rows of a half-open window that starts ``offset_h`` after ``start`` seconds."""
    lo = start + offset_h * 3600
    return df.filter((F.col(time) >= lo) & (F.col(time) < lo + hours * 3600))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"empty {what}: reduce its length or its offset")
    return df


def shift_table(spark: SparkSession, start: float, hours: float, offsets_h: Sequence[float]) -> DataFrame:
    """(offset_h, lo, hi): half-open shifts of ``hours`` at each offset after ``start`` seconds."""
    rows = [(float(o), start + o * 3600, start + (o + hours) * 3600) for o in offsets_h]
    return spark.createDataFrame(rows, "offset_h double, lo double, hi double")


def shifts(df: DataFrame, time: str, table: DataFrame, lo: str = "lo", hi: str = "hi", bin_seconds: float | None = None) -> DataFrame:
    """Rows with the columns of every shift of ``table`` they fall into, by an interval join.

    Time is cut into bins: a shift is copied into the bins it meets, a row stands in one, and rows
    meet shifts of their own bin, where the bounds are checked exactly.  A bin is as long as the mean
    shift unless given, so shifts are copied two or three times, however many overlap; the rows
    are not copied.  The span of all shifts is a filter on the rows.  Bounds that are null or not
    finite, and empty shifts, hold no rows.
    """
    some = table.filter(F.abs(F.col(lo)) + F.abs(F.col(hi)) < float("inf")).filter(F.col(lo) < F.col(hi))
    first, last, mean = some.agg(F.min(lo), F.max(hi), F.avg(F.col(hi) - F.col(lo))).first()
    if first is None:
        first = last = 0.0
    size = float(bin_seconds or mean or 1.0)
    met = F.sequence(F.floor((F.col(lo) - F.lit(first)) / size), F.floor((F.col(hi) - F.lit(first)) / size))
    binned = some.withColumn("_bin", F.explode(met))
    inside = df.filter((F.col(time) >= F.lit(first)) & (F.col(time) < F.lit(last)))
    rows = inside.withColumn("_bin", F.floor((F.col(time) - F.lit(first)) / size))
    joined = rows.join(binned, "_bin").filter((F.col(time) >= F.col(lo)) & (F.col(time) < F.col(hi)))
    return joined.drop("_bin")


def leak_guard(df: DataFrame, time: str, limit: float) -> DataFrame:
    """Count examples at or after the cut; ``assert_no_leak`` raises on any."""
    return df.agg(
        F.count("*").alias("n_checked"), F.count_if(F.col(time) >= limit).alias("violations")
    ).withColumn("limit_sec", F.lit(float(limit)))


def assert_no_leak(df: DataFrame, time: str, limit: float) -> None:
    found = leak_guard(df, time, limit).first()["violations"]
    if found:
        raise AssertionError(f"leak: {found} examples belong to the test period")
