"""Batches and samples drawn in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.hashing import hash32


def numbered(df: DataFrame, *order, name: str = "case_no") -> DataFrame:
    """Number 1..N; only for inputs already limited to a review list."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fixed_batch(
    period: DataFrame, label: str, row_id: str, n: int = 500, positives: int = 5, seed: int = K.SEED
) -> DataFrame:
    """Exactly ``positives`` positives (or all there are) and negatives up to ``n``, shuffled."""
    keyed = period.withColumn("_h", hash32(seed, F.col(row_id)))

    def first(cond, k):
        return keyed.filter(cond).orderBy("_h", row_id).limit(k)

    pos = first(F.col(label) == 1, positives)
    # Negatives fill what the positives leave; both sides hold at most n rows.
    both = pos.withColumn("_side", F.lit(0)).unionByName(
        first(F.col(label) == 0, n).withColumn("_side", F.lit(1))
    )
    kept = both.orderBy("_side", "_h", row_id).limit(n)
    shuffled = kept.withColumn("_s", hash32(seed, F.lit("shuffle"), F.col(row_id)))
    return numbered(shuffled, "_s", row_id, name="batch_no").withColumn(
        "batch_no", F.col("batch_no") - 1
    ).drop("_h", "_s", "_side")


def hard_negatives(df: DataFrame, label: str, prob: str, row_id: str, n: int) -> DataFrame:
    return df.filter(F.col(label) == 0).orderBy(F.desc(prob), row_id).limit(n)


def quota_positives(
    df: DataFrame, label: str, amount: str, row_id: str, n: int, seed: int = K.SEED, low_to: float = 5.0
) -> DataFrame:
    """``n`` positives, half of them reserved for small amounts, topped up from the rest."""
    keyed = df.filter(F.col(label) == 1).withColumn("_h", hash32(seed, F.col(row_id)))
    low = numbered(
        keyed.filter(F.col(amount) <= low_to).orderBy("_h", row_id).limit(n), "_h", row_id, name="_r"
    ).withColumn("_turn", F.when(F.col("_r") <= n // 2, 0).otherwise(2))
    high = numbered(
        keyed.filter(F.col(amount) > low_to).orderBy("_h", row_id).limit(n), "_h", row_id, name="_r"
    ).withColumn("_turn", F.lit(1))
    return low.unionByName(high).orderBy("_turn", "_r").limit(n).drop("_h", "_r", "_turn")
