"""Case selection and other top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K


def _candidate(prob: Column, threshold: float | None) -> Column:
    return prob >= (K.HIGH_FROM if threshold is None else threshold)


def _keep(df: DataFrame, cond: Column, over, capacity: int, minimum: int, fallback: str) -> DataFrame:
    """Candidates come first in score order, so the best max(capacity, minimum) rows decide."""
    enough = F.count_if(cond).over(over) >= minimum
    fill = max(minimum, capacity) if fallback == "capacity" else minimum
    kept = df.withColumn("_enough", enough).filter(
        F.when(F.col("_enough"), cond & (F.col("case_no") <= capacity)).otherwise(
            F.col("case_no") <= fill
        )
    )
    return kept.withColumn(
        "branch", F.when(F.col("_enough"), "threshold").otherwise("fallback")
    ).drop("_enough")


def select_cases(
    df: DataFrame,
    prob: str,
    row_id: str,
    capacity: int = K.CASES_MAX,
    threshold: float | None = None,
    minimum: int = K.CASES_MIN,
    fallback: str = "capacity",
) -> DataFrame:
    """The cases raised to review, numbered 1..N by falling score.

    All rows at or over ``threshold`` (the high tier when None), cut at ``capacity``.
    With fewer than ``minimum`` of them the best rows are taken regardless of the
    threshold: up to the capacity, or just ``minimum`` with ``fallback='minimum'``.
    """
    best = df.orderBy(F.desc(prob), row_id).limit(max(capacity, minimum))
    ranked = best.withColumn(
        "case_no", F.row_number().over(Window.orderBy(F.desc(prob), row_id))
    )
    return _keep(
        ranked, _candidate(F.col(prob), threshold), Window.partitionBy(), capacity, minimum, fallback
    )


def select_cases_by(
    df: DataFrame,
    group: list[str],
    prob: str,
    row_id: str,
    capacity: int = K.CASES_MAX,
    threshold: float | None = None,
    minimum: int = 0,
    fallback: str = "capacity",
) -> DataFrame:
    """``select_cases`` inside every group; the rank limit is applied before the shuffle."""
    cond = _candidate(F.col(prob), threshold)
    source = df.filter(cond) if minimum == 0 else df
    ranked = source.withColumn(
        "case_no", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(prob), row_id))
    ).filter(F.col("case_no") <= max(capacity, minimum))
    if minimum == 0:
        return ranked.withColumn("branch", F.lit("threshold"))
    return _keep(ranked, cond, Window.partitionBy(*group), capacity, minimum, fallback)


def top_n(df: DataFrame, prob: str, row_id: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(prob), row_id).limit(n)


def bottom_n(df: DataFrame, prob: str, row_id: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.asc(prob), row_id).limit(n)


def priority_list(
    scored: DataFrame, prob: str, row_id: str, n: int = 10, level: str = "completo"
) -> DataFrame:
    """Numbered top list; the score and tier columns are shown only where the level allows."""
    if level not in K.LEVELS:
        raise ValueError(f"level must be one of {K.LEVELS}")
    top = top_n(scored, prob, row_id, max(1, int(n))).withColumn(
        "case_no", F.row_number().over(Window.orderBy(F.desc(prob), row_id))
    )
    shown = {"completo": [prob, "tier"], "sin_nivel": [prob], "ciego": []}[level]
    return top.select("case_no", *shown, "amount", "hour")


def disagreement_queue(
    df: DataFrame, prob: str, label: str, row_id: str, positives: int = 6, controls: int = 3
) -> DataFrame:
    """Lowest scored positives and highest scored negatives, by rising score."""
    tail = bottom_n(df.filter(F.col(label) == 1), prob, row_id, positives)
    head = top_n(df.filter(F.col(label) == 0), prob, row_id, controls)
    return tail.unionByName(head).withColumn(
        "case_no", F.row_number().over(Window.orderBy(F.asc(prob), row_id))
    )


def top_true_positives(
    df: DataFrame, prob: str, label: str, row_id: str, threshold: float = 0.5, n: int = 5
) -> DataFrame:
    return top_n(df.filter((F.col(label) == 1) & (F.col(prob) >= threshold)), prob, row_id, n)


def zone(cases: DataFrame, where: str | list[int], n: int) -> DataFrame:
    """Head, tail or an explicit list of case numbers of an ordered case file."""
    no = F.col("case_no")
    if where == "head":
        return cases.filter(no <= n)
    if where == "tail":
        return cases.filter(no > cases.agg(F.max("case_no")).scalar() - n)
    return cases.filter(no.isin(list(where)))
