"""Audit of review reports over whole tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text as T


def audit_reports(df: DataFrame, text: str, case_ids: str, universe: str) -> DataFrame:
    """Add the audit columns of each report.

    Invented ids outrank invented concepts, which outrank missing cases; the dollar
    and language flags are informative only.  Costly parts are staged as columns so
    that each is evaluated once per text.
    """
    staged = df.withColumns(
        {"_low": F.lower(text), "_cited": T.cited_ids(F.col(text)), "_cases": F.array_distinct(case_ids)}
    ).withColumn("concepts", T.invented_concepts(F.col("_low")))
    ids = staged.withColumns(
        {
            "invented_ids": F.array_except("_cited", universe),
            "outside_ids": F.array_except(F.array_intersect("_cited", universe), "_cases"),
            "covered_ids": F.sort_array(F.array_intersect("_cases", "_cited")),
        }
    )
    verdict = (
        F.when(F.size("invented_ids") > 0, K.AUDIT_INVENTED_IDS)
        .when(F.size("concepts") > 0, K.AUDIT_INVENTED_CONCEPTS)
        .when(F.size("covered_ids") < F.size("_cases"), K.AUDIT_INCOMPLETE)
        .otherwise(K.AUDIT_RELIABLE)
    )
    return ids.withColumns(
        {
            "audit": verdict,
            "reliable": verdict == K.AUDIT_RELIABLE,
            "coverage": F.size("covered_ids") / F.greatest(F.size("_cases"), F.lit(1)),
            "mentions_dollars": F.col(text).contains("$") | F.col("_low").contains("dolar"),
            "wrong_language": T.drifts_to_english(F.col(text)),
        }
    ).drop("_low", "_cited", "_cases")


def coverage_levels(df: DataFrame, texts: dict[str, str], case_ids: str) -> DataFrame:
    """Share of the case file cited by each of several texts of the same run."""
    out = df
    for name, col in texts.items():
        covered = F.size(F.array_intersect(case_ids, T.cited_ids(F.col(col))))
        out = out.withColumn(name, covered / F.greatest(F.size(F.array_distinct(case_ids)), F.lit(1)))
    return out


def contradictions(df: DataFrame, text: str, verdict: str) -> DataFrame:
    """Texts that cite the test-charge pattern and still dismiss the case."""
    return df.withColumn("mentions", T.mentions_test_charge(F.col(text))).withColumn(
        "contradicts", F.coalesce(F.col("mentions") & (F.col(verdict) == K.DISMISSED), F.lit(False))
    )


def contradiction_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if("mentions").alias("n_mentions"), F.count_if("contradicts").alias("n_contradictions")
    ).withColumn("rate", F.try_divide(F.col("n_contradictions"), F.col("n_mentions")))


def reaudit_update(log: DataFrame, audited: DataFrame, keys: list[str]) -> DataFrame:
    """Run log with the flag and verdict of a newer audit where the flag differs."""
    new = audited.select(*keys, F.col("reliable").alias("_rel"), F.col("audit").alias("_aud"))
    changed = F.col("_rel").isNotNull() & (F.col("_rel") != F.col("reliable"))
    return (
        log.join(new, keys, "left")
        .withColumns(
            {
                "audit": F.when(changed, F.col("_aud")).otherwise(F.col("audit")),
                "changed": changed,
                "reliable": F.when(changed, F.col("_rel")).otherwise(F.col("reliable")),
            }
        )
        .drop("_rel", "_aud")
    )
