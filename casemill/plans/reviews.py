"""Case files and review texts that Spark derives from ``events``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.selection import select_cases_by
from casemill.plans.registry import TX
from casemill.sources.tables import load_texts, transactions

RUN_SECONDS = 21600  # one review run per six hours


def with_run(tx: DataFrame) -> DataFrame:
    return tx.withColumn("run_id", F.floor(F.col("t_sec") / float(RUN_SECONDS)))


def run_cases(spark, d) -> DataFrame:
    """At most ten cases per run, numbered by falling score."""
    return select_cases_by(with_run(transactions(spark, d)), ["run_id"], "prob", "tx_id", 10, 0.4)


def case_texts(cases: DataFrame) -> DataFrame:
    """One review text per case in four styles: plain, English, denying, unfinished."""
    no, style = F.col("case_no").cast("string"), F.col("k") % 4
    confirmed = F.col("amount") + F.col("k") >= 130
    es = F.when(confirmed, "CONFIRMADO").otherwise("DESCARTADO")
    en = F.when(confirmed, "Confirmed").otherwise("Dismissed")
    amount = F.floor("amount").cast("string")
    text = (
        F.when(
            style == 0,
            F.concat(
                F.lit("CASO "), no, F.lit("\nImporte de "), amount,
                F.lit(" EUR. Parece una prueba antes de realizar un cargo mayor.\nVEREDICTO: "), es,
            ),
        )
        .when(
            style == 1,
            F.concat(
                F.lit("Case "), no, F.lit("\nThe amount of "), amount,
                F.lit(" is unusual for the merchant.\nVerdict: "), en, F.lit("\nThanks for the review"),
            ),
        )
        .when(
            style == 2,
            F.concat(
                F.lit("CASO **"), no, F.lit("**\nSin acceso a historial de cliente ni comercio.\nCASO "), no,
                F.lit(" VEREDICTO: "), es,
            ),
        )
        .otherwise(
            F.concat(
                F.lit("CASO "), no, F.lit("\n| "), no, F.lit(" | $"), amount,
                F.lit(" |\nTransaccion ID: "), (F.col("case_no") + 12).cast("string"), F.lit("\nSin cerrar."),
            )
        )
    )
    return cases.withColumn("text", text)


CASES_SQL = f"""{TX},
runs AS (SELECT *, CAST(floor(t_sec / {RUN_SECONDS}e0) AS BIGINT) AS run_id FROM tx),
cases AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY prob DESC, tx_id) AS case_no
  FROM runs WHERE prob >= 0.4e0 QUALIFY case_no <= 10)"""

TEXTS_SQL = f"""{CASES_SQL},
texts AS (SELECT *, CASE k % 4
  WHEN 0 THEN 'CASO ' || case_no || chr(10) || 'Importe de ' || CAST(floor(amount) AS BIGINT)
    || ' EUR. Parece una prueba antes de realizar un cargo mayor.' || chr(10) || 'VEREDICTO: '
    || CASE WHEN amount + k >= 130 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END
  WHEN 1 THEN 'Case ' || case_no || chr(10) || 'The amount of ' || CAST(floor(amount) AS BIGINT)
    || ' is unusual for the merchant.' || chr(10) || 'Verdict: '
    || CASE WHEN amount + k >= 130 THEN 'Confirmed' ELSE 'Dismissed' END || chr(10) || 'Thanks for the review'
  WHEN 2 THEN 'CASO **' || case_no || '**' || chr(10) || 'Sin acceso a historial de cliente ni comercio.' || chr(10)
    || 'CASO ' || case_no || ' VEREDICTO: ' || CASE WHEN amount + k >= 130 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END
  ELSE 'CASO ' || case_no || chr(10) || '| ' || case_no || ' | $' || CAST(floor(amount) AS BIGINT) || ' |' || chr(10)
    || 'Transaccion ID: ' || (case_no + 12) || chr(10) || 'Sin cerrar.' END AS text FROM cases)"""


def run_texts(spark, d) -> DataFrame:
    """Review texts of a run joined in case order; the case file bounds their number."""
    texts = case_texts(run_cases(spark, d))
    ordered = F.sort_array(F.collect_list(F.struct("case_no", "text")))
    return texts.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), "\n").alias("text"),
        F.sort_array(F.collect_list("case_no").cast("array<bigint>")).alias("case_ids"),
    )


REPORTS_SQL = f"""{TEXTS_SQL},
reports AS (SELECT run_id, string_agg(text, chr(10) ORDER BY case_no) AS text,
  list_sort(list(CAST(case_no AS BIGINT))) AS case_ids FROM texts GROUP BY run_id)"""


def all_texts(spark, d) -> DataFrame:
    """Every text at hand: run reports, documents, conversation turns."""
    none = F.array().cast("array<bigint>")
    reports = run_texts(spark, d).select(
        F.concat(F.lit("run:"), F.col("run_id")).alias("text_id"), "text", "case_ids"
    )
    docs = load_texts(spark, d, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("text_id"), "text", none.alias("case_ids")
    )
    turns = load_texts(spark, d, "conversations").select(
        F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("text_id"), "text", none.alias("case_ids")
    )
    return reports.unionByName(docs).unionByName(turns)


# RE2 knows only ASCII word characters, so the twin turns accented letters into a plain
# letter, one for one; the driver's texts hold none of the accented pattern words.
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿßæœ"


def folded(expr: str) -> str:
    letters = _ACCENTED + "".join(c.upper() for c in _ACCENTED if len(c.upper()) == 1)
    return f"translate({expr}, '{letters}', '{'z' * len(letters)}')"


ALL_TEXTS_SQL = f"""{REPORTS_SQL},
corpus AS (SELECT 'run:' || run_id AS text_id, text, case_ids FROM reports
  UNION ALL SELECT 'doc:' || doc_id, text, CAST([] AS BIGINT[]) FROM documents
  UNION ALL SELECT 'conv:' || conv_id || ':' || turn, text, CAST([] AS BIGINT[]) FROM conversations)"""
