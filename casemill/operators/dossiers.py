"""Case texts built from columns.  Wording is a fixed format that other parts parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import action_for, direction, fixed, right_aligned, verdict_label
from casemill.operators.explain import masked_names, ranked

# Fixed line formats of the dossier.
NOTE = " (datos verificados del detector; no los alteres)"
BATCH_TITLE = "EXPEDIENTE DE CASOS (datos verificados del detector; no los alteres)"
TOP_TITLE = "Variables de mayor aporte:"
TABLE_HEAD = "| Caso | Importe (EUR) | Hora | Veredicto | Accion recomendada |\n|---|---|---|---|---|"


def _number(no: Column) -> Column:
    return no.cast("string")


def score_lines(prob: Column, tier: Column, level: str) -> list[Column]:
    """What the reviewer sees of the score at an information level."""
    p = F.concat(F.lit("Probabilidad de fraude: "), fixed(prob, 4))
    if level == "completo":
        return [p, F.concat(F.lit("Nivel de riesgo: "), tier)]
    return [p] if level == "sin_nivel" else []


def _body(level: str, top: int) -> list[Column]:
    lines = F.transform(
        ranked(F.col("contributions"), top),
        lambda c: F.concat(
            F.lit("  "), c["var"], F.lit(" = "), fixed(c["value"], 3), F.lit(" (aporte "),
            fixed(c["contrib"], 3, signed=True), F.lit(", "), direction(c["contrib"]), F.lit(")"),
        ),
    )
    return [
        *score_lines(F.col("prob"), F.col("tier"), level),
        F.concat(F.lit("Importe: "), fixed(F.col("amount"), 2), F.lit(" EUR")),
        F.concat(F.lit("Hora del dia: "), fixed(F.col("hour"), 1), F.lit("h")),
        F.lit(TOP_TITLE),
        F.array_join(lines, "\n"),
    ]


def case_dossier(mean_amount: Column, level: str = "completo", top: int = 4) -> Column:
    """Text of one case: score lines by level, amount, hour, main contributions, batch mean."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CASO "), _number(F.col("case_no")), F.lit(NOTE)),
        *_body(level, top),
        F.concat(F.lit("Importe medio del lote: "), fixed(mean_amount, 2), F.lit(" EUR")),
    )


def narrative(level: str = "completo", top: int = 6) -> Column:
    """Narrative form with the wider contribution list."""
    p = F.concat(F.lit("  Probabilidad de fraude: "), fixed(F.col("prob"), 4))
    head = {
        "completo": [F.concat(p, F.lit(" (riesgo "), F.col("tier"), F.lit(")"))],
        "sin_nivel": [p],
        "ciego": [],
    }[level]
    lines = F.transform(
        ranked(F.col("contributions"), top),
        lambda c: F.concat(
            F.lit("    "), right_aligned(c["var"], 8), F.lit(" = "),
            right_aligned(fixed(c["value"], 3), 10), F.lit("  ->  aporte "),
            fixed(c["contrib"], 3, signed=True), F.lit(" ("), direction(c["contrib"]), F.lit(")"),
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Transaccion #"), F.col("tx_id").cast("string")),
        *head,
        F.concat(
            F.lit("  Importe: "), fixed(F.col("amount"), 2), F.lit(" EUR | Hora del dia: "),
            fixed(F.col("hour"), 1), F.lit("h"),
        ),
        F.lit("  Variables que mas empujan la decision:"),
        F.array_join(lines, "\n"),
    )


def _joined(no: str, block: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(F.col(no).alias("no"), block.alias("block"))))
    return F.array_join(F.transform(ordered, lambda b: b["block"]), "\n")


def batch_dossier(
    cases: DataFrame, means: DataFrame, run: Sequence[str], level: str = "completo", top: int = 4
) -> DataFrame:
    """One text per run: all case blocks in order, batch mean and count.

    Texts gather case files only, which the review capacity bounds.
    """
    run = list(run)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("--- CASO "), _number(F.col("case_no")), F.lit(" ---")),
        *_body(level, top),
        F.lit(""),
    )
    joined = cases.groupBy(*run).agg(_joined("case_no", block).alias("_blocks"), F.count("*").alias("n_cases"))
    return joined.join(means, run).select(
        *run,
        "n_cases",
        F.concat_ws(
            "\n",
            F.lit(BATCH_TITLE + "\n"),
            "_blocks",
            F.concat(F.lit("Importe medio del lote: "), fixed(F.col("mean_amount"), 2), F.lit(" EUR")),
            F.concat(F.lit("Total de casos en el expediente: "), F.col("n_cases").cast("string")),
        ).alias("text"),
    )


def case_table(cases: DataFrame, verdicts: DataFrame, run: Sequence[str]) -> DataFrame:
    """Final table per run; the closing counts use all verdicts, even of unknown cases."""
    run = list(run)
    given = verdicts.select(*run, "case_no", "verdict")
    row = F.concat(
        F.lit("| "), _number(F.col("case_no")), F.lit(" | "), fixed(F.col("amount"), 2), F.lit(" | "),
        fixed(F.col("hour"), 1), F.lit("h | "), verdict_label(F.col("verdict")), F.lit(" | "),
        action_for(F.col("verdict")), F.lit(" |"),
    )
    tables = cases.join(given, [*run, "case_no"], "left").groupBy(*run).agg(
        _joined("case_no", row).alias("_rows"), F.count("*").alias("n_cases")
    )
    counts = given.groupBy(*run).agg(
        F.count_if(F.col("verdict") == K.CONFIRMED).alias("n_confirmed"),
        F.count_if(F.col("verdict") == K.DISMISSED).alias("n_discarded"),
    )
    all_ = tables.join(counts, run, "left").na.fill(0, ["n_confirmed", "n_discarded"])
    open_ = F.col("n_cases") - F.col("n_confirmed") - F.col("n_discarded")
    text = lambda c: F.col(c).cast("string")
    foot = F.concat(
        F.lit("\n**"), text("n_cases"), F.lit(" casos en el expediente**: "), text("n_confirmed"),
        F.lit(" confirmados, "), text("n_discarded"), F.lit(" descartados"),
        F.when(open_ != 0, F.concat(F.lit(", "), open_.cast("string"), F.lit(" sin veredicto"))).otherwise(""),
        F.lit("."),
    )
    return all_.select(
        *run, "n_cases", "n_confirmed", "n_discarded",
        F.concat_ws("\n", F.lit(TABLE_HEAD), "_rows", foot).alias("text"),
    )


def paired_dossiers(df: DataFrame, named: dict[str, Column], business: Sequence[str], top: int = 6) -> DataFrame:
    """A full text and one with the same numbers but masked business variable names."""
    entries = ranked(F.col("contributions"), top, F.col("bias"))

    def lines(e: Column) -> Column:
        return F.array_join(
            F.transform(e, lambda c: F.concat(F.lit("  "), c["var"], F.lit(": "), fixed(c["contrib"], 3, True))),
            "\n",
        )

    no = F.concat(F.lit("CASO "), _number(F.col("case_no")))
    amount = F.concat(F.lit("Importe: "), fixed(F.col("amount"), 2), F.lit(" USD"))
    hour = F.concat(F.lit("Hora del dia: "), fixed(F.col("hour"), 1), F.lit(" h"))
    prob = F.concat(F.lit("Probabilidad de fraude segun el detector: "), fixed(F.col("prob"), 4))
    extra = [F.concat(F.lit(f"{label}: "), value.cast("string")) for label, value in named.items()]
    staged = df.withColumn("_entries", entries)
    return staged.withColumns(
        {
            "full": F.concat_ws(
                "\n", no, *extra, amount, hour, prob,
                F.lit("Contribuciones principales del detector:"), lines(F.col("_entries")),
            ),
            "reduced": F.concat_ws(
                "\n", no, amount, hour, prob,
                F.lit("Contribuciones principales del detector, variables sin identificar:"),
                lines(masked_names(F.col("_entries"), business)),
            ),
        }
    ).drop("_entries")


def training_answer(wording: dict[str, str], low_to: float = 5.0) -> Column:
    """Answer text of a training pair: facts, up to two pushes each way, clause and verdict.

    ``wording`` gives the sentences: opening (with %s for case, probability, amount),
    towards, against, low, high and legit.
    """
    contribs = ranked(F.col("contributions"), 6)

    def push(keep, opening: str) -> Column:
        side = F.slice(F.filter(contribs, keep), 1, 2)
        said = F.array_join(
            F.transform(side, lambda c: F.concat(c["var"], F.lit(" ("), fixed(c["contrib"], 3, True), F.lit(")"))),
            " y ",
        )
        return F.when(F.size(side) > 0, F.concat(F.lit(opening), said, F.lit(".")))

    positive = F.col("label") == 1
    clause = (
        F.when(positive & (F.col("amount") <= low_to), wording["low"])
        .when(positive, wording["high"])
        .otherwise(wording["legit"])
    )
    body = F.concat_ws(
        " ",
        F.format_string(
            wording["opening"], _number(F.col("case_no")), fixed(F.col("prob"), 4), fixed(F.col("amount"), 2)
        ),
        push(lambda c: c["contrib"] > 0, wording["towards"]),
        push(lambda c: c["contrib"] < 0, wording["against"]),
        clause,
    )
    verdict = F.when(positive, K.CONFIRMED).otherwise(K.DISMISSED)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CASO "), _number(F.col("case_no"))),
        body,
        F.concat(F.lit("VEREDICTO: "), verdict),
    )
