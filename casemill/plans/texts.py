"""Queries: explanations, dossiers, verdicts, audits, system measurement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import scalar as S
from casemill.functions import text as T
from casemill.operators import audit, dossiers, explain, selection, system
from casemill.plans import triage
from casemill.plans.registry import TX, query
from casemill.plans.reviews import (
    ALL_TEXTS_SQL,
    CASES_SQL,
    REPORTS_SQL,
    TEXTS_SQL,
    all_texts,
    case_texts,
    folded,
    run_cases,
    run_texts,
    with_run,
)
from casemill.sources.tables import scored_transactions, transactions

R = F.round
WEIGHTS = {"amount": 0.02, "hour": -0.05, "k": 0.01, "card": -0.003}
BUSINESS = ["k", "card"]


def _lit(pattern: str) -> str:
    return pattern.replace("'", "''")


def _words(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _ids(col: str):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ",").alias(col)


def _rules_sql() -> str:
    rows = ", ".join(f"({i}, '{_lit(p)}', '{t}')" for i, (p, t) in enumerate(K.CONCEPT_RULES))
    return f"rules(rule, p, topic) AS (VALUES {rows})"


# First undenied hit per (text, rule): offsets are summed from the pieces between hits.
_HITS_SQL = f"""{ALL_TEXTS_SQL}, {_rules_sql()},
low AS (SELECT text_id, lower(text) AS low, {folded('lower(text)')} AS t FROM corpus),
found AS (SELECT text_id, rule, topic, low, t, string_split_regex(t, p) AS pieces, regexp_extract_all(t, p) AS hits
  FROM low, rules WHERE regexp_matches(t, p)),
steps AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
spots AS (SELECT text_id, rule, topic, low, t, i, length(hits[i]) AS n,
  list_sum([length(x) for x in pieces[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS start FROM steps),
undenied AS (SELECT * FROM spots WHERE NOT regexp_matches(
  substr(t, CAST(greatest(start - 120, 0) + 1 AS BIGINT), CAST(least(start, 120) AS BIGINT)), '(?i){_lit(K.NEGATION_PATTERN)}')),
concepts AS (SELECT text_id, rule, any_value(topic) AS topic,
  arg_min(substr(low, CAST(start + 1 AS BIGINT), n), i) AS term FROM undenied GROUP BY text_id, rule)"""


def _cited_sql(expr: str) -> str:
    parts = " || ".join(f"regexp_extract_all(t, '(?m){_lit(p)}', 1)" for p in K.ID_PATTERNS)
    return f"(SELECT list_sort(list_distinct([CAST(x AS BIGINT) for x in {parts}])) FROM (SELECT {expr} AS t))"


def _pairs_sql(source: str, key: str) -> str:
    p = "(?is)" + _lit(K.VERDICT_PATTERN)
    return f"""pairs AS (SELECT {key}, unnest(regexp_extract_all(text, '{p}', 1)) AS no,
  unnest(regexp_extract_all(text, '{p}', 3)) AS word,
  unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM {source}),
verdicts AS (SELECT {key}, CAST(no AS BIGINT) AS case_no, arg_max(CASE upper(word) WHEN 'CONFIRMED' THEN 'CONFIRMADO'
  WHEN 'DISCARDED' THEN 'DESCARTADO' WHEN 'DISMISSED' THEN 'DESCARTADO' ELSE upper(word) END, pos) AS verdict
  FROM pairs GROUP BY 1, 2)"""


_VERDICTS_SQL = f"{REPORTS_SQL}, {_pairs_sql('reports', 'run_id')}"


def _verdicts(spark, d):
    return system.extract_verdicts(run_texts(spark, d), ["run_id"], "text")


# ---- explanations ------------------------------------------------------------------

_CONTRIB_SQL = """mu AS (SELECT avg(amount) AS ma, avg(hour) AS mh, avg(k) AS mk, avg(card) AS mc FROM tx),
con AS (SELECT tx_id, unnest(['amount', 'hour', 'k', 'card']) AS var, unnest([amount, hour, CAST(k AS DOUBLE), CAST(card AS DOUBLE)]) AS value,
  unnest([0.02e0 * (amount - ma), -0.05e0 * (hour - mh), 0.01e0 * (k - mk), -0.003e0 * (card - mc)]) AS contrib, unnest([1, 2, 3, 4]) AS pos FROM tx, mu),
rk AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY abs(contrib) DESC, pos) AS rank FROM con)"""
_BIASED_SQL = f"""{_CONTRIB_SQL},
bia AS (SELECT 0.02e0 * ma - 0.05e0 * mh + 0.01e0 * mk - 0.003e0 * mc AS bias FROM mu),
all_con AS (SELECT tx_id, var, contrib, pos FROM con UNION ALL SELECT tx_id, 'sesgo_base', bias, 5 FROM tx, bia),
rkb AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY abs(contrib) DESC, pos) AS rank FROM all_con)"""


def _explained(spark, d):
    return explain.linear_contributions(scored_transactions(spark, d), WEIGHTS)


@query(
    "m5_linear_contrib",
    f"""WITH {TX}, {_CONTRIB_SQL} SELECT tx_id, rank, var, round(value, 6) AS value, round(contrib, 6) AS contrib,
      round((SELECT 0.02e0 * amount - 0.05e0 * hour + 0.01e0 * k - 0.003e0 * card FROM tx WHERE tx.tx_id = rk.tx_id), 6) AS margin FROM rk""",
)
def m5_linear_contrib(spark, d):
    e = _explained(spark, d).withColumn("entries", explain.ranked(F.col("contributions"), 6))
    return e.select("tx_id", "margin", F.posexplode("entries").alias("i", "e")).select(
        "tx_id", (F.col("i") + 1).alias("rank"), "e.var", R("e.value", 6).alias("value"),
        R("e.contrib", 6).alias("contrib"), R("margin", 6).alias("margin"),
    )


@query(
    "m6_contrib_with_bias",
    f"WITH {TX}, {_BIASED_SQL} SELECT tx_id, rank, var, round(contrib, 6) AS contrib FROM rkb",
)
def m6_contrib_with_bias(spark, d):
    e = _explained(spark, d).withColumn("entries", explain.ranked(F.col("contributions"), 6, F.col("bias")))
    return e.select("tx_id", F.posexplode("entries").alias("i", "e")).select(
        "tx_id", (F.col("i") + 1).alias("rank"), "e.var", R("e.contrib", 6).alias("contrib")
    )


@query("w4_top_contrib", f"WITH {TX}, {_CONTRIB_SQL} SELECT tx_id, rank, var FROM rk WHERE rank <= 2")
def w4_top_contrib(spark, d):
    e = _explained(spark, d).withColumn("entries", explain.ranked(F.col("contributions"), 2))
    return e.select("tx_id", F.posexplode("entries").alias("i", "e")).select(
        "tx_id", (F.col("i") + 1).alias("rank"), "e.var"
    )


@query(
    "p12_direction",
    f"WITH {TX}, {_CONTRIB_SQL} SELECT tx_id, var, CASE WHEN contrib > 0 THEN 'hacia FRAUDE' ELSE 'hacia LEGITIMA' END AS direction FROM con",
)
def p12_direction(spark, d):
    return _explained(spark, d).select("tx_id", F.explode("contributions").alias("e")).select(
        "tx_id", "e.var", S.direction(F.col("e.contrib")).alias("direction")
    )


@query(
    "p15_masked_names",
    f"""WITH {TX}, {_BIASED_SQL} SELECT tx_id, rank, CASE WHEN var IN ('k', 'card') THEN 'var_' ||
      (count(*) FILTER (var IN ('k', 'card')) OVER (PARTITION BY tx_id ORDER BY rank)) ELSE var END AS name FROM rkb""",
)
def p15_masked_names(spark, d):
    e = _explained(spark, d).withColumn("entries", explain.ranked(F.col("contributions"), 6, F.col("bias")))
    named = e.withColumn("masked", explain.masked_names(F.col("entries"), BUSINESS))
    return named.select("tx_id", F.posexplode("masked").alias("i", "e")).select(
        "tx_id", (F.col("i") + 1).alias("rank"), F.col("e.var").alias("name")
    )


# ---- dossiers ----------------------------------------------------------------------


def _run_file(spark, d):
    """Case files with their explanations; only cases are explained, against the means of all rows."""
    tx = with_run(scored_transactions(spark, d))
    cases = selection.select_cases_by(tx, ["run_id"], "prob", "tx_id", 10, 0.4)
    return explain.linear_contributions(cases, WEIGHTS, base=tx)


def _run_means(spark, d):
    return with_run(transactions(spark, d)).groupBy("run_id").agg(F.avg("amount").alias("mean_amount"))


_LINES_SQL = """lines AS (SELECT tx_id, string_agg(printf('  %s = %.3f (aporte %+.3f, %s)', var, value, contrib,
  CASE WHEN contrib > 0 THEN 'hacia FRAUDE' ELSE 'hacia LEGITIMA' END), chr(10) ORDER BY rank) AS body FROM rk WHERE rank <= 4 GROUP BY tx_id)"""
_DOSSIER_SQL = f"""{CASES_SQL}, {_CONTRIB_SQL},
means AS (SELECT run_id, avg(amount) AS mean_amount FROM runs GROUP BY run_id),
{_LINES_SQL}"""
_FACTS = """'Importe: ' || printf('%.2f', amount) || ' EUR' || chr(10) || 'Hora del dia: ' || printf('%.1f', hour) || 'h' || chr(10)
  || 'Variables de mayor aporte:' || chr(10) || body"""
_MEAN = "'Importe medio del lote: ' || printf('%.2f', mean_amount) || ' EUR'"
_SCORE = "'Probabilidad de fraude: ' || printf('%.4f', prob) || chr(10)"


@query(
    "t1_case_dossier",
    f"""WITH {_DOSSIER_SQL} SELECT run_id, case_no, level, 'CASO ' || case_no || '{dossiers.NOTE}' || chr(10)
      || CASE level WHEN 'completo' THEN {_SCORE} || 'Nivel de riesgo: ' || tier || chr(10) WHEN 'sin_nivel' THEN {_SCORE} ELSE '' END
      || {_FACTS} || chr(10) || {_MEAN} AS text
      FROM cases JOIN lines USING (tx_id) JOIN means USING (run_id), (VALUES ('completo'), ('sin_nivel'), ('ciego')) v(level)""",
)
def t1_case_dossier(spark, d):
    rows = _run_file(spark, d).join(_run_means(spark, d), "run_id")
    texts = F.explode(
        F.create_map(
            *[x for lv in K.LEVELS for x in (F.lit(lv), dossiers.case_dossier(F.col("mean_amount"), lv))]
        )
    ).alias("level", "text")
    return rows.select("run_id", "case_no", texts)


@query(
    "t1_narrative",
    f"""WITH {CASES_SQL}, {_CONTRIB_SQL},
      lines AS (SELECT tx_id, string_agg('    ' || lpad(var, 8, ' ') || ' = ' || printf('%10.3f', value) || '  ->  aporte ' || printf('%+.3f', contrib) ||
        CASE WHEN contrib > 0 THEN ' (hacia FRAUDE)' ELSE ' (hacia LEGITIMA)' END, chr(10) ORDER BY rank) AS body FROM rk GROUP BY tx_id)
      SELECT run_id, case_no, 'Transaccion #' || tx_id || chr(10) || '  Probabilidad de fraude: ' || printf('%.4f', prob) || ' (riesgo ' || tier || ')' || chr(10)
      || '  Importe: ' || printf('%.2f', amount) || ' EUR | Hora del dia: ' || printf('%.1f', hour) || 'h' || chr(10)
      || '  Variables que mas empujan la decision:' || chr(10) || body AS text FROM cases JOIN lines USING (tx_id)""",
)
def t1_narrative(spark, d):
    return _run_file(spark, d).select("run_id", "case_no", dossiers.narrative().alias("text"))


@query(
    "t2_batch_dossier",
    f"""WITH {_DOSSIER_SQL} SELECT run_id, count(*) AS n_cases, '{dossiers.BATCH_TITLE}' || chr(10) || chr(10) || string_agg('--- CASO ' || case_no || ' ---' || chr(10)
      || {_SCORE} || 'Nivel de riesgo: ' || tier || chr(10) || {_FACTS} || chr(10), chr(10) ORDER BY case_no) || chr(10)
      || any_value({_MEAN}) || chr(10) || 'Total de casos en el expediente: ' || count(*) AS text
      FROM cases JOIN lines USING (tx_id) JOIN means USING (run_id) GROUP BY run_id""",
)
def t2_batch_dossier(spark, d):
    return dossiers.batch_dossier(_run_file(spark, d), _run_means(spark, d), ["run_id"])


@query(
    "t3_case_table",
    f"""WITH {_VERDICTS_SQL}, c AS (SELECT run_id, count(*) FILTER (verdict = 'CONFIRMADO') AS nc, count(*) FILTER (verdict = 'DESCARTADO') AS nd FROM verdicts GROUP BY run_id),
      b AS (SELECT run_id, count(*) AS n, string_agg('| ' || case_no || ' | ' || printf('%.2f', amount) || ' | ' || printf('%.1f', hour) || 'h | ' ||
        CASE verdict WHEN 'DESCARTADO' THEN 'Descartado | Archivar' WHEN 'CONFIRMADO' THEN 'Confirmado | Bloquear tarjeta' ELSE 'Sin veredicto | Revisar manualmente' END || ' |', chr(10) ORDER BY case_no) AS rows_
        FROM cases LEFT JOIN verdicts USING (run_id, case_no) GROUP BY run_id)
      SELECT run_id, n AS n_cases, coalesce(nc, 0) AS n_confirmed, coalesce(nd, 0) AS n_discarded,
      '| Caso | Importe (EUR) | Hora | Veredicto | Accion recomendada |' || chr(10) || '|---|---|---|---|---|' || chr(10) || rows_ || chr(10) || chr(10) || '**' || n || ' casos en el expediente**: '
      || coalesce(nc, 0) || ' confirmados, ' || coalesce(nd, 0) || ' descartados' || CASE WHEN n - coalesce(nc, 0) - coalesce(nd, 0) <> 0
      THEN ', ' || (n - coalesce(nc, 0) - coalesce(nd, 0)) || ' sin veredicto' ELSE '' END || '.' AS text FROM b LEFT JOIN c USING (run_id)""",
)
def t3_case_table(spark, d):
    return dossiers.case_table(run_cases(spark, d), _verdicts(spark, d), ["run_id"])


@query(
    "t4_paired_dossiers",
    f"""WITH {CASES_SQL}, {_BIASED_SQL},
      nm AS (SELECT tx_id, rank, var, contrib, CASE WHEN var IN ('k', 'card') THEN 'var_' || (count(*) FILTER (var IN ('k', 'card')) OVER (PARTITION BY tx_id ORDER BY rank)) ELSE var END AS name FROM rkb),
      l AS (SELECT tx_id, string_agg('  ' || var || ': ' || printf('%+.3f', contrib), chr(10) ORDER BY rank) AS a, string_agg('  ' || name || ': ' || printf('%+.3f', contrib), chr(10) ORDER BY rank) AS b FROM nm GROUP BY tx_id),
      f AS (SELECT *, 'Importe: ' || printf('%.2f', amount) || ' USD' || chr(10) || 'Hora del dia: ' || printf('%.1f', hour) || ' h' || chr(10) || 'Probabilidad de fraude segun el detector: ' || printf('%.4f', prob) || chr(10) AS facts FROM cases JOIN l USING (tx_id))
      SELECT run_id, case_no, 'CASO ' || case_no || chr(10) || 'Categoria: ' || category || chr(10) || 'Tarjeta: ' || card || chr(10) || facts || 'Contribuciones principales del detector:' || chr(10) || a AS "full",
      'CASO ' || case_no || chr(10) || facts || 'Contribuciones principales del detector, variables sin identificar:' || chr(10) || b AS reduced FROM f""",
)
def t4_paired_dossiers(spark, d):
    named = {"Categoria": F.col("category"), "Tarjeta": F.col("card")}
    return dossiers.paired_dossiers(_run_file(spark, d), named, BUSINESS).select(
        "run_id", "case_no", "full", "reduced"
    )


WORDING = {
    "opening": "El CASO %s llega con probabilidad %s e importe de %s EUR.",
    "towards": "A favor del fraude: ",
    "against": "En contra: ",
    "low": "Un importe pequeno tambien puede ser una prueba.",
    "high": "Los aportes respaldan la alerta.",
    "legit": "Los aportes no respaldan la alerta.",
}


@query(
    "t5_training_pairs",
    f"""WITH {CASES_SQL}, {_CONTRIB_SQL},
      s AS (SELECT tx_id, contrib > 0 AS up, var, contrib, rank, row_number() OVER (PARTITION BY tx_id, contrib > 0 ORDER BY rank) AS r FROM rk WHERE contrib <> 0),
      p AS (SELECT tx_id, string_agg(var || ' (' || printf('%+.3f', contrib) || ')', ' y ' ORDER BY r) FILTER (up) AS u,
        string_agg(var || ' (' || printf('%+.3f', contrib) || ')', ' y ' ORDER BY r) FILTER (NOT up) AS w FROM s WHERE r <= 2 GROUP BY tx_id)
      SELECT tx_id, 'Explica el CASO ' || case_no || '.' AS prompt, 'CASO ' || case_no || chr(10) || 'El CASO ' || case_no || ' llega con probabilidad ' || printf('%.4f', prob) || ' e importe de ' || printf('%.2f', amount) || ' EUR.'
      || coalesce(' A favor del fraude: ' || u || '.', '') || coalesce(' En contra: ' || w || '.', '')
      || CASE WHEN label = 1 AND amount <= 5 THEN ' Un importe pequeno tambien puede ser una prueba.' WHEN label = 1 THEN ' Los aportes respaldan la alerta.' ELSE ' Los aportes no respaldan la alerta.' END
      || chr(10) || 'VEREDICTO: ' || CASE WHEN label = 1 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END AS answer, label FROM cases JOIN p USING (tx_id)""",
)
def t5_training_pairs(spark, d):
    return _run_file(spark, d).select(
        "tx_id",
        F.format_string("Explica el CASO %s.", F.col("case_no").cast("string")).alias("prompt"),
        dossiers.training_answer(WORDING).alias("answer"),
        "label",
    )


@query(
    "a14_trainset_summary",
    f"""WITH {TEXTS_SQL} SELECT label, count(*) AS n, count(*) FILTER (amount <= 5) AS n_low, round(avg(length(text)), 6) AS mean_chars FROM texts GROUP BY label""",
)
def a14_trainset_summary(spark, d):
    return case_texts(run_cases(spark, d)).groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("amount") <= 5).alias("n_low"),
        R(F.avg(F.length("text")), 6).alias("mean_chars"),
    )


# ---- verdicts and prose ------------------------------------------------------------


@query("t6_verdicts", f"WITH {_VERDICTS_SQL} SELECT run_id, case_no, verdict FROM verdicts")
def t6_verdicts(spark, d):
    return _verdicts(spark, d)


@query(
    "t7_single_verdict",
    f"""WITH {TEXTS_SQL} SELECT run_id, case_no, coalesce(nullif(upper(regexp_extract(text, '(?is){K.SINGLE_VERDICT_PATTERN}', 1)), ''), 'SIN VEREDICTO') AS verdict FROM texts""",
)
def t7_single_verdict(spark, d):
    texts = case_texts(run_cases(spark, d))
    return texts.select("run_id", "case_no", T.single_verdict(F.col("text")).alias("verdict"))


@query(
    "t8_trim",
    f"""WITH {TEXTS_SQL} SELECT run_id, case_no, CASE WHEN regexp_matches(text, '(?i){K.VERDICT_END_PATTERN}')
      THEN regexp_extract(text, '(?is)^(.*?{K.VERDICT_END_PATTERN})', 1) ELSE text END AS trimmed FROM texts""",
)
def t8_trim(spark, d):
    texts = case_texts(run_cases(spark, d))
    return texts.select("run_id", "case_no", T.trim_at_verdict(F.col("text")).alias("trimmed"))


@query(
    "t9_cited_ids",
    f"WITH {ALL_TEXTS_SQL} SELECT text_id, array_to_string({_cited_sql(folded('text'))}, ',') AS ids FROM corpus",
)
def t9_cited_ids(spark, d):
    return all_texts(spark, d).select("text_id", T.cited_ids(F.col("text")).alias("ids")).select("text_id", _ids("ids"))


@query("t10_forbidden", f"WITH {_HITS_SQL} SELECT text_id, rule, term, topic FROM concepts")
def t10_forbidden(spark, d):
    return all_texts(spark, d).select(
        "text_id", F.inline(T.invented_concepts(F.lower("text")))
    ).select("text_id", "rule", "term", "topic")


_MARKERS = "{0}, len(regexp_extract_all({1}, '(?i){2}')) AS es, len(regexp_extract_all({1}, '(?i){3}')) AS en"


@query(
    "t11_language_drift",
    f"""WITH {ALL_TEXTS_SQL}, c AS (SELECT {_MARKERS.format('text_id', folded('text'), _words(K.SPANISH_WORDS), _words(K.ENGLISH_WORDS))} FROM corpus)
      SELECT text_id, es, en, en > es AS drift FROM c""",
)
def t11_language_drift(spark, d):
    es, en = T.marker_counts(F.col("text"))
    return all_texts(spark, d).select("text_id", es.alias("es"), en.alias("en")).withColumn(
        "drift", F.col("en") > F.col("es")
    )


# Known ids of a run: its case numbers and the ten after them.
UNIVERSE = 20


@query(
    "t13_audit",
    f"""WITH {_HITS_SQL}, a AS (SELECT text_id, text, case_ids, {_cited_sql(folded('text'))} AS cited,
        CASE WHEN text_id LIKE 'run:%' THEN range(1, {UNIVERSE + 1}) ELSE CAST([] AS BIGINT[]) END AS universe FROM corpus),
      k AS (SELECT text_id, string_agg(term, ';' ORDER BY rule) AS terms FROM concepts GROUP BY text_id),
      m AS (SELECT a.*, coalesce(terms, '') AS terms, [x for x in cited if NOT list_contains(universe, x)] AS inv,
        [x for x in cited if list_contains(universe, x) AND NOT list_contains(case_ids, x)] AS outs,
        [x for x in case_ids if list_contains(cited, x)] AS cov,
        len(regexp_extract_all({folded('text')}, '(?i){_words(K.ENGLISH_WORDS)}')) > len(regexp_extract_all({folded('text')}, '(?i){_words(K.SPANISH_WORDS)}')) AS en
        FROM a LEFT JOIN k USING (text_id))
      SELECT text_id, CASE WHEN len(inv) > 0 THEN '{K.AUDIT_INVENTED_IDS}' WHEN terms <> '' THEN '{K.AUDIT_INVENTED_CONCEPTS}'
        WHEN len(cov) < len(case_ids) THEN '{K.AUDIT_INCOMPLETE}' ELSE '{K.AUDIT_RELIABLE}' END AS audit,
        array_to_string(inv, ',') AS invented_ids, array_to_string(outs, ',') AS outside_ids, array_to_string(cov, ',') AS covered_ids,
        round(len(cov) / greatest(len(case_ids), 1e0), 9) AS coverage, terms,
        contains(text, '$') OR contains(lower(text), 'dolar') AS mentions_dollars, en AS wrong_language FROM m""",
)
def t13_audit(spark, d):
    known = F.when(
        F.col("text_id").startswith("run:"), F.sequence(F.lit(1).cast("bigint"), F.lit(UNIVERSE).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    out = audit.audit_reports(all_texts(spark, d).withColumn("universe", known), "text", "case_ids", "universe")
    return out.select(
        "text_id", "audit", _ids("invented_ids"), _ids("outside_ids"), _ids("covered_ids"),
        R("coverage", 9).alias("coverage"),
        F.array_join(F.transform("concepts", lambda c: c["term"]), ";").alias("terms"),
        "mentions_dollars", "wrong_language",
    )


def _triple(spark, d):
    """Three texts per run: the narrative, the final report, the trimmed investigation."""
    texts = case_texts(run_cases(spark, d)).withColumn("trimmed", T.trim_at_verdict(F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("case_no", "text", "trimmed", "k")))

    def joined(rows, field):
        return F.array_join(F.transform(rows, lambda t: t[field]), "\n")

    rows = texts.groupBy("run_id").agg(ordered.alias("_t"))
    return rows.select(
        "run_id",
        F.transform("_t", lambda t: t["case_no"].cast("bigint")).alias("case_ids"),
        joined(F.filter("_t", lambda t: t["k"] % 4 == 0), "text").alias("narrative"),
        joined(F.col("_t"), "text").alias("report"),
        joined(F.col("_t"), "trimmed").alias("investigation"),
    )


@query(
    "t14_coverage_levels",
    f"""WITH {TEXTS_SQL}, x AS (SELECT run_id, list(CAST(case_no AS BIGINT)) AS ids, coalesce(string_agg(text, chr(10) ORDER BY case_no) FILTER (k % 4 = 0), '') AS a,
        string_agg(text, chr(10) ORDER BY case_no) AS b, string_agg(CASE WHEN regexp_matches(text, '(?i){K.VERDICT_END_PATTERN}')
        THEN regexp_extract(text, '(?is)^(.*?{K.VERDICT_END_PATTERN})', 1) ELSE text END, chr(10) ORDER BY case_no) AS c FROM texts GROUP BY run_id)
      SELECT run_id, """
    + ", ".join(
        f"round(len(list_intersect(ids, {_cited_sql(c)})) / greatest(len(ids), 1e0), 9) AS {name}"
        for c, name in (("a", "coverage_narrative"), ("b", "coverage_report"), ("c", "coverage_investigation"))
    )
    + " FROM x",
)
def t14_coverage_levels(spark, d):
    names = {f"coverage_{c}": c for c in ("narrative", "report", "investigation")}
    out = audit.coverage_levels(_triple(spark, d), names, "case_ids")
    return out.select("run_id", *[R(c, 9).alias(c) for c in names])


_BODY = f"CASE WHEN regexp_matches(text, '(?i){K.VERDICT_CUT_PATTERN}') THEN regexp_extract(text, '(?is)^(.*?){K.VERDICT_CUT_PATTERN}', 1) ELSE text END"
_MENTION_SQL = f"""{_VERDICTS_SQL}, said AS (SELECT t.run_id, t.case_no, t.category, t.k, verdict,
  regexp_matches({_BODY}, '(?i){K.PROBE_PATTERN}') AND regexp_matches({_BODY}, '(?i){K.LATER_CHARGE_PATTERN}') AS mentions
  FROM texts t LEFT JOIN verdicts v ON t.run_id = v.run_id AND t.case_no = v.case_no)"""


def _said(spark, d):
    texts = case_texts(run_cases(spark, d)).join(_verdicts(spark, d), ["run_id", "case_no"], "left")
    return audit.contradictions(texts, "text", "verdict")


@query(
    "t15_contradiction",
    f"WITH {_MENTION_SQL} SELECT run_id, case_no, mentions, coalesce(mentions AND verdict = 'DESCARTADO', false) AS contradicts FROM said",
)
def t15_contradiction(spark, d):
    return _said(spark, d).select("run_id", "case_no", "mentions", "contradicts")


@query(
    "a7_contradiction_rate",
    f"""WITH {_MENTION_SQL}, c AS (SELECT category AS model, k < 50 AS condition, count(*) FILTER (mentions) AS n_mentions,
        count(*) FILTER (mentions AND verdict = 'DESCARTADO') AS n_contradictions FROM said GROUP BY 1, 2)
      SELECT model, condition, n_mentions, n_contradictions, round(n_contradictions / nullif(CAST(n_mentions AS DOUBLE), 0), 9) AS rate FROM c""",
)
def a7_contradiction_rate(spark, d):
    said = _said(spark, d).withColumns({"model": F.col("category"), "condition": F.col("k") < 50})
    return audit.contradiction_rate(said, ["model", "condition"]).withColumn("rate", R("rate", 9))


@query(
    "t16_prose",
    f"""WITH {TEXTS_SQL} SELECT run_id, case_no, CASE WHEN regexp_matches(text, '(?i){K.VERDICT_MARK_PATTERN}')
      THEN regexp_replace(regexp_extract(text, '(?is)^(.*?){K.VERDICT_MARK_PATTERN}', 1), '^\\s+|\\s+$', '', 'g') ELSE text END AS prose FROM texts""",
)
def t16_prose(spark, d):
    return case_texts(run_cases(spark, d)).select("run_id", "case_no", T.prose_of(F.col("text")).alias("prose"))


@query(
    "t17_output_flags",
    f"""WITH {ALL_TEXTS_SQL} SELECT text_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS short,
      length(text) >= 1000 AS truncated FROM corpus""",
)
def t17_output_flags(spark, d):
    # The stop reason is not stored in the tables; a text that fills 1,000 characters counts as cut.
    reason = F.when(F.length("text") >= 1000, "length").otherwise("stop")
    return all_texts(spark, d).select(
        "text_id", T.is_short(F.col("text")).alias("short"), (reason == "length").alias("truncated")
    )


# ---- set operations on cited ids ---------------------------------------------------

_CITED_ROWS_SQL = f"{REPORTS_SQL}, cited AS (SELECT run_id, case_ids, unnest({_cited_sql('text')}) AS id FROM reports)"


def _cited_rows(spark, d):
    return run_texts(spark, d).select("run_id", F.explode(T.cited_ids(F.col("text"))).alias("case_no"))


@query(
    "u1_invented",
    f"WITH {_CITED_ROWS_SQL} SELECT run_id, id AS case_no FROM cited WHERE id NOT BETWEEN 1 AND {UNIVERSE}",
)
def u1_invented(spark, d):
    # Table form: the universe is a table, here the case numbers a run may use.
    universe = run_cases(spark, d).select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(UNIVERSE).cast("bigint"))).alias("case_no")
    )
    return _cited_rows(spark, d).join(universe, ["run_id", "case_no"], "left_anti")


@query(
    "u2_outside",
    f"WITH {_CITED_ROWS_SQL} SELECT run_id, id AS case_no FROM cited WHERE id BETWEEN 1 AND {UNIVERSE} AND NOT list_contains(case_ids, id)",
)
def u2_outside(spark, d):
    known = _cited_rows(spark, d).filter(F.col("case_no").between(1, UNIVERSE))
    return known.join(run_cases(spark, d).select("run_id", "case_no"), ["run_id", "case_no"], "left_anti")


@query(
    "u3_coverage",
    f"""WITH {REPORTS_SQL}, c AS (SELECT run_id, case_ids, {_cited_sql('text')} AS cited FROM reports)
      SELECT run_id, array_to_string([x for x in case_ids if list_contains(cited, x)], ',') AS covered,
      round(len(list_intersect(case_ids, cited)) / greatest(len(case_ids), 1e0), 9) AS coverage FROM c""",
)
def u3_coverage(spark, d):
    t = run_texts(spark, d).withColumn(
        "covered", F.sort_array(F.array_intersect("case_ids", T.cited_ids(F.col("text"))))
    )
    return t.select(
        "run_id", _ids("covered"), R(S.ratio(F.size("covered"), F.size("case_ids")), 9).alias("coverage")
    )


# ---- joins and system measurement --------------------------------------------------


@query(
    "j1_case_lookup",
    f"""WITH {CASES_SQL}, asked AS (SELECT DISTINCT run_id, k % 15 AS case_no FROM runs)
      SELECT run_id, case_no, tx_id, tx_id IS NOT NULL AS known, CASE WHEN tx_id IS NULL THEN 'ERROR: no existe el caso ' || case_no END AS message
      FROM asked LEFT JOIN cases USING (run_id, case_no)""",
)
def j1_case_lookup(spark, d):
    asked = with_run(transactions(spark, d)).select("run_id", (F.col("k") % 15).alias("case_no")).distinct()
    return system.lookup_cases(asked, run_cases(spark, d), ["run_id"])


@query(
    "j2_verdict_label",
    f"WITH {_VERDICTS_SQL} SELECT run_id, case_no, verdict, tx_id, label FROM verdicts JOIN cases USING (run_id, case_no)",
)
def j2_verdict_label(spark, d):
    return system.labelled_verdicts(_verdicts(spark, d), run_cases(spark, d), ["run_id"])


_MISSED_SQL = f"""{CASES_SQL}, missed AS (SELECT * FROM runs WHERE label = 1 AND NOT EXISTS
  (SELECT 1 FROM cases c WHERE c.run_id = runs.run_id AND c.tx_id = runs.tx_id))"""


@query("j3_missed_positives", f"WITH {_MISSED_SQL} SELECT run_id, tx_id, amount FROM missed")
def j3_missed_positives(spark, d):
    batch = with_run(transactions(spark, d))
    return system.missed_positives(batch, run_cases(spark, d), ["run_id"]).select("run_id", "tx_id", "amount")


@query(
    "j4_missed_digest",
    f"""WITH {CASES_SQL}, file AS (SELECT * FROM runs WHERE prob >= 0.8e0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY prob DESC, tx_id) <= 10),
      missed AS (SELECT CAST(floor(run_id / 40e0) AS BIGINT) AS block, * FROM runs WHERE label = 1 AND NOT EXISTS
        (SELECT 1 FROM file c WHERE c.run_id = runs.run_id AND c.tx_id = runs.tx_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY amount DESC, tx_id) AS rk FROM missed)
      SELECT block, count(*) AS n_missed, string_agg(CAST(tx_id AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 8) AS top,
      count(*) FILTER (rk > 8) AS n_rest, round(coalesce(sum(amount) FILTER (rk > 8), 0), 6) AS rest, round(sum(amount), 6) AS total FROM r GROUP BY block""",
)
def j4_missed_digest(spark, d):
    # The case file of the high tier, at the full capacity of a run: what lies below the threshold is missed.
    batch = with_run(transactions(spark, d))
    file = selection.select_cases_by(batch, ["run_id"], "prob", "tx_id", 10, 0.8)
    missed = system.missed_positives(batch, file, ["run_id"]).withColumn("block", F.floor(F.col("run_id") / 40.0))
    digest = system.missed_digest(missed, ["block"], "amount")
    return digest.select(
        "block", "n_missed",
        F.array_join(F.transform("top", lambda t: t["tx_id"].cast("string")), ",").alias("top"),
        "n_rest", R("rest", 6).alias("rest"), R("total", 6).alias("total"),
    )


@query(
    "j7_completeness",
    f"""WITH {_VERDICTS_SQL}, v AS (SELECT run_id, count(*) AS n FROM verdicts GROUP BY run_id), c AS (SELECT run_id, count(*) AS n_cases FROM cases GROUP BY run_id)
      SELECT run_id, n_cases, coalesce(n, 0) AS n_verdicts, coalesce(n, 0) < n_cases AS excluded FROM c LEFT JOIN v USING (run_id)""",
)
def j7_completeness(spark, d):
    return system.completeness(run_cases(spark, d), _verdicts(spark, d), ["run_id"])


@query(
    "p14_action",
    f"""WITH {_VERDICTS_SQL} SELECT run_id, case_no, CASE verdict WHEN 'DESCARTADO' THEN 'Archivar' WHEN 'CONFIRMADO' THEN 'Bloquear tarjeta' ELSE 'Revisar manualmente' END AS action
      FROM cases LEFT JOIN verdicts USING (run_id, case_no)""",
)
def p14_action(spark, d):
    return system.recommended_actions(run_cases(spark, d), _verdicts(spark, d), ["run_id"]).select(
        "run_id", "case_no", "action"
    )


# Two conditions of the same case: the review text, and a second reader by parity.
_PAIRED_SQL = f"""{TEXTS_SQL}, one AS (SELECT run_id, case_no, label, 'completo' AS condition, CASE WHEN k % 4 = 0 OR k % 4 = 2 THEN
    CASE WHEN amount + k >= 130 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END ELSE CASE WHEN k % 4 = 1 THEN CASE WHEN amount + k >= 130 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END ELSE NULL END END AS verdict FROM texts
  UNION ALL SELECT run_id, case_no, label, 'reducido', CASE WHEN k % 2 = 0 THEN 'CONFIRMADO' ELSE 'DESCARTADO' END FROM texts)"""


def _paired(spark, d):
    texts = case_texts(run_cases(spark, d))
    # One text per case, so the pairs of that text hold at most its own verdict.
    own = F.element_at(T.verdict_pairs(F.regexp_replace("text", r"\*", "")), -1)
    rows = texts.withColumn("_v", F.when(F.size(T.verdict_pairs(F.col("text"))) > 0, own["verdict"]))
    full = rows.select("run_id", "case_no", "label", F.lit("completo").alias("condition"), F.col("_v").alias("verdict"))
    reduced = rows.select(
        "run_id", "case_no", "label", F.lit("reducido").alias("condition"),
        F.when(F.col("k") % 2 == 0, K.CONFIRMED).otherwise(K.DISMISSED).alias("verdict"),
    )
    return full.unionByName(reduced)


@query(
    "j8_verdict_flips",
    f"""WITH {_PAIRED_SQL} SELECT run_id, case_no, max(verdict) FILTER (condition = 'completo') AS completo, max(verdict) FILTER (condition = 'reducido') AS reducido,
      max(verdict) FILTER (condition = 'completo') IS DISTINCT FROM max(verdict) FILTER (condition = 'reducido') AS flips FROM one GROUP BY 1, 2""",
)
def j8_verdict_flips(spark, d):
    return system.verdict_flips(_paired(spark, d), ["run_id", "case_no"], "condition", ("completo", "reducido"))


_CONFUSION = """count(*) FILTER (label = 1 AND verdict = 'CONFIRMADO') AS positives_saved, count(*) FILTER (label = 1 AND verdict = 'DESCARTADO') AS positives_lost,
  count(*) FILTER (label = 0 AND verdict = 'DESCARTADO') AS controls_dropped, count(*) FILTER (label = 0 AND verdict = 'CONFIRMADO') AS controls_kept,
  count(*) FILTER (verdict IS NULL) AS without_verdict"""


@query("j9_condition_confusion", f"WITH {_PAIRED_SQL} SELECT run_id, condition, {_CONFUSION} FROM one GROUP BY 1, 2")
def j9_condition_confusion(spark, d):
    return system.condition_confusion(_paired(spark, d), ["run_id", "condition"])


@query(
    "a12_saved_vs_controls",
    f"WITH {_PAIRED_SQL}, c AS (SELECT condition, {_CONFUSION} FROM one GROUP BY 1) SELECT condition, positives_saved, controls_dropped FROM c",
)
def a12_saved_vs_controls(spark, d):
    return system.condition_confusion(_paired(spark, d), ["condition"]).select(
        "condition", "positives_saved", "controls_dropped"
    )


_MEASURE_SQL = f"""{_VERDICTS_SQL},
tot AS (SELECT run_id, count(*) AS n_batch, CAST(sum(label) AS BIGINT) AS positives FROM runs GROUP BY run_id),
modes(mode) AS (VALUES ('interpreta'), ('revisa')),
jv AS (SELECT mode, c.run_id, c.tx_id, c.label, CASE WHEN mode = 'revisa' THEN verdict END AS verdict FROM modes, cases c
  LEFT JOIN verdicts v ON c.run_id = v.run_id AND c.case_no = v.case_no),
pr AS (SELECT mode, run_id, count(*) AS n_cases, CAST(sum(label) AS BIGINT) AS raised, count(*) FILTER (verdict = 'DESCARTADO') AS nd,
  count(*) FILTER (verdict = 'DESCARTADO' AND label = 1) AS bad, count(*) FILTER (verdict = 'DESCARTADO' AND label = 0) AS good,
  string_agg(CAST(tx_id AS VARCHAR), ',' ORDER BY tx_id) FILTER (verdict = 'DESCARTADO' AND label = 1) AS ids FROM jv GROUP BY 1, 2),
cf AS (SELECT run_id, count(*) FILTER (verdict = 'CONFIRMADO') AS nc FROM verdicts GROUP BY run_id),
ms AS (SELECT t.run_id, m.mode, n_batch, positives, coalesce(n_cases, 0) AS n_cases, coalesce(raised, 0) AS positives_raised,
  coalesce(nd, 0) AS n_discarded, coalesce(bad, 0) AS n_destroyed, coalesce(good, 0) AS n_right_discards,
  CASE WHEN m.mode = 'revisa' THEN coalesce(nc, 0) ELSE 0 END AS n_confirmed, coalesce(ids, '') AS destroyed_ids
  FROM tot t CROSS JOIN modes m LEFT JOIN pr ON pr.run_id = t.run_id AND pr.mode = m.mode LEFT JOIN cf ON cf.run_id = t.run_id),
measured AS (SELECT *, positives - positives_raised AS n_missed, round(positives_raised / greatest(positives, 1e0), 9) AS recall_detector,
  round(positives_raised / greatest(n_cases, 1e0), 9) AS precision_detector,
  round((positives_raised - n_destroyed) / greatest(positives, 1e0), 9) AS recall_system,
  round((positives_raised - n_destroyed) / greatest(n_cases - n_discarded, 1e0), 9) AS precision_system FROM ms)"""


def _measured(spark, d):
    batch = with_run(transactions(spark, d)).select("run_id", "tx_id", "label")
    cases, verdicts = run_cases(spark, d), _verdicts(spark, d)
    return system.measure_system(batch, cases, None, ["run_id"], K.MODE_INTERPRET).unionByName(
        system.measure_system(batch, cases, verdicts, ["run_id"], K.MODE_REVIEW)
    )


@query("e5_system_measure", f"WITH {_MEASURE_SQL} SELECT * FROM measured")
def e5_system_measure(spark, d):
    m = _measured(spark, d)
    rates = ["recall_detector", "precision_detector", "recall_system", "precision_system"]
    return m.withColumns({c: R(c, 9) for c in rates}).withColumn(
        "destroyed_ids", F.array_join(F.transform("destroyed_ids", lambda x: x.cast("string")), ",")
    )


@query(
    "e6_destroyed_share",
    f"""WITH {_MEASURE_SQL} SELECT run_id, mode, round(CASE WHEN n_destroyed > 0 THEN n_destroyed / CAST(positives_raised AS DOUBLE) END, 9) AS destroyed_share FROM measured""",
)
def e6_destroyed_share(spark, d):
    return system.destroyed_share(_measured(spark, d)).select(
        "run_id", "mode", R("destroyed_share", 9).alias("destroyed_share")
    )


# ---- the review desk over one shift ------------------------------------------------

_DESK_SQL = f"""{TX}, o AS (SELECT *, row_number() OVER (ORDER BY t_sec, tx_id) - 1 AS rk, count(*) OVER () AS n FROM tx),
st AS (SELECT t_sec AS s FROM o WHERE rk = CAST(floor(n * 0.8e0) AS BIGINT)),
sh AS (SELECT o.* FROM o, st WHERE t_sec >= s AND t_sec < s + 86400e0),
f AS (SELECT *, row_number() OVER (ORDER BY prob DESC, tx_id) AS case_no, (SELECT count(*) FROM sh WHERE prob >= 0.7e0) >= 3 AS enough FROM sh)"""


def _desk(spark, d):
    # Only the shift's range is read, and explained against the mean of all rows.
    every = scored_transactions(spark, d)
    within = lambda seconds: explain.linear_contributions(scored_transactions(spark, d, seconds), WEIGHTS, every)
    return triage.triage_shift(every, hours=24.0, threshold=0.7, within=within)


@query(
    "z2_shift_request",
    f"""WITH {_DESK_SQL} SELECT case_no, tx_id, label, tier, CASE WHEN enough THEN 'threshold' ELSE 'fallback' END AS branch FROM f
      WHERE CASE WHEN enough THEN prob >= 0.7e0 AND case_no <= 10 ELSE case_no <= 10 END""",
)
def z2_shift_request(spark, d):
    return _desk(spark, d).cases.select("case_no", "tx_id", "label", "tier", "branch")


@query(
    "z1_tool_statistics",
    f"""WITH {_DESK_SQL} SELECT count(*) AS n_rows, count(*) FILTER (tier = 'ALTO') AS n_high, count(*) FILTER (tier = 'MEDIO') AS n_medium, count(*) FILTER (tier = 'BAJO') AS n_low,
      max(prob) AS prob_max, round(avg(prob), 9) AS prob_mean, round(sum(amount), 6) AS amount_total, round(avg(amount), 6) AS amount_mean, min(hour) AS hour_min, max(hour) AS hour_max, 'completo' AS level FROM sh""",
)
def z1_tool_statistics(spark, d):
    s = _desk(spark, d).statistics()
    return s.withColumns(
        {"prob_mean": R("prob_mean", 9), "amount_total": R("amount_total", 6), "amount_mean": R("amount_mean", 6)}
    )


@query(
    "z4_report_bundle",
    f"""WITH {_DESK_SQL}, c AS (SELECT * FROM f WHERE CASE WHEN enough THEN prob >= 0.7e0 AND case_no <= 10 ELSE case_no <= 10 END),
      g AS (SELECT count(*) AS n_cases, CAST(sum(label) AS BIGINT) AS positives_raised, count(*) FILTER (amount + k >= 150) AS n_confirmed, count(*) FILTER (amount + k < 150) AS n_discarded,
        count(*) FILTER (amount + k < 150 AND label = 1) AS n_destroyed FROM c)
      SELECT '{K.AUDIT_RELIABLE}' AS audit, n_cases, positives_raised, n_confirmed, n_discarded, n_destroyed, 0 AS n_without_verdict FROM g""",
)
def z4_report_bundle(spark, d):
    desk = _desk(spark, d)
    # The report under evaluation: one line and one verdict per case of the file.
    line = F.concat(
        F.lit("CASO "), F.col("case_no").cast("string"), F.lit("\nImporte revisado.\nVEREDICTO: "),
        F.when(F.col("amount") + F.col("k") >= 150, K.CONFIRMED).otherwise(K.DISMISSED),
    )
    ordered = F.sort_array(F.collect_list(F.struct("case_no", line.alias("line"))))
    report = desk.cases.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    return desk.evaluate_report(report).select(
        "audit", "n_cases", "positives_raised", "n_confirmed", "n_discarded", "n_destroyed", "n_without_verdict"
    )


@query(
    "z1_tool_prioritise",
    f"WITH {_DESK_SQL} SELECT case_no, prob, tier, amount, hour FROM f WHERE case_no <= 10",
)
def z1_tool_prioritise(spark, d):
    return _desk(spark, d).prioritise(10)


@query(
    "z3_case_detail",
    f"""WITH {_DESK_SQL}, {_CONTRIB_SQL}, {_LINES_SQL}, m AS (SELECT avg(amount) AS mean_amount FROM sh)
      SELECT case_no, tx_id, label, level, 'CASO ' || case_no || '{dossiers.NOTE}' || chr(10)
      || CASE level WHEN 'completo' THEN {_SCORE} || 'Nivel de riesgo: ' || tier || chr(10) WHEN 'sin_nivel' THEN {_SCORE} ELSE '' END
      || {_FACTS} || chr(10) || {_MEAN} AS dossier
      FROM f JOIN lines USING (tx_id), m, (VALUES ('completo'), ('sin_nivel'), ('ciego')) v(level) WHERE case_no = 2""",
)
def z3_case_detail(spark, d):
    desk = _desk(spark, d)
    views = [desk.case_detail(2, level).withColumn("level", F.lit(level)) for level in K.LEVELS]
    return reduce(DataFrame.unionByName, views)


@query(
    "z5_experiment_grid",
    """SELECT m AS model, o AS mode, s AS seed, r AS repetition, coalesce(n, 0) AS n_rows FROM (VALUES ('m_a'), ('m_b')) a(m), (VALUES ('interpreta'), ('revisa')) b(o), range(1, 4) c(s), range(1, 3) e(r)
      LEFT JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN 'm_a' ELSE 'm_b' END AS mm, event_id % 3 + 1 AS ss, count(*) AS n FROM events GROUP BY 1, 2) ON mm = m AND ss = s""",
)
def z5_experiment_grid(spark, d):
    grid = triage.experiment_grid(spark, ["m_a", "m_b"], [K.MODE_INTERPRET, K.MODE_REVIEW], [1, 2, 3], 2)
    tx = transactions(spark, d)
    outputs = tx.groupBy(
        F.when(F.col("card") % 2 == 0, "m_a").otherwise("m_b").alias("model"), (F.col("tx_id") % 3 + 1).cast("int").alias("seed")
    ).agg(F.count("*").alias("n_rows"))
    return grid.join(outputs, ["model", "seed"], "left").na.fill(0, ["n_rows"]).select(
        "model", "mode", "seed", "repetition", "n_rows"
    )
