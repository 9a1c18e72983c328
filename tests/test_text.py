import pytest
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text as T
from casemill.operators import audit, system

CASES, UNIVERSE = [11, 205, 318, 477], list(range(500))
TABLE = "| 205 | 1.0 |\n| 11 | 0.9 |\n| 477 | 0.8 |\n| 318 | 0.7 |\n"


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("r")).first().r


@pytest.mark.parametrize(
    "body, expected",
    [
        ("", K.AUDIT_RELIABLE),
        ("Conviene tener en cuenta la prevalencia del 100%.", K.AUDIT_RELIABLE),
        ("Son 4 casos, sin mencionar países ni comercios.", K.AUDIT_RELIABLE),
        ("Ante la falta de datos sobre el historial del cliente, se revisa.", K.AUDIT_RELIABLE),
        ("Se propone llamar al titular de la tarjeta.", K.AUDIT_RELIABLE),
        ("Without access to transaction history, the case stands.", K.AUDIT_RELIABLE),
        ("Los datos del titular apuntan a otra zona.", K.AUDIT_INVENTED_CONCEPTS),
        ("Hubo varios cargos en un corto período.", K.AUDIT_INVENTED_CONCEPTS),
        ("Procede de un país lejano.", K.AUDIT_INVENTED_CONCEPTS),
        ("It comes from a distant country.", K.AUDIT_INVENTED_CONCEPTS),
        ("Transacción ID: **31877** aparece en la lista de otro país.", K.AUDIT_INVENTED_IDS),
    ],
)
def test_report_audit(spark, body, expected):
    df = spark.createDataFrame([(TABLE + body, CASES, UNIVERSE)], "text string, c array<bigint>, u array<bigint>")
    r = audit.audit_reports(df, "text", "c", "u").first()
    assert r.audit == expected
    assert r.reliable == (expected == K.AUDIT_RELIABLE)
    assert r.coverage == 1.0


def test_incomplete_and_outside(spark):
    df = spark.createDataFrame([("CASO 11 y CASO 7", CASES, UNIVERSE)], "text string, c array<bigint>, u array<bigint>")
    r = audit.audit_reports(df, "text", "c", "u").first()
    assert (r.audit, r.outside_ids, r.covered_ids, r.coverage) == (K.AUDIT_INCOMPLETE, [7], [11], 0.25)


def test_negation_window_has_an_end(spark):
    near = "sin mencionar " + "x" * 100 + " un país"
    far = "sin mencionar " + "x" * 130 + " un país"
    assert _one(spark, near, lambda c: T.invented_concepts(F.lower(c))) == []
    (hit,) = _one(spark, far, lambda c: T.invented_concepts(F.lower(c)))
    assert (hit.rule, hit.term, hit.topic) == (0, "país", "geography")


def test_second_hit_counts_when_the_first_is_denied(spark):
    text = "no hay historial de cliente. " + "y" * 200 + " su historial de compras crece"
    (hit,) = _one(spark, text, lambda c: T.invented_concepts(F.lower(c)))
    assert hit.term == "historial de compras"


def test_stems_never_hide_a_hit(spark):
    texts = [
        "países", "ubicación", "la ubicacion", "establecimientos", "nombre del titular", "el titular reside", "número de cuenta",
        "cuenta bancaria", "historial de la actividad historial actividad", "transacciones previas", "corto periodo", "pocos minutos",
        "en cuestión de segundos", "countries", "geolocation", "vendor", "age of the customer", "cardholder lives",
        "card number", "bank account", "spending  history", "history of the transactions", "prior\ntransactions",
        "within seconds", "short window", "short time period",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    low = F.lower("text")
    rows = df.select("text", T.invented_concepts(low).alias("a"), T.invented_concepts(low, stems=None).alias("b")).collect()
    for r in rows:
        assert r.a == r.b and len(r.a) >= 1, r.text


@pytest.mark.parametrize(
    "text, ids",
    [
        ("CASO 3, CASO #4 y CASO **5**", [3, 4, 5]),
        ("Transacción 0 y Transaction ID: **31877**", [0, 31877]),
        ("ID: 205 frente a 99 casos", [205]),
        ("| **7** | 3 |\n  | 8 | 9 |", [7, 8]),
        ("se han visto 4 casos al 100%", []),
        ("CASE 12 or case 13", [12]),
        ("VALID: 5", []),
    ],
)
def test_cited_ids(spark, text, ids):
    assert _one(spark, text, T.cited_ids) == ids


def test_verdict_map_last_wins(spark):
    text = "CASO 1 a VEREDICTO: CONFIRMADO\ncase 2 b verdict: dismissed\nCASO 1 c VEREDICTO: DESCARTADO"
    df = spark.createDataFrame([(1, text)], "run int, text string")
    got = {r.case_no: r.verdict for r in system.extract_verdicts(df, ["run"], "text").collect()}
    assert got == {1: K.DISMISSED, 2: K.DISMISSED}


def test_trim_keeps_the_first_verdict(spark):
    assert _one(spark, "CASO 3 x\nVEREDICTO: CONFIRMADO CASO 4", T.trim_at_verdict) == "CASO 3 x\nVEREDICTO: CONFIRMADO"
    assert _one(spark, "CASO 3 abierto", T.trim_at_verdict) == "CASO 3 abierto"


def test_single_verdict_prose_and_flags(spark):
    assert _one(spark, "veredicto:  descartado", T.single_verdict) == K.DISMISSED
    assert _one(spark, "verdict: confirmed", T.single_verdict) == K.NO_VERDICT
    assert _one(spark, "\n una prosa \n\tVEREDICTO : x", T.prose_of) == "una prosa"
    assert _one(spark, " corto \n", T.is_short) is True


def test_pattern_mention_needs_both_families_before_the_verdict(spark):
    both = "Parece una prueba antes de realizar otro cargo. VEREDICTO: DESCARTADO"
    late = "Parece una prueba. VEREDICTO: DESCARTADO antes de realizar otro"
    assert _one(spark, both, T.mentions_test_charge) is True
    assert _one(spark, late, T.mentions_test_charge) is False
    # The stem inside word boundaries does not match longer words; kept as it is.
    assert _one(spark, "un tanteo antes de realizar otro", T.mentions_test_charge) is False


def test_language_drift_counts_unicode_words(spark):
    assert _one(spark, "The case is risk", T.drifts_to_english) is True
    assert _one(spark, "el caso es de riesgo the", T.drifts_to_english) is False
    es, en = spark.createDataFrame([("dé ñthe transacción",)], "t string").select(*T.marker_counts(F.col("t"))).first()
    assert (es, en) == (1, 0)
