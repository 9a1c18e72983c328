import pytest

from casemill.operators import explain
from casemill.plans.triage import Triage, triage_shift
from casemill.sources.tables import scored_transactions


@pytest.fixture(scope="module")
def desk(spark, folder):
    scored = explain.linear_contributions(scored_transactions(spark, folder), {"amount": 0.02, "k": 0.01})
    return triage_shift(scored, hours=100.0, threshold=0.7, capacity=6)


def test_error_texts(desk):
    assert desk.explain("abc").startswith("ERROR")
    assert "del 1 al" in desk.explain(999)
    assert desk.explain("1").startswith("Transaccion #")


def test_detail_follows_the_level(desk):
    full = desk.case_detail(1).first().dossier
    blind = desk.case_detail(1, "ciego").first().dossier
    assert "Nivel de riesgo" in full and "Probabilidad" not in blind
    with pytest.raises(ValueError):
        Triage(desk.scored, level="nada")


def test_bundle_measures_the_selected_file(spark, desk):
    n = desk.cases.count()
    text = "\n".join(f"CASO {i}\nx\nVEREDICTO: {'DESCARTADO' if i == 1 else 'CONFIRMADO'}" for i in range(1, n))
    r = desk.evaluate_report(spark.createDataFrame([(text,)], "text string")).first()
    assert r.n_cases == n and r.n_without_verdict == 1 and r.n_discarded == 1
    assert r.recall_system <= r.recall_detector
    plain = desk.measurement().first()
    assert plain.recall_system == plain.recall_detector and plain.n_discarded == 0
    assert desk.dossier().first().n_cases == n
    assert desk.summary().first().n_rows == desk.scored.count()
    assert desk.prioritise(3).count() == 3


def test_empty_shift_is_an_error(spark, folder):
    with pytest.raises(ValueError):
        triage_shift(scored_transactions(spark, folder), hours=1.0, offset_h=1e6)


def test_no_unpartitioned_window_over_the_table(spark, folder):
    """A window without a partition key may only see limited lists or bucket totals."""
    from casemill.plans import catalog

    for name in ("d1_temporal_split", "d2_stratified_split", "a9_ecdf", "x4_latency", "e5_system_measure", "x5_occupancy"):
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        for line in (x for x in plan.splitlines() if "windowspecdefinition(" in x):
            first = line.split("windowspecdefinition(")[1].split(",")[0]
            assert "ASC" not in first and "DESC" not in first, (name, line)
