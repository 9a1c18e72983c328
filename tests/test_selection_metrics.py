import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import bootstrap, metrics, selection, splits


def _scores(spark, probs, labels=None):
    labels = labels or [0] * len(probs)
    return spark.createDataFrame(
        [(i, p, y) for i, (p, y) in enumerate(zip(probs, labels))], "tx_id bigint, prob double, label int"
    )


@pytest.mark.parametrize(
    "options, expected, branch",
    [
        ({"threshold": 0.8}, 4, "fallback"),
        ({"threshold": 0.8, "fallback": "minimum"}, 3, "fallback"),
        ({"threshold": 0.8, "minimum": 0}, 2, "threshold"),
        ({"threshold": 0.95, "minimum": 0}, 0, None),
        ({"threshold": 0.2, "capacity": 2}, 2, "threshold"),
        ({"threshold": 0.2, "capacity": 0, "minimum": 0}, 0, None),
        ({}, 4, "fallback"),
    ],
)
def test_case_selection_branches(spark, options, expected, branch):
    df = _scores(spark, [0.5, 0.9, 0.3, 0.85])
    rows = selection.select_cases(df, "prob", "tx_id", **options).orderBy("case_no").collect()
    assert len(rows) == expected
    assert [r.case_no for r in rows] == list(range(1, expected + 1))
    assert [r.prob for r in rows] == sorted((r.prob for r in rows), reverse=True)
    assert {r.branch for r in rows} <= {branch}


def test_selection_per_group_equals_selection_alone(spark):
    rng = np.random.default_rng(3)
    df = _scores(spark, [round(float(x), 2) for x in rng.random(200)]).withColumn("g", F.col("tx_id") % 3)
    for minimum in (0, 3):
        grouped = selection.select_cases_by(df, ["g"], "prob", "tx_id", 5, 0.97, minimum).collect()
        for g in range(3):
            alone = selection.select_cases(df.filter(F.col("g") == g), "prob", "tx_id", 5, 0.97, minimum).collect()
            assert {(r.case_no, r.tx_id, r.branch) for r in grouped if r.g == g} == {
                (r.case_no, r.tx_id, r.branch) for r in alone
            }


def test_a_list_is_as_long_as_asked(spark):
    many = spark.range(900).selectExpr("id AS tx_id", "id / 1000.0 AS prob", "'x' AS tier", "1.0 AS amount", "2 AS hour")
    assert [selection.priority_list(many, "prob", "tx_id", n).count() for n in (-4, 0, 7, "12", 800)] == [1, 1, 7, 12, 800]


def test_levels_hide_columns(spark):
    df = _scores(spark, [0.9, 0.1]).withColumns({"tier": F.lit("ALTO"), "amount": F.lit(1.0), "hour": F.lit(2.0)})
    shown = {lv: selection.priority_list(df, "prob", "tx_id", 2, lv).columns for lv in ("completo", "sin_nivel", "ciego")}
    assert "tier" in shown["completo"] and "tier" not in shown["sin_nivel"] and "prob" not in shown["ciego"]
    with pytest.raises(ValueError):
        selection.priority_list(df, "prob", "tx_id", 2, "otro")


def test_areas_with_ties(spark):
    df = _scores(spark, [0.9, 0.8, 0.8, 0.1], [1, 0, 1, 0])
    r = metrics.curve_areas(df, "prob", "label").first()
    assert r.auc_pr == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert r.roc_auc == pytest.approx(0.875)
    c = metrics.confusion(df, "prob", "label", 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 0, 1)


def test_no_positives_has_no_area(spark):
    r = metrics.metric_block(_scores(spark, [0.9, 0.1]), "prob", "label", "tx_id").first()
    assert r.auc_pr is None and r.precision == 0 and r.hits_50 == 0 and r.precision_50 == 0


def _average_precision(s, y, w):
    order = np.argsort(-s, kind="stable")
    s, y, w = s[order], y[order], w[order]
    total, ap, cp, ca, i = (w * y).sum(), 0.0, 0.0, 0.0, 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        p = (w[i:j] * y[i:j]).sum()
        cp, ca = cp + p, ca + w[i:j].sum()
        if p:
            ap += p / total * cp / ca
        i = j
    return ap


def test_bootstrap_equals_weighted_brute_force(spark):
    rng = np.random.default_rng(5)
    n, b = 400, 6
    s, y = np.round(rng.random(n), 1), (rng.random(n) < 0.2).astype(int)
    df = _scores(spark, [float(x) for x in s], [int(v) for v in y]).withColumn("other", 1 - F.col("prob"))
    # A small Arrow batch and few partitions force ties across batch and task borders.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = bootstrap.replicate_precision(df, {"a": "prob", "b": "other"}, "label", "tx_id", b).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.m, r.rep): r.auc_pr for r in rows}
    h = np.array([int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) % bootstrap.PRIME for i in range(n)])
    for rep, (mul, add) in enumerate(bootstrap.multipliers(b)):
        u = (h * mul + add) % bootstrap.PRIME
        w = np.searchsorted(np.array(bootstrap.STEPS), u, side="right").astype(float)
        w[y == 1] *= y.sum() / w[y == 1].sum()
        w[y == 0] *= (y == 0).sum() / w[y == 0].sum()
        assert got["a", rep] == pytest.approx(_average_precision(s, y, w), abs=1e-12)
        assert got["b", rep] == pytest.approx(_average_precision(1 - s, y, w), abs=1e-12)


def test_recall_is_monotone_in_threshold(spark, folder):
    from casemill.sources.tables import transactions

    tx = transactions(spark, folder).cache()
    recalls = [metrics.confusion(tx, "prob", "label", t).first().recall for t in (0.2, 0.5, 0.8)]
    assert recalls == sorted(recalls, reverse=True)
    split = splits.temporal_split(tx, "t_sec", "tx_id")
    assert split.filter("split = 'train'").count() == int(tx.count() * 0.8)
