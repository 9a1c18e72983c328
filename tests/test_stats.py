import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemill.operators import runs, stats


def test_fisher_golden(spark):
    df = spark.createDataFrame([("r", 6, 12, 0, 18), ("same", 5, 5, 5, 5), ("empty", 0, 9, 0, 9)], "k string, a int, b int, c int, d int")
    got = {r.k: r.p_value for r in stats.fisher_exact(df, ["k"], "a", "b", "c", "d").collect()}
    assert got["r"] == pytest.approx(0.01906158, abs=1e-8)
    assert got["same"] == pytest.approx(1.0) and got["empty"] == pytest.approx(1.0)


def _pairs(spark, diffs, group="g"):
    return spark.createDataFrame([(group, float(d)) for d in diffs], "g string, d double")


GOLDEN = [0.0] * 12 + [-0.19999999999999996] * 4 + [-0.20000000000000007, -0.4]


def test_wilcoxon_golden_on_raw_doubles(spark):
    r = stats.wilcoxon(_pairs(spark, GOLDEN), "d", ["g"]).first()
    assert (r.n_pairs, r.n_worse, r.n_zero) == (18, 6, 12)
    assert r.p_value == pytest.approx(0.02354410, abs=1e-8)
    rounded = stats.wilcoxon(_pairs(spark, GOLDEN), "d", ["g"], tie_round=6).first()
    assert rounded.p_value == pytest.approx(0.01963066, abs=1e-8)


def test_wilcoxon_exact_matches_enumeration(spark):
    diffs = [0.5, -1.1, 2.3, 3.7, -0.2, 4.4, 5.9]
    order = sorted(diffs, key=abs)
    t = min(sum(i + 1 for i, d in enumerate(order) if d > 0), sum(i + 1 for i, d in enumerate(order) if d < 0))
    sums = [sum((i + 1) * s for i, s in enumerate(signs)) for signs in itertools.product((0, 1), repeat=7)]
    expected = min(1.0, 2 * sum(s <= t for s in sums) / 2**7)
    assert stats.wilcoxon(_pairs(spark, diffs), "d", ["g"]).first().p_value == pytest.approx(expected)


def test_wilcoxon_all_zero_has_no_p(spark):
    assert stats.wilcoxon(_pairs(spark, [0.0, 0.0]), "d", ["g"]).first().p_value is None


def test_erfc(spark):
    xs = [0.0, 0.3, 1.0, 2.2, 2.999, 3.0, 4.5, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", stats.erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-8, abs=1e-14)


def test_cost_dispersion_is_the_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 1.0, 9.0, 2.0)], "m string, s double")
    r = runs.cost_dispersion(df, ["m"], "s").first()
    assert (r.upper_median, r.low, r.high, r.dispersion) == (4.0, 1.0, 9.0, 9.0)


def test_run_table_single_run_has_zero_deviation(spark):
    df = spark.createDataFrame(
        [("a", "revisa", 0.5, 0.4, 1, True, 3.0)],
        "model string, mode string, recall_detector double, recall_system double, n_destroyed int, reliable boolean, seconds double",
    )
    assert runs.run_table(df).first().recall_detector_sd == 0.0


def test_grid(spark):
    assert runs.experiment_grid(spark, ["a", "b"], ["x", "y"], [1, 2, 3], 2).count() == 24


def test_weights_are_those_of_the_remainders():
    from casemill.operators import bootstrap

    rng = np.random.default_rng(3)
    h = np.append(rng.integers(0, bootstrap.PRIME, 500), [0, 1, bootstrap.PRIME - 1])
    mul, add = rng.integers(1, bootstrap.PRIME, 70), rng.integers(0, bootstrap.PRIME, 70)
    mul[:3], add[:3] = [1, 1, bootstrap.PRIME - 1], [0, bootstrap.PRIME - 1, bootstrap.PRIME - 1]
    add[3:14], mul[3:14] = np.array(bootstrap.STEPS), 1
    u = (h[:, None] * mul + add) % bootstrap.PRIME
    assert (bootstrap._weights(h, mul, add) == np.searchsorted(bootstrap.STEPS, u, side="right")).all()


def test_rows_are_weighed_in_pieces(monkeypatch):
    from casemill.operators import bootstrap

    seen, weigh = [], bootstrap._weights
    monkeypatch.setattr(bootstrap, "_weights", lambda h, *of: seen.append(len(h)) or weigh(h, *of))
    n = 3_000
    rows = pd.DataFrame({"p": 0, "m": "a", "s": np.arange(n)[::-1] // 2 / n, "y": np.arange(n) % 40 == 0, "h": np.arange(n) * 7919})
    pairs = np.array(bootstrap.multipliers(10), dtype=np.int64)
    out = pd.concat(bootstrap._sums(pairs)(iter([rows])))
    assert max(seen) <= 1024
    w = weigh(rows["h"].to_numpy(), pairs[:, 0], pairs[:, 1])
    assert (np.sum(out["pos"].tolist(), axis=0) == w[rows["y"].to_numpy()].sum(axis=0)).all()
