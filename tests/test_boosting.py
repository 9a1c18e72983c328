import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators import boosting, models, splits
from casemill.plans import models as plans

COLS = ["a", "k", "f"]
WHOLE = {"subsample": 1.0, "colsample": 1.0}  # nothing is drawn


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    n = 2_000
    a, k, f = rng.exponential(50, n).round(2), rng.integers(0, 100, n), rng.integers(0, 2, n)
    noise = rng.random(n) < 0.02
    data = [(i, int((f[i] and a[i] + k[i] >= 110) or noise[i]), float(a[i]), int(k[i]), float(f[i])) for i in range(n)]
    return spark.createDataFrame(data, "id int, y int, a double, k int, f double").repartition(4).localCheckpoint()


def _scores(model, rows):
    return models.score(model, rows, COLS).select("id", "prob").toPandas().sort_values("id")["prob"].to_numpy()


@pytest.mark.parametrize(
    "size",
    [
        {"n_estimators": 8, "max_depth": 4},
        {"n_estimators": 4, "max_depth": 7, "learning_rate": 0.3, "min_child_weight": 10},
        {"n_estimators": 4, "max_depth": 5, "gamma": 0.1, "pos_weight": 1.0},
    ],
)
def test_a_task_grows_the_trees_of_mllib(spark, rows, monkeypatch, size):
    found = []
    for most in (1 << 22, 0):
        monkeypatch.setattr(models, "IN_TASK", most)
        found.append(models.train_boosted(rows, COLS, "y", **size, **WHOLE))
    one, other = found
    assert one.getNumTrees == other.getNumTrees == size["n_estimators"] and one.treeWeights == other.treeWeights
    told = [{p.name: m.getOrDefault(p) for p in m.params if m.isDefined(p)} for m in found]
    assert told[0] == told[1]
    assert _scores(one, rows) == pytest.approx(_scores(other, rows), abs=1e-9)


def test_rows_of_a_cell_are_drawn_one_by_one():
    counts = np.array([0, 1, 1, 40_000] * 500)
    taken = boosting._drawn(np.random.default_rng(3), counts, 0.6)
    assert (taken <= counts).all() and taken[::4].sum() == 0
    assert taken[1::2].max() < 25_000 and abs(taken.sum() / counts.sum() - 0.6) < 0.001
    assert abs(taken[1::4].mean() - 0.6) < 0.1


def test_merged_rows_fit_like_rows_one_by_one():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (900, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=900) > 7).astype(float)
    seen, n = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    size = boosting.Size(6, 4, 0.1, 1.0, 3, 5, 0.0, 42)
    held = (x, y, np.ones(900))
    one = boosting.search_fit(held, held, size, 3.0)
    assert one == pytest.approx(boosting.search_fit((seen[:, :3], seen[:, 3], n.astype(float)), held, size, 3.0), abs=1e-12)
    assert one > 2 * y.mean()


def test_average_precision_of_tied_scores():
    assert boosting.average_precision(np.array([0.9, 0.5, 0.5, 0.1]), np.array([1, 0, 1, 0]), np.ones(4)) == pytest.approx((1 + 2 / 3) / 2)
    assert boosting.average_precision(np.array([0.9, 0.5]), np.zeros(2), np.ones(2)) == 0.0


@pytest.mark.parametrize("change", [None, float("nan")])
def test_rows_without_a_value_are_an_error(rows, change):
    holes = rows.withColumn("a", F.when(F.col("k") == 7, F.lit(change)).otherwise(F.col("a")))
    with pytest.raises(Exception, match="null or NaN"):
        models.train_boosted(holes, COLS, "y", n_estimators=2)


@pytest.mark.parametrize("cell_rows", [1 << 17, 300])
def test_a_search_in_tasks_finds_what_fits_side_by_side_find(spark, rows, monkeypatch, cell_rows):
    monkeypatch.setattr(models, "CELL_ROWS", cell_rows)
    space = {"n_estimators": [2, 4], "max_depth": [3, 5], "min_child_weight": [1], **{k: [v] for k, v in WHOLE.items()}}
    folded = splits.stratified_folds(rows, "y", "id", 2)
    found = []
    for most in (1 << 22, 0):
        monkeypatch.setattr(models, "IN_TASK", most)
        found.append(models.random_search(rows, rows, folded, "fold", 2, False, COLS, "y", space, {"n_estimators": 3, **WHOLE}, 3))
    one, other = found
    assert one["n_draws"] == other["n_draws"] == 3
    # Parts of a cell leave splits of equal gain to the last digit of the sums.
    near = 1e-9 if cell_rows > 2_000 else 0.02
    for name in ("auc_pr_cv", "auc_pr_reference", "auc_pr_tuned"):
        assert one[name] == pytest.approx(other[name], abs=near), name


def test_cells_of_judged_rows_score_like_the_rows(rows):
    cells = models.training_cells(rows.filter("id < 1200"), COLS, "y", cell_rows=300)
    held = rows.filter("id >= 1000").withColumn("_rows", F.lit(1.0))
    [(learnt, counted)] = models._fold_arrays([cells], [held], COLS, "y")
    assert len(counted[1]) < counted[2].sum() == 1_000
    size = boosting.Size(5, 4, 0.1, 0.8, 2, 1, 0.0, 42)
    plain = boosting.arrays(held.toArrow(), COLS, "y", "_rows")
    assert boosting.search_fit(learnt, counted, size, 2.0) == pytest.approx(boosting.search_fit(learnt, plain, size, 2.0), abs=1e-12)


def test_the_search_has_its_published_size(spark, folder, monkeypatch):
    seen = []

    def search(train, test, folded, column, k, past_only, cols, label, **size):
        seen.append((k, past_only, size, folded.count() == train.count()))
        return {"best": next(models.draws(size["space"], 1)), "n_draws": size["n_draws"], "auc_pr_cv": 1.0, "auc_pr_reference": 1.0, "auc_pr_tuned": 1.0, "gain": 0.0}

    monkeypatch.setattr(models, "random_search", search)
    plans.m7_param_search(spark, folder)
    size = {"space": K.SEARCH_SPACE, "base": K.SEARCH_BASE, "n_draws": 50}
    assert seen == [(3, False, size, True), (3, True, size, True)]


def test_the_imbalance_ablation_trains_at_its_published_size(spark, folder, monkeypatch):
    fit, seen = models.train_boosted, []

    def note(*args, **kwargs):
        given = inspect.signature(fit).bind(*args, **kwargs)
        given.apply_defaults()
        seen.append((given.arguments["n_estimators"], given.arguments["max_depth"], given.arguments["pos_weight"]))
        return fit(*args, **kwargs | {"n_estimators": 2})

    monkeypatch.setattr(models, "train_boosted", note)
    assert plans.m9_imbalance_ablation(spark, folder).count() == 5
    assert sorted(seen, key=str) == [(400, 5, 1.0)] * 3 + [(400, 5, None)]
