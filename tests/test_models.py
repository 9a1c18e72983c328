import itertools
import tracemalloc
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import anomaly, explain, models, oversample, trees
from casemill.sources.tables import embedding_rows


def _rows(spark, x):
    cols = [f"c{j}" for j in range(x.shape[1])]
    data = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id bigint, " + ", ".join(f"{c} double" for c in cols)), cols


def _brute_neighbours(x, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[i] = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], j))[:k]
    return out


@pytest.mark.parametrize("how", [{"method": "exact"}, {"method": "exact", "block_rows": 16}, {}])
def test_neighbours_match_brute_force(spark, how):
    x = np.random.default_rng(7).normal(size=(150, 3))
    x[100:130] = x[100]  # thirty copies of one row
    df, cols = _rows(spark, x)
    got = {r.id: r.neighbours for r in oversample.nearest_neighbours(df, "id", cols, 5, **how).collect()}
    assert got == _brute_neighbours(x, 5)


def _recall(x, found, rows):
    near = ((x[rows] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[rows] @ x.T).copy()
    near[np.arange(len(rows)), rows] = np.inf
    true = np.argpartition(near, 5, axis=1)[:, :5]
    return np.mean([len(set(t.tolist()) & set(found[int(i)])) / 5 for i, t in zip(rows, true)])


def _pairs(spark, x, **how):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(8)
    sizes = oversample.hash_buckets(df, x.shape[1], **how).groupBy("table", "bucket").count()
    total, most, rows = sizes.agg(F.sum(F.col("count") ** 2), F.max("count"), F.sum("count")).first()
    assert rows == len(x) * how["tables"]
    return total, most


def test_buckets_are_bounded_whatever_the_data(spark):
    rng = np.random.default_rng(11)
    normal = rng.normal(size=(4000, 6))
    heavy = np.concatenate([normal[:2000] * 1e-3, normal[2000:] * 1e3 ** rng.random((2000, 1))])
    for x in (normal, heavy, np.exp(4 * normal)):
        assert _pairs(spark, x, tables=3, bucket_rows=100)[1] <= 100


def test_compared_pairs_grow_with_the_rows(spark):
    x = np.random.default_rng(12).normal(size=(40_000, 8))
    few, many = (_pairs(spark, x[:n], tables=4, bucket_rows=256)[0] for n in (4_000, 40_000))
    assert 7 < many / few < 14


def test_hashed_neighbours_beside_exact_ones(spark):
    rng = np.random.default_rng(13)
    plain = rng.normal(size=(12_000, 30))
    for x in (plain * np.linspace(2, 0.3, 30), plain):
        df, cols = _rows(spark, x)
        found = {r.id: r.neighbours for r in oversample.nearest_neighbours(df.repartition(8), "id", cols).collect()}
        assert len(found) == len(x) and all(len(v) == 5 and i not in v for i, v in found.items())
        assert _recall(x, found, rng.choice(len(x), 400, replace=False)) >= 0.95


def test_oversampling_balances_and_interpolates(spark):
    x = np.random.default_rng(8).normal(size=(60, 2))
    df, cols = _rows(spark, x)
    df = df.withColumn("y", (F.col("id") < 13).cast("int"))
    made = oversample.oversample(df, "y", "id", cols).collect()
    assert len(made) == 60 - 2 * 13
    near = _brute_neighbours(x[:13], 5)
    for r in made:
        assert r.neighbour in near[r.parent] and 0 <= r.lam < 1
        expected = x[r.parent] + r.lam * (x[r.neighbour] - x[r.parent])
        assert [r.c0, r.c1] == pytest.approx(list(expected))
    assert len({r.id for r in made}) == len(made) and min(r.id for r in made) >= 60
    assert max(np.unique([r.parent for r in made], return_counts=True)[1]) - min(
        np.unique([r.parent for r in made], return_counts=True)[1]
    ) <= 1


def _random_tree(rng, depth, features):
    """A tree whose covers are consistent; features repeat along paths."""
    left, right, feature, threshold, cover, value = [], [], [], [], [], []

    def grow(d, n):
        k = len(left)
        for column, v in ((left, -1), (right, -1), (feature, -1), (threshold, 0.0), (cover, n), (value, rng.normal())):
            column.append(v)
        if d and rng.random() < 0.9:
            part = n * rng.uniform(0.02, 0.98)
            feature[k], threshold[k] = int(rng.integers(features)), rng.normal()
            left[k] = grow(d - 1, part)
            right[k] = grow(d - 1, n - part)
        return k

    grow(depth, 100.0)
    return trees.Tree(*map(np.array, (left, right, feature, threshold, cover, value)))


def test_tree_values_are_shapley_values():
    rng = np.random.default_rng(21)
    for depth in (0, 1, 3, 5):
        tree, x = _random_tree(rng, depth, 4), rng.normal(size=(6, 4))

        def game(row, subset, node=0):
            if tree.left[node] < 0:
                return tree.value[node]
            f = tree.feature[node]
            sides = tree.left[node], tree.right[node]
            if f in subset:
                return game(row, subset, sides[0] if row[f] <= tree.threshold[node] else sides[1])
            return sum(tree.cover[c] / tree.cover[node] * game(row, subset, c) for c in sides)

        got = trees.tree_values(x, tree)
        for r, row in enumerate(x):
            for f in range(4):
                others = [g for g in range(4) if g != f]
                phi = sum(
                    (game(row, {*s, f}) - game(row, set(s))) / (4 * comb(3, k))
                    for k in range(4) for s in itertools.combinations(others, k)
                )
                assert got[r, f] == pytest.approx(phi, abs=1e-9)
            assert got[r].sum() + tree.expected() == pytest.approx(game(row, set(range(4))), abs=1e-9)


def test_tree_contributions_add_up(spark, folder):
    rows = embedding_rows(spark, folder)
    cols = ["V1", "V2", "V3", "Amount"]
    model = models.train_boosted(rows, cols, n_estimators=4, max_depth=3)
    scored = models.score(model, rows, cols).limit(50)
    for r in trees.tree_contributions(model, scored, cols).collect():
        margin = np.log(r.prob / (1 - r.prob))
        assert sum(c.contrib for c in r.contributions) + r.bias == pytest.approx(margin, abs=1e-6)


def test_linear_contributions_and_bias_rank(spark):
    df, _ = _rows(spark, np.array([[1.0, 5.0], [3.0, 1.0]]))
    out = explain.linear_contributions(df, {"c0": 2.0, "c1": -1.0})
    for r in out.withColumn("top", explain.ranked(F.col("contributions"), 3, F.col("bias"))).collect():
        assert sum(c.contrib for c in r.contributions) + r.bias == pytest.approx(r.margin)
        sizes = [abs(c.contrib) for c in r.top]
        assert sizes == sorted(sizes, reverse=True) and explain.BIAS in [c["var"] for c in r.top]


def test_masked_names_count_in_rank_order(spark):
    df = spark.createDataFrame([([("a", 1.0, 3.0), ("x", 1.0, 2.0), ("b", 1.0, 1.0)],)], "e array<struct<var:string,value:double,contrib:double>>")
    masked = df.select(explain.masked_names(F.col("e"), ["b"], ["a"]).alias("m")).first().m
    assert [m["var"] for m in masked] == ["var_1", "x", "var_2"]


@pytest.mark.parametrize("n_trees, sample", [(30, 64), (40, 7)])
def test_isolation_forest_finds_the_far_row(spark, n_trees, sample):
    x = np.random.default_rng(9).normal(size=(300, 3))
    x[17] = 12.0
    df, cols = _rows(spark, x)
    forest = anomaly.fit_isolation_forest(df, cols, "id", n_trees, sample)
    rows = forest.score(df).collect()
    # The second case deals a full pool out to the trees; so few rows leave some noise.
    best = sorted(rows, key=lambda r: -r.score_anomalia)[:15]
    assert 17 in {r.id for r in best}
    assert min(r.score_anomalia for r in rows) == 0.0 and max(r.score_anomalia for r in rows) == 1.0
    again = anomaly.fit_isolation_forest(df, cols, "id", n_trees, sample).score(df).collect()
    assert sorted(r.score_anomalia for r in again) == sorted(r.score_anomalia for r in rows)


def test_draws_are_reproducible():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    assert list(models.draws(space, 4)) == list(models.draws(space, 4))
    assert all(p["a"] in space["a"] and p["b"] in space["b"] for p in models.draws(space, 20))


def _labelled(spark, n):
    rng = np.random.default_rng(21)
    a, k, f = rng.exponential(50, n).round(2), rng.integers(0, 100, n), rng.integers(0, 2, n)
    data = [(int(f1 and a1 + k1 >= 150), float(a1), int(k1), float(f1)) for a1, k1, f1 in zip(a, k, f)]
    return spark.createDataFrame(data, "y int, a double, k int, f double").repartition(4).localCheckpoint()


def test_training_rows_are_bounded_by_cells(spark):
    rows = _labelled(spark, 6_000)
    cells = models.training_cells(rows, ["a", "k", "f"], "y", cell_rows=500)
    assert models._class_rows(cells, "y") == {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert all(cells.select(c).distinct().count() <= 32 for c in ("a", "k", "f"))
    many = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20))))
    more = models.training_cells(many, ["a", "k", "f"], "y", cell_rows=500)
    assert more.agg(F.sum("_rows")).first()[0] == pytest.approx(120_000)
    assert more.count() <= cells.select("y", "a", "k", "f").distinct().count() + 500 + 32  # no growth with the rows
    plain = models.training_cells(rows, ["a", "k", "f"], "y")
    assert plain.count() == 6_000 and plain.filter("_rows <> 1").isEmpty()


def test_cells_train_like_rows(spark, monkeypatch):
    cols, rows = ["a", "k", "f"], _labelled(spark, 6_000)
    size = {"n_estimators": 5, "max_depth": 4, "subsample": 1.0, "colsample": 1.0}
    found = []
    for most in (1 << 17, 500):
        monkeypatch.setattr(models, "CELL_ROWS", most)
        found.append(models.average_precision(models.train_boosted(rows, cols, "y", **size), rows, cols, "y"))
    assert min(found) > 0.9 and abs(found[0] - found[1]) < 0.03


def test_cells_leave_nulls_to_the_assembler(spark):
    rows = _labelled(spark, 800).withColumn("a", F.when(F.col("k") == 7, None).otherwise(F.col("a")))
    cells = models.training_cells(rows, ["a", "k", "f"], "y", cell_rows=100)
    held = cells.filter("a IS NULL").agg(F.sum("_rows")).first()[0]
    assert held == rows.filter("a IS NULL").count() > 0


def test_a_tree_walks_one_row_of_a_cell(monkeypatch):
    node = trees.Tree(
        np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 1, -1, -1, -1]),
        np.array([0.5, 2.0, 0.0, 0.0, 0.0]), np.array([10.0, 6.0, 4.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, -2.0, 3.0]),
    )
    x = np.random.default_rng(5).normal(size=(5_000, 3))
    x[:4] = [[0.5, 2.0, 0], [np.nan, 2.0, 0], [0.5, np.nan, 0], [np.inf, -np.inf, 0]]
    whole, seen, walk = trees._walk(x, node), [], trees._walk
    monkeypatch.setattr(trees, "_walk", lambda rows, tree: seen.append(len(rows)) or walk(rows, tree))
    assert (trees.tree_values(x, node) == whole).all() and max(seen) <= 4
    assert trees.tree_values(x[:0], node).shape == (0, 3)


def test_blocks_meet_in_bounded_memory():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3_000, 6))
    b[5], b[6] = np.nan, b[7]
    tracemalloc.start()
    got = oversample._best(a, np.arange(3_000), b, np.arange(1_000, 4_000), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    found = got.groupby("id")["nb"].apply(list)
    for i in range(0, 3_000, 50):
        d = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((np.arange(3_000), d)) if j + 1_000 != i and np.isfinite(d[j])][:3]
        assert found[i] == [j + 1_000 for j in near]
