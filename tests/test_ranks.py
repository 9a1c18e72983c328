import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.operators import profile, ranks, splits


def _frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([-3.5, 0.0, 0.1, 0.1 + 1e-12, 2.0, 1e6]), min_size=1, max_size=40))
def test_order_statistics_match_sort(spark, values):
    order = sorted((v, i) for i, v in enumerate(values))
    picks = sorted({0, len(order) // 2, len(order) - 1})
    found = ranks.order_statistics(_frame(spark, values), ["x", "id"], [(None, r) for r in picks])
    assert found == [order[r] for r in picks]


@pytest.fixture()
def narrow(monkeypatch):
    """Small inputs go through the sketch, the counts of sides and several cuts."""
    monkeypatch.setattr(ranks, "_TAKE", 3)
    monkeypatch.setattr(ranks, "_HISTOGRAM", 4)


def test_order_statistics_narrow_large_groups(spark, narrow):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    found = ranks.order_statistics(df, ["x", "id"], [(None, 500), (F.col("x") == 6, 3), (None, lambda n: n - 1), (None, lambda n: None)])
    order = sorted((i % 7, i) for i in range(1000))
    assert found == [order[500], (6, 27), order[-1], None]


@pytest.mark.parametrize("error", [0.004, 0.0])
def test_order_statistics_survive_a_sketch_that_misses(spark, narrow, monkeypatch, error):
    monkeypatch.setattr(ranks, "_SKETCH_ERROR", error)
    monkeypatch.setattr(ranks, "_SKETCH_K", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.normal(size=500) * 1e9, [5e-324, 1e-323, -1e300, 1e300]])
    df = _frame(spark, x).repartition(5)
    order = sorted((v, i) for i, v in enumerate(x))
    picks = [0, 1, 100, 3000, 3600, 5000, 6400, len(x) - 1]
    assert ranks.order_statistics(df, ["x", "id"], [(None, r) for r in picks]) == [order[r] for r in picks]


def test_order_statistics_of_far_integers(spark, narrow):
    values = [-(1 << 63), -(1 << 63) + 1, -7, 0, 1, 2, 3, (1 << 62) + 1, (1 << 62) + 2, (1 << 62) + 3, (1 << 62) + 4, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert ranks.order_statistics(df, ["x"], [(None, r) for r in range(len(values))]) == [(v,) for v in values]


def test_missing_keys_have_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id bigint, x double")
    assert ranks.order_statistics(df, ["x", "id"], [(None, 1)]) == [(2.0, 1)]
    with pytest.raises(ValueError, match="1 of 3 rows have no x"):
        ranks.order_statistics(df, ["x", "id"], [(None, 1)], nulls="error")


def test_three_passes_and_ranges_that_reach_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "_TAKE", 2000)
    monkeypatch.setattr(ranks, "_HISTOGRAM", 16)
    spark.range(200_000).select("id", (F.xxhash64("id") / 1e12).alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plans, passes = [], []
    any_of = ranks._any

    def watched(conds):
        passes.append(1)
        plans.append(df.filter(any_of(conds))._jdf.queryExecution().executedPlan().toString())
        return any_of(conds)

    monkeypatch.setattr(ranks, "_any", watched)
    order = [tuple(r) for r in df.orderBy("x", "id").select("x", "id").collect()]
    for rank in (160_000, 30_000):
        plans.clear()
        passes.clear()
        assert ranks.order_statistics(df, ["x", "id"], [(None, rank)]) == [order[rank]]
        assert len(passes) == 3
        pushed = [p.split("PushedFilters: ")[1].split("]")[0] for p in plans]
        # The whole column, one side of the range, the range.
        assert "Than" not in pushed[0]
        assert ("GreaterThanOrEqual(x" in pushed[1]) != ("LessThanOrEqual(x" in pushed[1])
        assert "GreaterThanOrEqual(x" in pushed[2] and "LessThanOrEqual(x" in pushed[2]


def test_rank_outside_the_data(spark):
    with pytest.raises(ValueError):
        ranks.order_statistics(spark.range(3).withColumnRenamed("id", "x"), ["x"], [(None, 3)])


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_by_group(spark, descending):
    rng = np.random.default_rng(1)
    rows = {(int(g), float(x)): int(n) for g, x, n in zip(rng.integers(0, 3, 300), rng.integers(0, 200, 300), rng.integers(1, 9, 300))}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in rows.items()], "g int, x double, n bigint")
    got = {(r.g, r.x): r.cum_n for r in ranks.prefix_sums(df, "x", ["n"], ["g"], descending).collect()}
    for (g, x), total in got.items():
        assert total == sum(n for (h, y), n in rows.items() if h == g and (y >= x if descending else y <= x))


def test_prefix_sums_single_value(spark):
    df = spark.createDataFrame([(5.0, 3)], "x double, n bigint")
    assert ranks.prefix_sums(df, "x", ["n"]).first().cum_n == 3


def test_quantiles_match_numpy(spark):
    x = np.random.default_rng(2).normal(size=501)
    df = _frame(spark, x)
    probs = [0, 0.1, 0.25, 0.5, 0.999, 1]
    assert profile.exact_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)
    grouped = profile.grouped_quantiles(df, [], "x", probs, [f"q{i}" for i in range(6)]).first()
    assert list(grouped) == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)


def test_folds_are_disjoint_and_even(spark):
    df = spark.range(101).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = splits.stratified_folds(df, "y", "id", 4).collect()
    assert len(rows) == 101
    for y in (0, 1):
        sizes = [sum(r.y == y and r.fold == f for r in rows) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_time_folds_follow_time(spark):
    df = spark.range(50).select("id", F.floor(F.col("id") / 3).cast("double").alias("t"))
    rows = splits.time_folds(df, "t", "id", 3).collect()
    assert [sum(r.block == b for r in rows) for b in range(4)] == [14, 12, 12, 12]
    for b in range(1, 4):
        assert max((r.t, r.id) for r in rows if r.block < b) < min((r.t, r.id) for r in rows if r.block == b)


def test_leak_guard_and_empty_shift(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("t"))
    splits.assert_no_leak(df.filter("t < 5"), "t", 5.0)
    with pytest.raises(AssertionError):
        splits.assert_no_leak(df, "t", 5.0)
    with pytest.raises(ValueError):
        splits.require_rows(splits.shift(df, "t", 100.0), "shift")


@pytest.mark.parametrize("bin_seconds", [None, 1.0, 1e6])
def test_shifts_by_interval_join(spark, bin_seconds):
    rng = np.random.default_rng(4)
    times = np.concatenate([rng.uniform(-50, 300, 200), [0.0, 10.0, 20.0]]).tolist()
    bounds = [(0.0, 10.0), (10.0, 20.0), (-5.5, 0.0), (3.25, 250.5), (7.0, 7.0), (9.0, 1.0), (None, 5.0), (0.0, float("inf"))]
    bounds += [(float(a), float(a + 40)) for a in rng.uniform(-60, 280, 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*times, None])], "id bigint, t double")
    table = spark.createDataFrame([(k, *b) for k, b in enumerate(bounds)], "shift int, lo double, hi double")
    got = sorted((r["id"], r["shift"]) for r in splits.shifts(df, "t", table, bin_seconds=bin_seconds).collect())
    real = [(k, lo, hi) for k, (lo, hi) in enumerate(bounds) if lo is not None and hi != float("inf")]
    assert got == sorted((i, k) for i, t in enumerate(times) for k, lo, hi in real if lo <= t < hi)
    assert splits.shifts(df, "t", table.filter("false")).count() == 0


def test_a_shift_is_copied_into_the_bins_it_meets_only(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("t"))
    table = splits.shift_table(spark, 0.0, 0.01, [k / 200 for k in range(100)])
    joined = splits.shifts(df, "t", table)
    assert joined.count() == sum(lo <= t < hi for _, lo, hi in table.collect() for t in range(2000))
    # Bins are as long as a shift, so each of the hundred meets two or three.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()


def test_distinct_values_of_any_range_from_sketches(spark):
    from casemill.operators import summaries

    rng = np.random.default_rng(5)
    rows = [(int(p), int(v)) for p, v in zip(rng.integers(0, 20, 30_000), rng.integers(0, 9000, 30_000))]
    df = spark.createDataFrame([*rows, (3, None)], "p int, v int")
    kept = summaries.distinct_sketches(df, F.col("p"), ["v"])
    ranges = [(0, 19), (5, 5), (2, 11), (19, 40), (50, 60)]
    told = summaries.distinct_between(kept, spark.createDataFrame(ranges, "first int, last int"), ["v"]).collect()
    assert {(r["first"], r["last"]) for r in told} == set(ranges[:-1])
    for r in told:
        exact = {v for p, v in rows if r["first"] <= p <= r["last"]}
        assert abs(r["n_v"] - len(exact)) <= 0.03 * len(exact)
        assert r["n_rows"] == sum(r["first"] <= p <= r["last"] for p, _ in rows) + (r["first"] <= 3 <= r["last"])
