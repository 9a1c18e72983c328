"""Inputs that the given tables do not hold."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemill import session
from casemill.operators import anomaly, oversample, splits, stats
from casemill.plans.triage import Triage
from casemill.sources import files, sinks, tables
from casemill.sources.versions import VersionedLog
from casemill.streaming import windows


class _Handle:
    """Enough of a state handle for the processor: one list and its timers."""

    def __init__(self):
        self.held, self.timers = [], []

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.timers.append(at)


def test_large_ids_survive_the_stream_state():
    big = 9007199254740993
    pdf = pd.DataFrame({"prob": [0.9, 0.9], "tx_id": [big, big + 1], "t_sec": [1.0, 2.0], "label": [1, 0]})
    handle, keep = _Handle(), windows.KeepBest(5)
    keep.init(handle)
    out = pd.concat(keep.handleInputRows((3_600_000, 0), iter([pdf]), None))
    assert out["tx_id"].tolist() == [big, big + 1] and not out["final"].any() and handle.timers == [3_600_000]
    assert [r[1] for r in handle.held] == [big, big + 1]
    last = pd.concat(keep.handleExpiredTimer((3_600_000, 0), None, None))
    assert last["tx_id"].tolist() == [big, big + 1] and last["final"].all() and handle.held == []


def test_a_data_line_is_no_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trans_num|amt\nT1|2.5\nT2|\n")
    (tmp_path / "b.csv").write_text("cc_num|amt\n2|trans_num\n3|4\n")
    (tmp_path / "c.csv").write_text("amt|trans_num|note\n7|T3|\"x|y\"\n\n")
    got = files.read_raw_folder(spark, str(tmp_path / "*.csv"))
    assert set(got.columns) == {"trans_num", "amt", "note"}
    rows = sorted((r["trans_num"], r["amt"], r["note"]) for r in got.fillna({"amt": -1.0, "note": ""}).collect())
    assert rows == [("T1", 2.5, ""), ("T2", -1.0, ""), ("T3", 7.0, "x|y")]
    with pytest.raises(FileNotFoundError):
        files.read_raw_folder(spark, str(tmp_path / "b.csv"))


def test_a_minority_of_one_is_an_error(spark):
    df = spark.createDataFrame([(k, float(k), int(k == 3)) for k in range(9)], "id long, x double, y int")
    with pytest.raises(ValueError, match="neighbours"):
        oversample.oversample(df, "y", "id", ["x"])
    far = df.withColumn("id", F.col("id") + (1 << 62)).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    with pytest.raises(ValueError, match="too large"):
        oversample.oversample(far, "y", "id", ["x"])


def test_a_run_id_twice_in_one_call_is_written_once(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "run_id string, n int")
    for _ in range(2):
        sinks.append_runs(runs, f"{tmp_path}/log")
    assert VersionedLog(spark, f"{tmp_path}/log", ["run_id"]).read().count() == 2


def test_a_missing_time_is_named(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id long, t double")
    for use in (splits.temporal_split, splits.time_folds):
        with pytest.raises(ValueError, match="1 of 3 rows have no t"):
            use(df, "t", "id")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)


def test_the_method_of_a_test_is_told_and_can_be_asked_for(spark):
    rows = [("s", d / 7 + 0.01) for d in (1, -2, 3, 4, 5)] + [("t", 1.0), ("t", 1.0), ("t", -2.0)]
    df = spark.createDataFrame(rows, "g string, d double")
    ask = lambda m: {r["g"]: (r["method"], r["p_value"]) for r in stats.wilcoxon(df, "d", ["g"], method=m).collect()}
    auto, exact, normal = ask("auto"), ask("exact"), ask("normal")
    assert auto["s"] == exact["s"] and auto["t"] == normal["t"]
    assert auto["s"][0] == "exact" and exact["t"] == ("exact", None) and normal["s"][1] != exact["s"][1]
    with pytest.raises(ValueError):
        stats.wilcoxon(df, "d", ["g"], method="other")


def test_one_sampling_scheme_at_every_size(spark):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    for trees, sample in ((4, 16), (40, 16)):  # more and fewer rows than the pool holds
        forest = anomaly.fit_isolation_forest(df, ["x", "y"], "id", trees, sample)
        assert len(forest.trees) == trees and forest.sample == sample
        s = forest.score(df).agg(F.min("score_anomalia"), F.max("score_anomalia"), F.count("*")).first()
        assert tuple(s) == (0.0, 1.0, 300)


def test_a_shift_reads_only_its_range(spark, folder):
    plan = tables.scored_transactions(spark, folder, (3600.0, 7200.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_the_desk_frees_its_case_file(spark, folder):
    with Triage(tables.scored_transactions(spark, folder)) as desk:
        assert desk.cases.count() > 0 and desk.cases.is_cached
        with pytest.warns(UserWarning, match="cut from 80 to 50"):
            assert desk.prioritise(80).count() == 50
    assert not desk.cases.is_cached
