import json

import pytest
from pyspark.errors import AnalysisException

from casemill.sources import files, sinks
from casemill.sources.versions import VersionedLog


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return path


def test_card_csv(spark, tmp_path):
    header = "Time," + ",".join(f"V{i}" for i in range(1, 29)) + ",Amount,Class"
    _write(tmp_path / "card.csv", f"{header}\n90000.0,{','.join(['0.5'] * 28)},12.5,1\n")
    r = files.read_card_csv(spark, str(tmp_path / "card.csv")).first()
    assert (r.Hour, r.Amount, r.Class) == (1.0, 12.5, 1)
    with pytest.raises(Exception):
        files.read_card_csv(spark, str(tmp_path / "none.csv")).count()


def test_multi_file_ingest_and_preparation(spark, tmp_path):
    cols = "cc_num|dob|lat|long|merch_lat|merch_long|merchant|category|amt|city|state|city_pop|job|trans_num|trans_date|trans_time|is_fraud"
    row = "7|1980-01-01|40.0|-3.0|41.0|-3.0|fraud_Shop|food|9.5|X|Y|100|j|{}|2024-01-0{}|10:30:45|0"
    _write(tmp_path / "a.csv", "\n".join([cols, row.format("t2", 2), row.format("t1", 1)]) + "\n")
    _write(tmp_path / "b.csv", cols.replace("|job", "") + "\n" + row.format("t3", 3).replace("|j|", "|") + "\n")
    _write(tmp_path / "c.csv", "cc_num|dob\n1|1990-01-01\n")
    _write(tmp_path / "d.csv", cols + "\n")
    raw = files.read_raw_folder(spark, f"{tmp_path}/*.csv")
    assert raw.count() == 3
    rows = files.prepare_business(raw).collect()
    assert [r.trans_num for r in rows] == ["t1", "t2", "t3"]
    first = rows[0]
    assert (first.comercio, first.hora, first.dia_semana, first.job) == ("Shop", 10.5, 0, "j")
    assert first.edad == pytest.approx(16071 / 365.25) and first.distancia_km == pytest.approx(111.19, abs=0.01)
    assert rows[2].job is None
    with pytest.raises(FileNotFoundError):
        files.read_raw_folder(spark, f"{tmp_path}/c.csv")


def test_newest_log_without_errors(spark, tmp_path):
    _write(tmp_path / "log_1.csv", "modelo,error\na,\n")
    _write(tmp_path / "log_2.csv", "modelo,error\nb,\nc,boom\n")
    rows = files.read_newest_log(spark, f"{tmp_path}/log_*.csv").collect()
    assert [r.modelo for r in rows] == ["b"]


def test_documents(spark, tmp_path):
    _write(tmp_path / "m.json", json.dumps([{"modelo": "x", "split": "temporal", "auc_pr": 0.5}, {"modelo": "x", "split": "aleatorio", "auc_pr": 0.9}], indent=1))
    assert [r.auc_pr for r in files.read_metric_documents(spark, f"{tmp_path}/m.json").collect()] == [0.5]
    _write(tmp_path / "w1.json", json.dumps({"ventana_min": 5.0, "ocupacion": 0.04, "registro": [1]}, indent=1))
    _write(tmp_path / "w2.json", json.dumps({"ventana_min": 5.0}, indent=1))
    assert [tuple(r) for r in files.read_window_documents(spark, f"{tmp_path}/w*.json").collect()] == [(5.0, 0.04)]


def test_report_scan(spark, tmp_path):
    body = "# x\n\n## Informe final\nCASO 1\nfin\n---\n\n## Salida del Investigador\nz"
    _write(tmp_path / "modelo_8b_revisa_s42_r2.md", body)
    _write(tmp_path / "modelo_8b_revisa_s42_r3.md", "sin partes")
    _write(tmp_path / "otro.md", body)
    (r,) = files.read_reports(spark, str(tmp_path)).collect()
    assert tuple(r) == ("modelo_8b", "revisa", 42, 2, "CASO 1\nfin")


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.append_runs(spark.createDataFrame([("a", 1)], "run_id string, v int"), path)
    more = spark.createDataFrame([("a", 9), ("b", 2)], "run_id string, v int")
    for _ in range(2):
        sinks.append_runs(more, path)
    assert sorted(tuple(r) for r in VersionedLog(spark, path, ["run_id"]).read().collect()) == [("a", 1), ("b", 2)]


def _rows(log, version=None):
    return sorted(tuple(r) for r in log.read(version).select("run_id", "v").collect())


def test_two_writers_lose_nothing_and_learn_of_each_other(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "run_id string, v int")
    log = VersionedLog(spark, str(tmp_path / "log"), ["run_id"])
    assert log.version() == 0
    with pytest.raises(ValueError, match="no version"):
        log.read()
    start = log.append(frame(("a", 1), ("a", 1)))
    one = log.append(frame(("a", 9), ("b", 2)), base=start.version)
    other = log.append(frame(("b", 7), ("c", 3)), base=start.version)
    assert (start.conflict, one.conflict, other.conflict) == (False, False, True)
    rows = dict(_rows(log))
    assert rows.keys() == {"a", "b", "c"} and rows["a"] == 1 and rows["b"] in (2, 7)
    assert dict(_rows(log)) == rows and log.version() == 2
    # One that started from an even older version learns of both.
    assert log.append(frame(("d", 4)), base=0).conflict


def test_an_update_leaves_earlier_versions_as_they_were(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "run_id string, v int")
    log = VersionedLog(spark, str(tmp_path / "log"), ["run_id"])
    log.append(frame(("a", 1), ("b", 2)))
    second = log.update(frame(("a", 10)))
    third = log.append(frame(("a", 99), ("c", 3)))
    log.update(frame(("a", 11)))
    assert (second.version, third.version, log.version()) == (2, 3, 4)
    assert _rows(log, 1) == [("a", 1), ("b", 2)]
    assert _rows(log, 2) == [("a", 10), ("b", 2)]
    assert _rows(log, 3) == [("a", 10), ("b", 2), ("c", 3)]
    assert _rows(log) == [("a", 11), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="no version 9"):
        log.read(9)


def test_rows_of_an_unfinished_commit_are_not_seen(spark, tmp_path):
    log = VersionedLog(spark, str(tmp_path / "log"), ["run_id"])
    log.append(spark.createDataFrame([("a", 1)], "run_id string, v int"))
    # A writer that died before it entered its commit.
    spark.createDataFrame([("z", 1)], "run_id string, v int").write.parquet(f"{tmp_path}/log/data/commit=dead")
    assert _rows(log) == [("a", 1)] and log.version() == 1


def test_only_the_newest_log_is_read(spark, tmp_path):
    for name, run in (("log_2.csv", "new"), ("log_1.csv", "old")):
        spark.createDataFrame([(run, None), (run, "boom")], "modelo string, error string").repartition(2).write.option("header", True).csv(f"{tmp_path}/{name}")
    rows = files.read_newest_log(spark, f"{tmp_path}/log_*")
    assert [r.modelo for r in rows.collect()] == ["new"] and all("log_2" in f for f in rows.inputFiles())
    with pytest.raises((FileNotFoundError, AnalysisException)):
        files.read_newest_log(spark, f"{tmp_path}/none_*")
