from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casemill.sources import sinks
from casemill.streaming import windows as W

START = datetime(2024, 1, 1)


def _drop(spark, folder, number, rows):
    data = [(i, START + timedelta(minutes=m), 1, "error", float(v), '{"k": 99}') for i, m, v in rows]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{number}")


def _drain(spark, folder, base, make, mode):
    stream = W.transaction_stream(spark, f"{folder}/*", "*.parquet", per_batch=1)
    return W.run_to_table(make(stream), mode, base)


def test_late_rows_are_dropped_and_restart_continues(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    _drop(spark, folder, 0, [(1, 5, 10), (2, 50, 10), (3, 200, 10)])
    _drain(spark, folder, base, W.stream_counts, "append")
    # Minute 6 is far behind the watermark now; minute 201 is not.
    _drop(spark, folder, 1, [(4, 6, 10), (5, 201, 10), (6, 900, 10)])
    path = _drain(spark, folder, base, W.stream_counts, "append")
    rows = spark.read.parquet(path).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n_rows) for r in rows] == [(0, 2), (3, 2)]


def test_stream_case_files_keep_the_best_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    _drop(spark, folder, 0, [(i, 1 + i % 3, 300 + i) for i in range(40)] + [(99, 70, 20)])
    _drop(spark, folder, 1, [(200 + i, 5, 330 + i) for i in range(6)])
    path = _drain(spark, folder, str(tmp_path / "out"), lambda s: W.stream_cases(s, capacity=5, lanes=3), "update")
    cases = W.merge_lanes(spark.read.parquet(path), 5).orderBy("case_no").collect()
    values = sorted([300 + i for i in range(40)] + [330 + i for i in range(6)], reverse=True)[:5]
    assert [round(60 * r.prob / (1 - r.prob)) for r in cases] == values
    assert {r.window_start for r in cases} == {START}


def test_event_time_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(3600.5,)], "t double").select(W.event_time(F.col("t")).cast("double").alias("e"))
    assert df.first().e == W.EPOCH_2024 + 3600.5


def _run_files(spark, tmp_path, parts, capacity=5, lanes=3, **more):
    """Each part is a file; the stream is restarted after each."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(parts):
        _drop(spark, folder, k, rows)
        stream = W.transaction_stream(spark, f"{folder}/*", "*.parquet")
        W.run_to_ledger(W.stream_cases(stream, capacity=capacity, lanes=lanes, **more), base, "r", capacity=capacity)
    return base


PARTS = [
    [(i, 61 - i % 61, 300 + i) for i in range(50)] + [(90, 58, 300), (91, 119, 1000)],
    [(92, 119, 900), (93, 125, 700), (94, 130, 20), (95, 300, 20)],
    [(96, 5, 9999), (97, 118, 9999), (98, 299, 800), (99, 500, 20)],  # the first two are late
]


def _windows_of(parts, late=()):
    rows = [(i, m, v) for part in parts for i, m, v in part if i not in late and v >= 240]
    out = {}
    for i, m, v in rows:
        out.setdefault(m // 60, []).append((-v / (v + 60.0), i))
    return {h: sorted(v)[:5] for h, v in out.items()}


def test_windows_are_reported_once_as_they_end(spark, tmp_path):
    base = _run_files(spark, tmp_path, PARTS)
    rows = spark.read.parquet(f"{base}/ledger").collect()
    want = _windows_of(PARTS, late=(96, 97))
    assert sorted((r.window_start.hour, r.n_cases) for r in rows) == sorted((h, len(v)) for h, v in want.items())
    # Reports appear while the stream runs: the first windows belong to an earlier batch than the last one.
    assert len({r.epoch for r in rows}) > 1


def test_a_batch_written_again_leaves_one_version(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "w int, n int"
    sinks.open_ledger(spark, path, "r", schema)
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    sinks.write_ledger(frame((1, 10), (2, 20)), path, "r", 0, "w", schema)
    sinks.write_ledger(frame((1, 10), (2, 20)), path, "r", 0, "w", schema)  # after a crash
    sinks.write_ledger(frame((2, 99), (3, 30)), path, "r", 1, "w", schema)  # a window another batch has
    sinks.open_ledger(spark, path, "other", schema)
    sinks.write_ledger(frame((1, 11)), path, "other", 0, "w", schema)
    sinks.open_ledger(spark, path, "r", schema)  # a restart opens it again
    rows = spark.read.schema(f"{schema}, run string, epoch bigint").parquet(path).collect()
    assert sorted((r.run, r.w, r.n) for r in rows) == [("other", 1, 11), ("r", 1, 10), ("r", 2, 20), ("r", 3, 30)]


def test_a_stream_read_anew_adds_no_window(spark, tmp_path):
    base = _run_files(spark, tmp_path, PARTS)
    before = sorted(map(tuple, spark.read.parquet(f"{base}/ledger").collect()))
    # The checkpoint is lost, the ledger is not: the same files again, in other batches.
    stream = W.transaction_stream(spark, f"{tmp_path}/in/*", "*.parquet", per_batch=1)
    again = W.stream_cases(stream, capacity=5, lanes=2)

    def sink(batch, epoch):
        ended = W.select_cases_by(batch.filter("final"), ["window_start"], "prob", "tx_id", 5, 0.8, 0)
        sinks.write_ledger(W.window_reports(ended, 60), f"{base}/ledger", "r", 1000 + epoch, "window_start", W.REPORT)

    W._drain(again, "update", str(tmp_path / "fresh"), sink)
    assert sorted(map(tuple, spark.read.parquet(f"{base}/ledger").collect())) == before


def test_state_holds_open_windows_only(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for k in range(4):
        _drop(spark, folder, k, [(1000 * k + i, 600 * k + i, 400 + i) for i in range(300)] + [(1000 * k + 999, 600 * k + 599, 1)])
        stream = W.stream_cases(W.transaction_stream(spark, f"{folder}/*", "*.parquet"), capacity=5, lanes=1)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", base).foreachBatch(lambda b, e: b.count()).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # Five windows with rows came each time; all have ended, and nothing of them is left.
    assert sizes == [0, 0, 0, 0]
