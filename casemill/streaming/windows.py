"""The continuous regime as Structured Streaming over event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casemill import constants as K
from casemill.functions.hashing import hash32
from casemill.operators.selection import select_cases_by
from casemill.operators.windows import review_cost
from casemill.session import shared_dir
from casemill.sources.sinks import open_ledger, write_ledger
from casemill.sources.tables import event_transactions

EPOCH_2024 = 1_704_067_200
_CASE = "prob double, tx_id bigint, t_sec double, label int"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(seconds: Column) -> Column:
    """Instant of a transaction; independent of the session time zone."""
    return F.timestamp_micros((seconds * F.lit(1e6)).cast("long") + F.lit(EPOCH_2024 * 1_000_000))


def transaction_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """Events files of a folder as a stream of scored transactions with ``event_time``."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    tx = event_transactions(reader.parquet(folder))
    return tx.withColumn("event_time", event_time(F.col("t_sec")))


def _windowed(stream: DataFrame, minutes: int, late: str, start: str) -> DataFrame:
    size = f"{minutes} minutes"
    return stream.withWatermark("event_time", late).withColumn(
        "_w", F.window("event_time", size, startTime=start)
    )


def stream_counts(stream: DataFrame, minutes: int = 60, late: str = "10 minutes", start: str = "0 seconds") -> DataFrame:
    """Rows and positives per tumbling window."""
    return _windowed(stream, minutes, late, start).groupBy("_w").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("label").cast("long")).alias("positives")
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n_rows", "positives")


class KeepBest(StatefulProcessor):
    """The best ``capacity`` rows of every (window end, lane), as list state.

    Rows that arrive update the list and are reported as provisional.  A timer at the end of the
    window fires once the watermark passes it: the list is reported as final and forgotten, so
    the state holds open windows only.  Later rows of the window are late and never get here.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", _CASE)

    def _report(self, key: tuple, best: list[tuple], final: bool) -> pd.DataFrame:
        out = pd.DataFrame(best, columns=["prob", "tx_id", "t_sec", "label"]).astype({"tx_id": "int64", "label": "int32"})
        return out.assign(end_ms=key[0], lane=key[1], final=final).astype({"end_ms": "int64", "lane": "int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.best.get()]
        for pdf in rows:
            # Column by column: one array of all would turn large ids into doubles.
            best += zip(*[pdf[c].tolist() for c in ("prob", "tx_id", "t_sec", "label")])
            best = sorted(best, key=lambda r: (-r[0], r[1]))[: self.capacity]
        self.best.put(best)
        self.handle.registerTimer(int(key[0]))
        yield self._report(key, best, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.best.get()]
        self.best.clear()
        yield self._report(key, best, True)

    def close(self) -> None:
        pass


def stream_cases(
    stream: DataFrame,
    minutes: int = 60,
    capacity: int = 60,
    threshold: float = K.HIGH_FROM,
    late: str = "10 minutes",
    lanes: int | None = None,
) -> DataFrame:
    """Best rows of every (window, lane): provisional while the window is open, then final, once.

    Rows under the threshold never reach the state.  A busy window is spread over
    ``lanes`` keys (by default a quarter of the cores), each keeping at most ``capacity``
    rows; ``merge_lanes`` then picks the case file of the window.  All lanes of a window end in
    the same micro-batch.  State is kept in RocksDB, which this operator requires.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    if lanes is None:
        lanes = max(1, spark.sparkContext.defaultParallelism // 4)
    # All rows move the watermark; naming the event time keeps the filter above it.
    raised = _windowed(stream, minutes, late, "0 seconds").filter(F.when(F.col("event_time").isNotNull(), F.col("prob")) >= threshold)
    # The window column carries the watermark: a row is late when its window has ended.
    keyed = raised.select(
        F.unix_millis("_w.end").alias("end_ms"), (hash32("lane", F.col("tx_id")) % lanes).cast("int").alias("lane"),
        "prob", "tx_id", "t_sec", "label", "_w",
    )
    found = keyed.groupBy("end_ms", "lane").transformWithStateInPandas(
        KeepBest(capacity), f"{_CASE}, end_ms bigint, lane int, final boolean", "Update", "EventTime"
    )
    start = F.timestamp_millis(F.col("end_ms") - minutes * 60_000)
    return found.select(start.alias("window_start"), "lane", "prob", "tx_id", "t_sec", "label", "final")


def merge_lanes(updates: DataFrame, capacity: int = 60, threshold: float = K.HIGH_FROM) -> DataFrame:
    """Case files from the stored lane updates: the newest update of a lane counts.

    Provisional and final rows of one batch are the same where a lane has both.
    """
    updates = updates.dropDuplicates(["window_start", "lane", "epoch", "tx_id"])
    newest = updates.groupBy("window_start", "lane").agg(F.max("epoch").alias("epoch"))
    rows = updates.join(newest, ["window_start", "lane", "epoch"])
    return select_cases_by(rows, ["window_start"], "prob", "tx_id", capacity, threshold, 0)


def newest_windows(updates: DataFrame) -> DataFrame:
    """Last emitted version of every window record."""
    newest = updates.groupBy("window_start").agg(F.max("epoch").alias("epoch"))
    return updates.join(newest, ["window_start", "epoch"]).drop("epoch")


def window_reports(cases: DataFrame, minutes: int) -> DataFrame:
    """Per-window record of the windows that have cases."""
    end = F.col("window_start").cast("double") - EPOCH_2024 + minutes * 60.0
    pos = F.col("label") == 1
    g = cases.groupBy("window_start").agg(
        F.count("*").alias("n_cases"),
        F.count_if(pos).alias("positives_raised"),
        F.avg(F.when(pos, end - F.col("t_sec"))).alias("_wait"),
    )
    cost = review_cost(F.col("n_cases"))
    return g.select(
        "window_start", "n_cases", "positives_raised", cost.alias("cost_sec"),
        ((F.col("_wait") + cost) / 60).alias("latency_mean_min"),
    )


def _drain(stream: DataFrame, mode: str, base: str, sink: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, mode: str, where: str | None = None) -> str:
    """Drain a stream into parquet, one folder per micro-batch, and return its path.

    A batch that is retried overwrites its own folder, so every batch counts once.
    """
    base = where or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")

    _drain(stream, mode, base, sink)
    return f"{base}/data"


REPORT = "window_start timestamp, n_cases bigint, positives_raised bigint, cost_sec double, latency_mean_min double"


def run_to_ledger(
    cases: DataFrame, base: str, run: str, minutes: int = 60, capacity: int = 60, threshold: float = K.HIGH_FROM
) -> DataFrame:
    """Report every window the moment it ends, while the stream runs; the ledger of all reports so far.

    The ledger holds one version of each (run, window): a batch that is replayed after a crash
    overwrites what it left behind, and a stream that is read anew adds no window a second time.
    """
    path = f"{base}/ledger"
    open_ledger(cases.sparkSession, path, run, REPORT)

    def sink(batch: DataFrame, epoch: int) -> None:
        ended = select_cases_by(batch.filter("final"), ["window_start"], "prob", "tx_id", capacity, threshold, 0)
        write_ledger(window_reports(ended, minutes), path, run, epoch, "window_start", REPORT)

    _drain(cases, "update", base, sink)
    return cases.sparkSession.read.schema(f"{REPORT}, run string, epoch bigint").parquet(path)
