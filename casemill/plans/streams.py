"""Queries: the stream forms of the window operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.plans.registry import TX, query
from casemill.session import shared_dir
from casemill.sources.tables import event_transactions, load
from casemill.streaming import windows as W

# Stream windows start on the hour; ids count hours from the first instant of 2024.
_HOURS = f"""{TX}, w AS (SELECT *, CAST(floor(t_sec / 3600e0) AS BIGINT) AS window_id FROM tx)"""

# Events arrive in files of six days.  Of the last five minutes before a file is closed, half arrive with the
# next one, still within the allowed lateness.  Some rows come three files later: they are late and dropped.
_FILE_SECONDS = 6 * 86_400
_ON_TIME = f"""{TX}, f AS (SELECT *, CAST(floor(t_sec / {_FILE_SECONDS}e0) AS BIGINT) AS own FROM tx),
w AS (SELECT *, CAST(floor(t_sec / 3600e0) AS BIGINT) AS window_id FROM f WHERE NOT (tx_id % 97 = 0 AND own + 3 <= (SELECT max(own) FROM f)))"""


def _id():
    return ((F.col("window_start").cast("double") - W.EPOCH_2024) / 3600).cast("long").alias("window_id")


def _deliver(spark, d, drain) -> str:
    """Let the event files arrive one after another, out of order; after each the stream is restarted."""
    base = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    events = load(spark, d, "events")
    seconds = event_transactions(events).agg(F.max("t_sec")).first()[0]
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - W.EPOCH_2024
    last = int(seconds // _FILE_SECONDS)
    own = F.floor(t / _FILE_SECONDS)
    edge = ((own + 1) * _FILE_SECONDS - t <= 300) & (F.col("event_id") % 2 == 0) & (own < last)
    late = (F.col("event_id") % 97 == 0) & (own + 3 <= last)
    arrival = F.when(late, own + 3).when(edge, own + 1).otherwise(own)
    for k in range(last + 1):
        events.filter(arrival == k).orderBy(F.xxhash64("event_id")).write.parquet(f"{base}/in/{k}")
        drain(W.transaction_stream(spark, f"{base}/in/*", "*.parquet"), base)
    return base


@query(
    "x1s_window_counts",
    f"WITH {_HOURS} SELECT window_id, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM w GROUP BY 1",
)
def x1s_window_counts(spark, d):
    path = W.run_to_table(W.stream_counts(W.transaction_stream(spark, d)), "update")
    return W.newest_windows(spark.read.parquet(path)).select(_id(), "n_rows", "positives")


@query(
    "x2s_window_cases",
    f"""WITH {_ON_TIME} SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY prob DESC, tx_id) AS case_no, tx_id, prob, label
      FROM w WHERE prob >= 0.7e0 QUALIFY case_no <= 3""",
)
def x2s_window_cases(spark, d):
    base = _deliver(spark, d, lambda s, base: W.run_to_table(W.stream_cases(s, capacity=3, threshold=0.7), "update", base))
    return W.merge_lanes(spark.read.parquet(f"{base}/data"), 3, 0.7).select(_id(), "case_no", "tx_id", "prob", "label")


@query(
    "x8s_late_data",
    f"""WITH {_ON_TIME} SELECT window_id, count(*) AS n_rows FROM w
      GROUP BY 1 HAVING (window_id + 1) * 3600e0 <= (SELECT max(t_sec) FROM tx) - 600""",
)
def x8s_late_data(spark, d):
    # Append mode: a window appears once, after the watermark has passed its end.
    base = _deliver(spark, d, lambda s, base: W.run_to_table(W.stream_counts(s), "append", base))
    return spark.read.parquet(f"{base}/data").select(_id(), "n_rows")


@query(
    "s12_window_sink",
    f"""WITH {_ON_TIME}, c AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY prob DESC, tx_id) AS case_no FROM w WHERE prob >= 0.8e0 QUALIFY case_no <= 60),
      g AS (SELECT window_id, count(*) AS n_cases, count(*) FILTER (label = 1) AS positives_raised, avg((window_id + 1) * 3600e0 - t_sec) FILTER (label = 1) AS wait FROM c GROUP BY 1),
      m AS (SELECT max(t_sec) AS t FROM tx)
      SELECT 'day' AS run, window_id, n_cases, positives_raised, round((n_cases + 2) * 6.8e0, 6) AS cost_sec, round((wait + (n_cases + 2) * 6.8e0) / 60, 6) AS latency_mean_min
      FROM g, m WHERE (window_id + 1) * 3600e0 <= m.t - 600""",
)
def s12_window_sink(spark, d):
    # Windows are reported as they end; those still open at the end of the data are not.
    base = _deliver(spark, d, lambda s, base: W.run_to_ledger(W.stream_cases(s), base, "day"))
    ledger = spark.read.parquet(f"{base}/ledger")
    return ledger.select(
        "run", _id(), "n_cases", "positives_raised", F.round("cost_sec", 6).alias("cost_sec"),
        F.round("latency_mean_min", 6).alias("latency_mean_min"),
    )
