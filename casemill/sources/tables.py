"""Reading the given tables and the transaction view over ``events``."""

from __future__ import annotations

from datetime import datetime, timedelta
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.scalar import hour_of_day, risk_tier

_BASE = datetime(2024, 1, 1)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that are costly to work on, spread over the cores when the input has few splits.

    An input with as many splits as cores, as any large table has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(load(spark, folder, name))


def event_transactions(events: DataFrame) -> DataFrame:
    """Events as labelled, rule-scored card transactions."""
    # Calendar parts of a zoneless timestamp do not depend on the session time zone.
    ts = F.col("ts")
    micros = (
        F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )
    amount = F.col("value")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("tx_id"),
        (micros / F.lit(1e6)).alias("t_sec"),
        amount.alias("amount"),
        k.alias("k"),
        F.col("event_type").alias("category"),
        F.col("user_id").alias("card"),
        (amount / (amount + F.lit(60.0))).alias("prob"),
        ((F.col("event_type") == "error") & (amount + k >= 150)).cast("int").alias("label"),
    ).withColumn("hour", hour_of_day(F.col("t_sec")))


def transactions(
    spark: SparkSession, folder: str, seconds: tuple[float, float] | None = None
) -> DataFrame:
    """The transaction view; ``seconds`` limits the scan to a half-open range of whole seconds
    around it, as a filter on the stored timestamp that reaches the files."""
    events = load(spark, folder, "events")
    if seconds is not None:
        lo = _BASE + timedelta(seconds=floor(seconds[0]))
        hi = _BASE + timedelta(seconds=floor(seconds[1]) + 1)
        at = "timestamp_ntz'{:%Y-%m-%d %H:%M:%S}'"
        events = events.filter(
            (F.col("ts") >= F.expr(at.format(lo))) & (F.col("ts") < F.expr(at.format(hi)))
        )
    return event_transactions(events)


def scored_transactions(
    spark: SparkSession, folder: str, seconds: tuple[float, float] | None = None
) -> DataFrame:
    return transactions(spark, folder, seconds).withColumn("tier", risk_tier(F.col("prob")))


def embedding_rows(spark: SparkSession, folder: str, width: int = 28) -> DataFrame:
    """Embeddings as labelled rows: V1..Vn, an amount and an hour from the id, label 0 positive."""
    vec = F.col("embedding")
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("tx_id"),
        *[vec[i].cast("double").alias(f"V{i + 1}") for i in range(width)],
        ((F.col("vec_id") * 37) % 500 / F.lit(2.0)).alias("Amount"),
        (F.col("vec_id") * 7 % 240 / F.lit(10.0)).alias("Hour"),
        (F.col("vec_id") * 60.0).alias("Time"),
        (F.col("label") == 0).cast("int").alias("Class"),
    )
