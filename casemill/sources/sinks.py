"""Sinks: split files, training JSON, idempotent run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.sources.versions import Commit, VersionedLog


def write_split(df: DataFrame, path: str, split: str = "split", form: str = "csv") -> None:
    """One sub-folder per side of the split."""
    writer = df.write.mode("overwrite").partitionBy(split)
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def write_training_json(df: DataFrame, path: str, part: str = "part") -> None:
    df.write.mode("overwrite").partitionBy(part).json(path)


def training_summary(df: DataFrame, part: str = "part", label: str = "label", amount: str = "amount") -> DataFrame:
    train, pos = F.col(part) == "train", F.col(label) == 1
    return df.agg(
        F.count_if(train).alias("n_train"),
        F.count_if(~train).alias("n_val"),
        F.count_if(train & pos).alias("positives_train"),
        F.count_if(train & pos & (F.col(amount) <= 5)).alias("low_positives_train"),
    )


def open_ledger(spark: SparkSession, path: str, run: str, schema: str) -> None:
    """An empty first entry, so that a ledger can be read before anything is recorded."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/run={run}/epoch=-1")


def write_ledger(rows: DataFrame, path: str, run: str, epoch: int, key: str, schema: str) -> None:
    """Record the rows of one batch whose key no other batch of the run has recorded.

    The batch owns its folder: written again after a crash, it replaces what it left there.
    """
    known = rows.sparkSession.read.schema(f"{schema}, epoch bigint").parquet(f"{path}/run={run}")
    new = rows.join(known.filter(F.col("epoch") != epoch).select(key), key, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/run={run}/epoch={epoch}")


def append_runs(runs: DataFrame, path: str, key: str = "run_id", base: int | None = None) -> Commit:
    """Append only runs the log does not hold, so a repeated write adds nothing.

    Of rows with one key in ``runs`` one is written.  Writers need not take turns: those that start
    from one version ``base`` are told of each other, and no run is lost or doubled.
    """
    return VersionedLog(runs.sparkSession, path, [key]).append(runs, base)
