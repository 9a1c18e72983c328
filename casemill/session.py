"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "casemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Without one, a local session gets a temporary folder; on a cluster that is an error,
    since executors and driver share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="casemill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let iterative jobs and ``durable`` write their checkpoints to the shared folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint that outlives lost executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
