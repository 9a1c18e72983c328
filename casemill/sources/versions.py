"""A run log of immutable versions that several writers may extend at once.

Every commit writes its rows to a folder of its own and then one small entry that names it, under
the version it makes.  Spark renames the finished entry into place, so a version appears whole or
not at all, and nothing that was written is ever changed: all earlier versions stay readable.  The
newest version is the highest that has an entry.  Writers that started from one version enter the
same next version side by side; all entries of a version count, and the conflict is reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "commit string, kind string"


@dataclass(frozen=True)
class Commit:
    """What a commit made; ``conflict`` tells that another writer entered the same or a later version."""

    version: int
    name: str
    conflict: bool


class VersionedLog:
    """Rows with a unique key, in versions 1, 2, ...; version 0 is empty.

    Of several rows with one key, the newest update counts, and without an update the earliest
    added row; writers of one version are ordered by the name of their commit.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)

    def _entries(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_ENTRY}, version int").parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # nothing was ever committed

    def version(self) -> int:
        """The newest version."""
        entries = self._entries()
        return (entries.agg(F.max("version")).first()[0] or 0) if entries is not None else 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; version 0 is an error, since it has no columns."""
        entries = self._entries()
        # One entry per commit, whatever the size of the commits.
        known = [] if entries is None else entries.filter(F.lit(version is None) | (F.col("version") <= F.lit(version))).collect()
        if not known or (version is not None and version > max(r["version"] for r in known)):
            raise ValueError(f"{self.path} has no version {version or ''}".strip())
        folders = [f"{self.path}/data/commit={r['commit']}" for r in known]
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*folders)
        columns = [c for c in rows.columns if c not in ("commit", *self.key)]
        named = self.spark.createDataFrame(known, f"{_ENTRY}, version int").withColumnRenamed("commit", "_commit")
        dated = rows.join(F.broadcast(named), F.col("commit") == F.col("_commit"))  # one row per commit
        update = F.col("kind") == "update"
        order = F.struct(update.alias("u"), F.when(update, F.col("version")).otherwise(-F.col("version")).alias("v"), F.col("commit").alias("c"))
        newest = dated.groupBy(*self.key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
        return newest.select(*self.key, "_row.*")

    def _commit(self, rows: DataFrame, kind: str, base: int | None) -> Commit:
        base = self.version() if base is None else base
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/commit={name}")
        entry = self.spark.createDataFrame([(name, kind)], _ENTRY).coalesce(1)
        entry.write.mode("append").parquet(f"{self.path}/versions/version={base + 1}")
        others = self._entries().filter((F.col("version") > base) & (F.col("commit") != name))
        return Commit(base + 1, name, not others.isEmpty())

    def append(self, rows: DataFrame, base: int | None = None) -> Commit:
        """Add the rows whose key the version ``base`` does not hold; of rows with one key one is added."""
        base = self.version() if base is None else base
        new = rows.dropDuplicates(self.key)
        if base:
            new = new.join(self.read(base).select(*self.key), self.key, "left_anti")
        return self._commit(new, "append", base)

    def update(self, rows: DataFrame, base: int | None = None) -> Commit:
        """Replace the rows of these keys; rows that the update does not name stay as they are."""
        return self._commit(rows.dropDuplicates(self.key), "update", base)
