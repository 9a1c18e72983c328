"""A corpus from raw documents in five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.decontaminate import find_benchmark
from casemill.llm.jaccard import near_duplicates
from casemill.llm.language import learn_dictionaries, predict_language
from casemill.llm.mixing import mixing_cuts, with_copies
from casemill.llm.sharding import text_crc32, text_size, with_shards
from casemill.llm.tokens import free_name
from casemill.session import shared_dir

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 17
SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; texts without a letter, null and empty ones go.

    Repeated rows stay or go together; an empty table stays empty; columns of any name are kept.
    """
    known = learn_dictionaries(docs.filter(F.col("doc_id").isNotNull()))
    judged = predict_language(docs, known, carry=docs.columns)
    return judged.filter(~F.col(free_name("rejected", docs.columns))).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked texts: that with the smallest id, ids before nulls.

    Rows are told apart by their id and text together, so texts that share an id, or have none, are
    compared like all others; of rows that repeat both, one stays.  Rows without words are linked to
    nothing.  An empty table stays empty; columns of any name are kept.
    """
    row, first = free_name("row", docs.columns), free_name("first", docs.columns)
    # Null and empty differ; a hash skips nulls by itself.
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    found = near_duplicates(keyed, doc_id=row).select("id", "class_id").distinct()
    names = keyed.select(F.col(row).alias("id"), "doc_id").distinct()
    best = found.join(names, "id").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias(row))
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy(row).orderBy(*rest, F.lit(0))
    kept = keyed.join(best.select(row), row, "left_semi").withColumn(first, F.row_number().over(one)).filter(F.col(first) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty table stays empty.
    """
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return found.filter(F.col(free_name("n_hit", docs.columns)) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    ``docs`` is a table that the stage before has written.  Null and empty texts have no size and are taken
    as often as their class says; of equal rows as many are taken as fit the target of their source; a null
    source is one of its own; an empty table stays empty.
    """
    mixed = with_copies(docs, mixing_cuts(docs, WEIGHTS, SHARE, MOST, seed=SEED), seed=SEED)
    copies = F.col(free_name("_copies", docs.columns)).cast("int")
    copy = free_name("copy", docs.columns)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard; copies of one document share it.  Columns that have the name
    of a result are replaced by it."""
    results = {"size": text_size(F.col("text")), "text_crc32": text_crc32(F.col("text")), "law": F.lit("key")}
    kept = [c for c in docs.columns if c not in (*results, "shard", "grown_shard")]
    placed = with_shards(docs.select(*kept), SHARDS, grown="grown_shard")
    return placed.select(*kept, *[c.alias(n) for n, c in results.items()], "shard", "grown_shard")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL cannot express compression; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, by way of the folder all executors share."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
