"""The manifest beside a plain tree, and proofs that hold and fail."""

import brute
import pytest
from pyspark.sql import functions as F

from casemill.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def rows_of(signed):
    pairs = F.arrays_zip("left", "right")
    found = signed.select("order_key", "leaf", "subroot", "root", pairs.alias("p")).collect()
    return sorted((str(r[0]), r[1], r[2], r[3], str([(x["left"], x["right"]) for x in r[4]])) for r in found)


@pytest.fixture(scope="module")
def awkward(sample_docs):
    return sample_docs.withColumn("n_chars", F.when(F.col("doc_id") > 3, F.length("text")))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_samples(awkward, levels):
    signed = merkle.manifest(awkward, block_levels=levels)
    assert rows_of(signed) == brute.manifest([tuple(r) for r in awkward.select(*FIELDS).collect()])


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts(awkward, fanout):
    signed = merkle.manifest(awkward, fanout=fanout, block_levels=2)
    assert rows_of(signed) == brute.manifest([tuple(r) for r in awkward.select(*FIELDS).collect()], fanout)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows_of(merkle.manifest(docs, block_levels=2)) == brute.manifest([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_sizes_of_runs(spark):
    # Groups of 0 to 28 leaves: complete runs, runs of one and two, and single leaves.
    rows = [(k, f"s{n:02d}", None, None, f"text {k}") for n in range(29) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(docs, block_levels=1)) == brute.manifest(rows)


def test_equal_rows_without_ids_and_one_group(spark):
    rows = [(None, None, "en", 1, "x")] * 500 + [(7, None, "en", 1, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert rows_of(merkle.manifest(docs, block_levels=2)) == brute.manifest(rows)


def test_no_rows_and_carried_columns(awkward):
    assert merkle.manifest(awkward.filter("false")).count() == 0
    cols = awkward.columns
    signed = merkle.manifest(awkward.withColumn("leaf", F.lit("mine")), carry=[*cols, "leaf"])
    assert signed.filter("leaf = 'mine'").count() == awkward.count() and "_leaf" in signed.columns


def test_a_proof_holds_for_its_leaf_alone(awkward):
    signed = merkle.manifest(awkward, block_levels=2, carry=["text"])
    honest = merkle.fold(F.col("leaf"), F.col("left"), F.col("right")) == F.col("root")
    forged = merkle.fold(F.sha2("leaf", 256), F.col("left"), F.col("right")) == F.col("root")
    counts = signed.select(honest.alias("h"), forged.alias("f")).groupBy("h", "f").count().collect()
    assert [(r["h"], r["f"]) for r in counts] == [(True, False)]


def test_fields_cannot_run_into_each_other(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("-", "abc")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(merkle.leaf_digest(F.col("a"), F.col("b")).alias("h")).distinct().count() == 5


def test_an_append_extends_only_witnesses_of_its_open_run():
    tree = merkle.Tree(3, 2)
    for node in "abc":
        tree.append(node)
    assert tree.left == [[""], ["a"], ["ab"]] and tree.right == [["bc"], ["c"], [""]]
    tree.append("d")
    assert tree.left[:3] == [[""], ["a"], ["ab"]] and tree.left[3] == []
    root = tree.close()
    assert root == brute.merkle(list("abcd"))[0] and len(tree.left[0]) == 2 == len(tree.left[3])
