"""Quality rules beside a plain version."""

import random

import brute
from pyspark.sql import functions as F

from casemill.llm import rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain_row(i, text):
    counts = brute.rule_counts(text)
    kept = not counts[-1] and not brute.outside_bands(text, rules.WHOLE_BANDS, rules.CHUNK_BANDS)
    return (str(i), *counts, kept)


def rows_of(df):
    return sorted((str(r["id"]), *[r[c] for c in COUNTS], r["kept"]) for r in df.collect())


def test_samples(sample_docs, samples, no_docs):
    more = rules.judge_quality(sample_docs)
    assert rows_of(more) == sorted(plain_row(i, t) for i, t in samples)
    assert rules.judge_quality(no_docs).count() == 0


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows_of(rules.judge_quality(docs)) == sorted(plain_row(r[0], r[1]) for r in docs.select("doc_id", "text").collect())


def test_lines_symbols_and_code_points(spark):
    texts = ["a\n a\na\n\n\n \nA\nb\nb", "é# *$ü日%&|<>", "x y z x y z x", "x y z x y", "\x00 \x00\n\x00 \x00", "", None, "l\r\nl\r\nl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(rules.judge_quality(df)) == sorted(plain_row(i, t) for i, t in enumerate(texts))


def test_bands_reject_repetition_noise_and_mixed_chunks(spark):
    gen = random.Random(5)
    vocabulary = ["".join(gen.choices("etaoinshrdlu", k=gen.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(gen.choices(vocabulary, k=n))
    noise = lambda n: " ".join("".join(chr(gen.randint(0x21, 0x2FF)) for _ in range(8)) for _ in range(n))
    # Every word differs, so the base rules see nothing; compression does.
    counted = " ".join(f"a{'b' * 40}{k:04d}" for k in range(400))
    texts = [prose(300), prose(3000), noise(300), counted, prose(600) + " " + noise(300), prose(3000) + " " + noise(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["kept"], r["reason"]) for r in rules.judge_quality(df).collect()}
    assert [got[k][0] for k in range(6)] == [True, True, False, False, False, True]
    assert got[2][1] == "incompressible" and got[3][1] == "repetitive" and got[4][1] in ("chunks", "incompressible")
    assert [got[k][0] for k in range(6)] == [plain_row(k, t)[-1] for k, t in enumerate(texts)]


def test_the_same_at_any_batch_size_and_with_clashing_columns(spark, sample_docs):
    cols = sample_docs.columns
    carried = rules.judge_quality(sample_docs.withColumn("kept", F.lit("mine")), carry=[*cols, "kept"])
    assert carried.filter("kept = 'mine'").count() == sample_docs.count() and "_kept" in carried.columns
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        few = rows_of(rules.judge_quality(sample_docs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert few == rows_of(rules.judge_quality(sample_docs))
