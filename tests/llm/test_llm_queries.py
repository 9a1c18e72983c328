"""The registered queries beside SQL, and the pipeline beside a plain version."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from casemill.llm import catalog
from compare import compare, duck


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, folder, name):
    assert compare(catalog.QUERIES[name](spark, folder), duck(folder), catalog.SQL[name]) in (None, "no rows on either side")


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.parametrize("name", ["op4_ann_search", "op6_quality", "op7_jaccard_join", "op8_language_id"])
def test_runs_whole(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_pipeline_stage_by_stage(spark, folder):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = pq.read_table(f"{folder}/benchmark.parquet").to_pydict()
    items = list(zip(items["item_id"], items["text"]))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        ids = [r[0] for r in before]
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = docs.collect()
        if name != "shard":
            assert docs.columns == columns
        texts = [(r[0], r[1]) for r in before]
        if name == "language":
            assert len(after) > 0.95 * len(before) and not [r for r in after if not any(c.isalpha() for c in r["text"] or "")]
        if name == "near_duplicates":
            assert sorted(r[0] for r in after) == sorted({i for i, c, _ in brute.linked(texts) if i == c})
        if name == "decontaminate":
            assert sorted(r[0] for r in after) == sorted(i for i, _, h, _ in brute.contaminated(texts, items) if not h)
        if name == "mix":
            _, copies = brute.mixed([(r[0], r[1], r[3]) for r in before])
            assert sorted(r[0] for r in after) == sorted(i for i, _, c in copies for _ in range(c))
        if name == "shard":
            assert sorted((r["doc_id"], r["shard"]) for r in after) == sorted((i, brute.jump(i, 8)) for i in ids)


def test_pipeline_runs_and_agrees_with_itself(spark, folder):
    first, again = (corpus_pipeline.run(spark, folder) for _ in range(2))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_pipeline_on_awkward_rows(spark, sample_docs, no_docs, folder):
    for docs in (sample_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() >= 0


def test_near_copies_go_whatever_their_ids(spark, folder, sample_docs):
    """Texts that share an id or have none; of each class one row stays."""
    words = [f"word{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(w[::-1] for w in words)
    near = b.replace("1drow", "other", 1)
    rows = [(5, a), (5, b), (3, near), (None, b), (None, b), (5, a.upper()), (7, None), (8, None), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, folder).collect()), key=str)
    linked = [r for r in kept if r[1]]
    assert len(linked) == 2 and (3, near) in linked and linked[0 if linked[0][0] == 5 else 1][1].lower() == a
    assert sorted((r for r in kept if not r[1]), key=str) == sorted([(7, None), (8, None), (9, ""), (None, None)], key=str)


def test_url_sql_agrees_on_a_graph_of_links(spark, tmp_path):
    """Chains behind a blocked and a trusted host, a cycle, hubs, and a host that both reach."""
    import duckdb

    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(0, "http://evil.com/de/1", ""), (1, "http://good.org/", link("t0.net", "hub.net"))]
    rows += [(10 + k, f"http://b{k}.net/", link(f"b{k - 1}.net" if k else "evil.com")) for k in range(21)]
    rows += [(40 + k, f"http://t{k}.net/", link(f"t{k + 1}.net", f"b{k}.net")) for k in range(15)]
    rows += [(70, "http://hub.net/", link("c0.net", "c1.net", "b20.net")), (71, "http://c0.net/", link("c1.net")), (72, "http://c1.net/", link("c0.net", "evil.com"))]
    rows += [(100 + k, f"http://z{k}.net/", link(f"z{k - 1}.net" if k else "evil.com")) for k in range(21)]
    rows += [(80, None, "x"), (81, "http://alone.net/", None), (82, "http://b3.net/two", link("alone.net", "alone.net", "good.org"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(catalog.QUERIES["op2_url_filter"](spark, str(tmp_path)), con, catalog.SQL["op2_url_filter"]) is None
    verdicts = dict(con.execute(f"SELECT page_id, verdict FROM ({catalog.SQL['op2_url_filter']})").fetchall())
    assert verdicts[120] == "block" and verdicts[81] == "allow"  # twenty links behind the blocked host
