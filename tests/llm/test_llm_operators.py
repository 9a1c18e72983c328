"""Every dealt operator beside its plain version, on awkward rows and on the given tables."""

import io
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from casemill.llm import ann, decontaminate, jaccard, language, mixing, quality, sharding, substrings, tokens, urls, warc


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(got, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, wanted), key=key)


def documents(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "source", "lang"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], t["lang"]))


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_words_are_those_of_the_pattern(samples, monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "PIECE", piece)
    texts = [t for _, t in samples if t is None or len(t) < 5000]
    data, offsets = tokens.text_buffers(pa.array(texts, pa.string()))
    for table, pattern in ((tokens.PLAIN, brute.plain), (tokens.FOLDED, brute.folded)):
        w = tokens.find_words(data, offsets, table)
        found = {}
        for k, text in enumerate(texts):
            mine = [data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])]
            wanted = pattern(text)
            assert [m.translate(brute.LOWER) if table is tokens.FOLDED else m for m in mine] == wanted
            for code, word in zip(w.code[w.first[k] : w.first[k + 1]].tolist(), wanted):
                assert found.setdefault(word, code) == code
        assert len(set(found.values())) == len(found)


def test_a_window_has_one_representative_wherever_it_stands():
    rng = random.Random(5)
    for _ in range(60):
        inner = [rng.choice([1, 2, 3, 3, 4, 5, 9]) for _ in range(13)]
        keys = set()
        for _ in range(6):
            left, right = ([rng.choice([1, 2, 3, 4, 5, 9]) for _ in range(rng.randrange(0, 9))] for _ in range(2))
            code = tokens.mix(np.array(left + inner + right, np.uint64))
            keys.add(int(substrings.representatives(code, np.array([0, len(code)]), 13)[len(left)]))
        assert len(keys) == 1


@pytest.mark.parametrize("groups", [1, None, 37])
def test_substrings(sample_docs, samples, groups):
    got = substrings.remove_repeats(sample_docs, groups=groups)
    same(rows(got, "id", "n_words", "n_removed", "kept"), brute.without_repeats(samples))


def test_substrings_of_short_windows_and_no_rows(sample_docs, samples, no_docs):
    got = substrings.remove_repeats(sample_docs, width=3)
    same(rows(got, "id", "n_words", "n_removed", "kept"), brute.without_repeats(samples, 3))
    assert substrings.remove_repeats(no_docs).count() == 0


ITEMS = [(1, None), (2, ""), (3, "one word"), (4, "word"), (None, "changed river"), (7, "Word")]


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_benchmark(spark, sample_docs, samples, no_docs, bound):
    items = [*ITEMS, (5, samples[10][1]), (6, samples[9][1]), (8, samples[10][1])]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_benchmark(sample_docs, table, broadcast_windows=bound, carry=["id", "source"])
    assert got.columns[-7:] == ["id", "source", "n_words", "n_hit", "items", "starts", "ends"]
    got = [(r[0], *r[-5:]) for r in got.collect()]
    same([(i, n, h, items) for i, n, h, items, _, _ in got], brute.contaminated(samples, items))
    assert all(h == sum(e) - sum(s) for _, _, h, _, s, e in got)
    assert decontaminate.find_benchmark(no_docs, table, broadcast_windows=bound).count() == 0
    clean = decontaminate.find_benchmark(sample_docs, table.filter("false"), broadcast_windows=bound)
    assert clean.filter("n_hit > 0").count() == 0 and clean.count() == len(samples)


def test_jaccard_on_samples(sample_docs, samples, no_docs):
    same(rows(jaccard.near_duplicates(sample_docs), "id", "class_id", "n_links"), brute.linked(samples))
    small = jaccard.near_duplicates(sample_docs, block=2)  # clusters cut into several blocks
    same(rows(small, "id", "class_id", "n_links"), brute.linked(samples))
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_jaccard_on_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(rows(jaccard.near_duplicates(df, block=64), "id", "class_id", "n_links"), brute.linked(docs))


def test_jaccard_on_documents(spark, folder):
    docs = [(i, t) for i, t, _, _ in documents(folder)]
    got = jaccard.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    same(rows(got, "id", "class_id", "n_links"), brute.linked(docs))


def test_forest_depth_keeps_the_recall():
    depth = jaccard.forest_depth()
    assert (1 - 0.8**depth) ** jaccard.TREES <= jaccard.MISSED < (1 - 0.8 ** (depth + 1)) ** jaccard.TREES
    assert jaccard.forest_depth(trees=1, missed=0.0) == 1


def test_jump_hash(spark):
    keys = [0, 1, 2, 3, -1, 10**18, 2**63 - 1, -(2**63), *range(100, 400)]
    for shards in (1, 2, 8, 9, 200):
        df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s"))
        assert {r["k"]: r["s"] for r in df.collect()} == {k: brute.jump(k, shards) for k in keys}


def test_sharding(spark, sample_docs, samples, no_docs):
    got = sharding.shard_table(sample_docs, 8).collect()
    assert len(got) == len(samples)
    text = {}
    for i, t in samples:
        text.setdefault(i, set()).add(t)
    for r in got:
        assert any(r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) for t in text[r["doc_id"]])
        assert r["shard"] == brute.jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        part = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert [r["doc_id"] for r in part if r["doc_id"] is not None] == sorted(r["doc_id"] for r in part if r["doc_id"] is not None)
    assert sharding.shard_table(no_docs, 8).count() == 0


def test_mixing(spark, sample_docs, no_docs):
    plain = [(r["doc_id"], r["text"], r["source"]) for r in sample_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    df = spark.createDataFrame(plain, "doc_id long, text string, source string").withColumn("rank", F.lit(3))
    got = mixing.with_copies(df, mixing.mixing_cuts(df, (5, 2, 1), 1.5)).collect()
    targets, copies = brute.mixed(plain)
    assert {r["source"]: (r["_source_size"], pytest.approx(r["_target"])) for r in got} == targets
    same([(r["doc_id"], r["_size"], r["_copies"]) for r in got], copies)
    again = mixing.with_copies(df.repartition(3), mixing.mixing_cuts(df.repartition(2), (5, 2, 1), 1.5)).collect()
    same(got, again)
    assert mixing.with_copies(no_docs, mixing.mixing_cuts(no_docs, (5, 2, 1), 1.5)).count() == 0
    # nulls and repeated rows: nobody exceeds two copies and the whole stays near the share
    loose = mixing.with_copies(sample_docs, mixing.mixing_cuts(sample_docs, (5, 2, 1), 1.5)).collect()
    assert all(r["_taken"] <= 2 * r["_size"] for r in loose)


def _by_source(df, cuts_of=(5, 2, 1), share=1.5):
    got = mixing.with_copies(df, mixing.mixing_cuts(df, cuts_of, share))
    return got, got.groupBy("source").agg(F.sum("_taken").alias("t"), F.first("_target").alias("g"), F.max("_size").alias("m")).collect()


def test_mixing_reaches_targets(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    sums = _by_source(df)[1]
    assert sums and all(abs(r["t"] - r["g"]) <= r["m"] / 2 + 1 for r in sums)


def test_mixing_splits_blocks_of_equal_rows(spark, tmp_path):
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), 10))
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    others = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    nameless = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", text, F.col("id") % 900).alias("text"), F.lit("c").alias("source"))
    copies.union(others).union(nameless).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for share in (0.1, 0.75, 1.5):
        got, sums = _by_source(df, share=share)
        assert len(sums) == 3 and all(abs(r["t"] - r["g"]) <= r["m"] for r in sums), sums
    taken = got.select("doc_id", "_copies").filter("doc_id = 7").groupBy("_copies").count().collect()
    assert sum(r["count"] for r in taken) == 100_000
    # Every copy of a text has the same expectation, so the counts of copies differ by one at most.
    assert max(r["_copies"] for r in taken) - min(r["_copies"] for r in taken) <= 1


def test_inclusion_follows_the_measure(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (4, 30, 100, 400)[i % 4]), "s") for i in range(20_000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for share in (0.2, 0.9, 1.3):
        got, sums = _by_source(df, (1,), share)
        assert abs(sums[0]["t"] - sums[0]["g"]) <= 200
        expected = brute.expected_copies([len(t.split()) for _, t, _ in rows[:4]] * 5000, sums[0]["g"])[:4]
        mean = {r["_size"]: r["c"] for r in got.groupBy("_size").agg(F.avg("_copies").alias("c")).collect()}
        for n, e in zip((4, 30, 100, 400), expected):
            assert abs(mean[n] - e) < 0.03
        assert share > 1 or mean[4] < mean[30] < mean[100] < mean[400]


URLS = [
    (1, "http://A.Example.org/es/1?x", None), (2, "https://example.org/en/12#t", ""), (3, "https://notexample.org/x", ""), (4, "ftp://x.com/fr/", ""),
    (5, "http://x.com/de/?q=/fr/", ""), (6, "http://x.com", '<a href="no link">'), (7, None, "x"), (8, "no scheme", '<a href="http://b.net/">'),
    (9, "http://good.org/", "<a HREF='//mid.net/a'> <a href=http://MID.net:1/>"), (10, "http://mid.net/p", '<a href="https://far.net?x">'),
    (11, "http://far.net/p", '<a href="/here">'), (12, "http://bad.net/p", '<a href="http://evil.com/de/1">'), (13, "http://evil.com/de/1", ""),
    (14, "http://evil.com/x", ""), (15, "://", ""), (16, "http://com/fr/\n", ""), (1, "http://A.Example.org/es/1?x", None),
]
RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    got = {r["page_id"]: r for r in urls.judge_urls(df, RULES).collect()}
    judged = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert judged[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert judged[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert judged[3] == ("notexample.org", "/x", "org/", "allow")
    assert judged[4][2:] == ("com/fr/", "allow") and judged[5][1:] == ("/de/", "com/de/", "block")
    assert judged[7] == ("", "", None, "allow") and judged[8] == ("", "", None, "allow")
    assert judged[16][:2] == ("com", "/fr/\n")
    assert judged[10][3] == "allow" and judged[11][3] == "allow" and got[11]["trust"] > 0  # trusted by way of mid.net
    assert judged[12][3] == "block" and got[12]["distrust"] > 0  # links to what is blocked
    assert judged[14][3] == "block"
    assert urls.judge_urls(df, RULES).count() == len(URLS) and urls.judge_urls(df.filter("false"), RULES).count() == 0


def test_faint_and_far_distrust_blocks(spark):
    link = lambda k, a, b: (k, f"http://{a}/", f'<a href="http://{b}/">')
    chain = [link(k, f"c{k}.net", f"c{k - 1}.net" if k else "evil.com") for k in range(20)]
    hub = [link(1000 + k, f"h{k}.net", "evil.com") for k in range(1000)]
    faint = [link(3000 + k, f"f{k}.net", "h0.net") for k in range(1000)]
    pages = [*chain, *hub, *faint, (1, "http://evil.com/de/1", "")]
    ruled = spark.range(200_000).select((F.col("id") + 10_000).alias("page_id"), F.lit("http://good.com/fr/").alias("url"), F.lit("").alias("html"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").unionByName(ruled)
    got = urls.judge_urls(df, RULES).filter("host LIKE '%.net'").collect()
    assert len(got) == 2020 and {r["verdict"] for r in got} == {"block"}
    assert 0 < min(r["distrust"] for r in got) < 1e-12


def test_propagation_runs_to_its_fixed_point(spark):
    links = [("a", "b", 1), ("b", "a", 1), ("b", "c", 3), ("c", "b", 1)]
    df = spark.createDataFrame(links, "src string, dst string, n long")
    got = urls.propagate(spark.createDataFrame([("a", 1e-9, 0.0)], "host string, trust double, distrust double"), df)
    m = np.array([[0, 0.25, 0], [1, 0, 1], [0, 0.75, 0]])
    wanted = np.linalg.solve(np.eye(3) - 0.85 * m, [0.15e-9, 0, 0])
    assert {r["host"]: r["trust"] for r in got.collect()} == pytest.approx(dict(zip("abc", wanted)), rel=1e-9)


def test_propagation_is_personalised_pagerank(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 4), ("d", "c", 1)]
    seeds = [("a", 1.0, 0.0), ("d", 0.0, 1.0), ("c", 0.0, 0.5)]
    got = urls.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long"), rounds=12)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    names = "abcd"
    out, back = np.zeros((4, 4)), np.zeros((4, 4))
    for s, d, n in links:
        out[names.index(d), names.index(s)] = n
        back[names.index(s), names.index(d)] = n
    for k, (m, seed) in enumerate(((out, [1, 0, 0, 0]), (back, [0, 0, 0.5, 1]))):
        m = m / np.where(m.sum(0) > 0, m.sum(0), 1)
        x = seed = np.array(seed, float)
        for _ in range(12):
            x = 0.15 * seed + 0.85 * m @ x
        assert all(got.get(h, (0, 0))[k] == pytest.approx(x[i]) for i, h in enumerate(names))


PAGES = [(1, "http://a/\r\nX: y", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "u", "ü" * 70_000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "n", "same"), (2, "http://b/", "same"), (7, "u", "ü" * 70_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("path", F.lit(1))
    archives = warc.write_archives(df.repartition(3), f"{tmp_path}/w", min_revisit=least, archive_bytes=300)
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES)
    got = warc.read_archives(archives).withColumn("p", warc.page_number("record_id")).withColumn("r", warc.page_number("refers_to")).collect()
    assert len(got) == len(PAGES)
    body = {i: (h or "").encode() for i, _, h in PAGES}
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for r in got:
        whole = body[r["p"]]
        refers = first[whole.decode()] if len(whole) >= least and first[whole.decode()] != r["p"] else None
        assert (r["payload_bytes"], r["record_type"], r["r"]) == (len(whole), "revisit" if refers else "response", refers)
        assert r["payload"] == (None if refers else whole)
    empty = warc.write_archives(df.filter("false"), f"{tmp_path}/none")
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_warc_detects_damage():
    good = warc._member(warc.record_bytes(1, "u", b"payload", "AAAA", None), 6)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(good)))
    import base64, hashlib  # noqa: E401

    digest = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    record = warc.record_bytes(1, "u", b"payload", digest, None)
    assert len(list(warc.read_records(io.BytesIO(warc._member(record, 6) * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc._member(record, 6)[:-9])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc._member(record[:-6], 6))))


def test_ann_is_exact_on_few_rows_and_awkward_ones(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=6).round(2).tolist() for i in range(40)}
    vectors |= {100 + i: vectors[3] for i in range(30)}  # equal vectors, more than a query asks for
    odd = [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None] + [0.0] * 4), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (206, [1.0, 2.0]), (None, [1.0] * 6)]
    table = [*vectors.items(), *odd, (5, vectors[5])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("shard", F.lit(0))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0, shard_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = brute.nearest(vectors, [i for i in vectors if i % 5 == 0])
    assert set(got) == set(wanted)
    for q, best in wanted.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1] for m in mine] == [i for _, i in best]
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in best], abs=1e-12)
    assert ann.nearest(df.filter("false"), F.col("vec_id") % 5 == 0).count() == 0
    two = ann.nearest(df.filter("vec_id in (1, 5)"), F.col("vec_id") % 5 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(5, 1, 1)]


def test_ann_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vectors = dict(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = brute.nearest(vectors, [i for i in vectors if i % 20 == 0])
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(found[q] & {i for _, i in best}) / len(best) for q, best in wanted.items()])
    assert recall >= 0.9


def test_ann_recall_beside_outliers_of_norm(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:10] *= np.array([1e-3, 1e-3, 0.1, 7, 30, 1e3, 1e5, 1e10, 1e20, 1e20])[:, None]
    x[10:60] *= 10.0 ** rng.uniform(-3, 20, 50)[:, None]
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    for some in (range(2000), [*range(60, 2000), 6], [*range(60, 2000), 8]):
        mine = {i: vectors[i] for i in some}
        df = spark.createDataFrame(list(mine.items()), "vec_id long, embedding array<double>")
        wanted = brute.nearest(mine, [i for i in mine if i % 20 == 0])
        found = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert all(len(found[q]) == 20 for q in wanted)
        assert np.mean([len(found[q] & {i for _, i in best}) / 20 for q, best in wanted.items()]) >= 0.95


def _ann_set(name):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000 if name == "gaussian, two shards" else 6000, 64))
    if name == "log-normal norms":
        x *= np.exp(0.6 * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1)[:, None]
    if name == "tight clusters":
        x = (rng.normal(size=(60, 1, 64)) + 0.05 * rng.normal(size=(60, 100, 64))).reshape(-1, 64)
    return x


@pytest.mark.parametrize("name", ["gaussian", "gaussian, two shards", "log-normal norms", "tight clusters"])
def test_ann_recall_of_vectors_of_differing_norms(spark, name):
    x = _ann_set(name)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(found[q] & set(np.argpartition(-score, 20)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.5


def test_bands_hold_all_nodes_and_similar_norms():
    norm = np.concatenate([np.full(500, 1.0), np.full(300, 1 - 1e-16), np.linspace(3, 9, 700), [1e-300, 1e250, 55.0]])
    order, bands = ann.norm_bands(norm)
    assert sorted(order.tolist()) == list(range(len(norm))) and bands[0] == 0
    for a, b in zip(bands, bands[1:]):
        part = norm[order[a:b]]
        assert len(part) >= ann.BAND_LEAST and part.max() / part.min() <= ann.BAND_RATIO * (1 + 1e-9)
    assert {1e-300, 1e250, 55.0} <= set(norm[order[bands[-1] :]].tolist())


def test_unreached_nodes_become_entry_points():
    edges = np.array([[1, -1], [0, -1], [3, -1], [-1, -1], [2, -1]])
    assert ann.with_unreached(edges, np.array([0])).tolist() == [0, 2, 4]


def test_pruning_keeps_diverse_neighbours():
    line = np.array([[0.0, 0], [1, 0], [2, 0], [0, 1.5], [0, 3]], np.float32)
    kept = ann._prune(line, np.array([0]), np.array([[1, 2, 3, 4, 0, 1]]), 4, 1.0)
    assert [x for x in kept[0] if x >= 0] == [1, 3]  # 2 and 4 are covered by nearer ones


def test_language(spark, folder, no_docs):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = language.learn_dictionaries(df.filter(fold != 2))
    got = language.predict_language(df, learned, carry=["lang", "source"])
    assert got.columns == ["id", "lang", "source", "lang_pred", "score", "rejected"]
    held = got.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93
    assert got.filter("score < 0 or score > 1").count() == 0 and got.count() == df.count()
    assert language.learn_dictionaries(no_docs) == {}


def test_language_of_awkward_texts(sample_docs, samples, no_docs):
    known = {"aa": b"the of and river stone " * 40, "bb": b"zug und haus oder nicht " * 40}
    got = language.predict_language(sample_docs, known).collect()
    assert len(got) == len(samples)
    letters = {i: any(c.isalpha() for c in t or "") for i, t in samples if i is not None}
    for r in got:
        if r["id"] is not None:
            assert (r["lang_pred"] == "und") == (not letters[r["id"]]) and r["rejected"] >= (r["lang_pred"] == "und")
    assert all(r["lang_pred"] == "und" for r in language.predict_language(sample_docs, {}).collect())
    assert language.predict_language(no_docs, known).count() == 0


def test_language_needs_a_clear_margin(spark):
    rng = random.Random(4)
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = language.learn_dictionaries(df.filter(fold != 2))
    clean = df.filter((fold == 2) & (F.length("text") >= 200))
    kept = language.predict_language(clean, learned, carry=["lang"]).filter("NOT rejected")
    assert kept.count() >= 0.99 * clean.count() and kept.filter("lang = lang_pred").count() >= 0.99 * kept.count()
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (1, 5, 30, 300, 3000) for _ in range(20)]
    noise = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    for known in (learned, {k: learned[k] for k in ("de", "en")}, {"en": learned["en"]}, {"aa": learned["en"], "bb": learned["en"]}):
        assert language.predict_language(noise, known).filter("NOT rejected").count() == 0
    # equal dictionaries tie on every text; a language that was not learned is none of the others
    assert language.predict_language(clean, {"aa": learned["en"], "bb": learned["en"]}).filter("NOT rejected").count() == 0
    for left_out in ("de", "fr"):
        other = clean.filter(F.col("lang") == left_out)
        for known in ({k: v for k, v in learned.items() if k != left_out}, {"en": learned["en"]}):
            assert language.predict_language(other, known).filter("rejected").count() >= 0.9 * other.count()


def test_quality(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = quality.score_quality(docs, labels, fold != 0)
    assert got.filter("score < 0 or score > 1").count() == 0 and got.count() == docs.count()
    both = got.join(labels, got["id"] == labels["doc_id"]).filter(fold == 0)
    assert both.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.85


def test_quality_of_awkward_texts(spark, sample_docs, samples, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1), (10, 1), (11, 0), (12, 1), (13, 0)], "doc_id long, quality int")
    got = quality.score_quality(sample_docs, labels, F.lit(True)).collect()
    assert len(got) == len(samples) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_quality(sample_docs, labels.filter("false"), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels, F.lit(True)).count() == 0


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1])))
    y = (rng.random(4000) < p).astype(int)
    s = quality.train_network(x[:3000], y[:3000]).score(x[3000:])
    assert abs(s.mean() - y[3000:].mean()) < 0.05 and np.mean((s - p[3000:]) ** 2) < 0.02
