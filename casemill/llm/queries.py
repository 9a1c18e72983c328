"""One query for each operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.ann import nearest
from casemill.llm.decontaminate import find_benchmark
from casemill.llm.jaccard import near_duplicates
from casemill.llm.language import learn_dictionaries, predict_language
from casemill.llm.merkle import fold, leaf_digest, manifest, proof_digest
from casemill.llm.mixing import mixing_cuts, with_copies
from casemill.llm.phrases import collocations
from casemill.llm.quality import score_quality
from casemill.llm.registry import query
from casemill.llm.rules import judge_quality
from casemill.llm.sharding import shard_table
from casemill.llm.substrings import remove_repeats
from casemill.llm.urls import MARGIN, Rule, judge_urls
from casemill.llm.warc import page_number, read_archives, write_archives
from casemill.session import shared_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i,
         unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS k
  FROM w WHERE len(ws) >= 13),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
hit AS (
  SELECT DISTINCT g.doc_id, g.i + t.j AS pos
  FROM g JOIN m ON g.k = m.k AND m.least < g.doc_id CROSS JOIN range(0, 13) AS t(j)),
gone AS (SELECT doc_id, list(pos) AS ps FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id""",
)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(_table(spark, folder, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_decontaminate",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT item_id, least(len(ws), 10) AS width,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS k
  FROM b WHERE len(ws) > 0),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT doc_id, width, unnest(range(1, len(ws) - width + 2)) AS i,
         unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS k
  FROM d CROSS JOIN widths WHERE len(ws) >= width),
m AS (SELECT doc_id, dw.width, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.width = bw.width),
hit AS (SELECT doc_id, count(DISTINCT i + t.j) AS n_hit FROM m CROSS JOIN range(0, 10) AS t(j) WHERE t.j < m.width GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_benchmark(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _jump_sql(shards: int) -> str:
    """The walk of a key as a fold over {b, j, k}, in 128-bit integers."""
    step = (
        "lambda s, x: CASE WHEN s.j < {n} THEN {{'b': s.j, "
        "'j': CAST(floor((s.j + 1) * (2147483648e0 / ((((s.k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1))) AS HUGEINT), "
        "'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616}} ELSE s END"
    ).format(n=shards)
    first = "{'b': CAST(-1 AS HUGEINT), 'j': CAST(0 AS HUGEINT), 'k': CAST(doc_id AS HUGEINT)}"
    return f"CAST(list_reduce(list_transform(range(0, {shards} + 2), lambda x: {first}), {step}).b AS INTEGER)"


@query(
    "op5_shard",
    f"""
WITH b AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, CAST(encode(coalesce(text, '')) AS BIT) AS bits FROM documents WHERE strlen(coalesce(text, '')) > 0
  UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE strlen(coalesce(text, '')) = 0),
c AS (
  SELECT doc_id, n + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(range(0, 8 * n), lambda i: CAST(get_bit(bits, CAST(i // 8 * 8 + 7 - i % 8 AS INTEGER)) AS BIGINT))),
           lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384 ELSE 0 END))) AS text_crc32
  FROM b),
s AS (SELECT doc_id, size, text_crc32, {_jump_sql(8)} AS shard, {_jump_sql(9)} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM s""",
)
def op5_shard(spark: SparkSession, folder: str) -> DataFrame:
    return shard_table(_table(spark, folder, "documents"), 8)


MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED = (5, 2, 1), 1.5, 2, 17


def mix_sql(seed: int = MIX_SEED) -> str:
    """Rows (doc_id, ..., copies) of the mix of a table ``documents`` with distinct ids, as the body of a query."""
    u = f"(CAST(('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0)"
    return rf"""
d0 AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, {u} AS u FROM documents),
d AS (SELECT *, least(63, CAST(floor(64 * size / CAST(size + 100 AS DOUBLE)) AS BIGINT)) + 1 AS k FROM d0),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size * 2 / w AS fill,
         (sum(source_size) OVER () * 1.5e0 - coalesce(sum(source_size) OVER before, 0) * 2)
           / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(level ORDER BY fill, source NULLS LAST) AS level FROM f WHERE level * w <= source_size * 2),
t AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM l) * w, 'Infinity'), source_size * 2e0) AS target FROM f),
c AS (
  SELECT d.source, k, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, k),
y AS (
  SELECT *, target - coalesce(sum(words) OVER higher, 0) * 2 AS rest,
         sum(words * k) OVER (PARTITION BY source) - coalesce(sum(words * k) OVER higher, 0) AS weighed
  FROM c WINDOW higher AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN weighed > 0 THEN rest / CAST(weighed AS DOUBLE) ELSE 0e0 END AS try FROM y),
v AS (SELECT source, coalesce(arg_max(try, k) FILTER (try * k <= 2), 2e0) AS level FROM z GROUP BY source),
x AS (
  SELECT d.*, source_size, target, least(2e0, level * k) AS expected FROM d
  JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN v ON d.source IS NOT DISTINCT FROM v.source),
q AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS part,
         target - sum(floor(expected) * size) OVER (PARTITION BY source) AS rest FROM x),
r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) ELSE 'Infinity' END, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q),
m AS (SELECT *, CASE WHEN source_size > 0 THEN whole + CAST(rest > 0 AND earlier + size / 2e0 <= rest AS BIGINT) ELSE 0 END AS copies FROM r)"""


def mixed(docs: DataFrame) -> DataFrame:
    cuts = mixing_cuts(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST, seed=MIX_SEED)
    return with_copies(docs, cuts, seed=MIX_SEED)


@query("op10_mix", f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM m")
def op10_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_table(spark, folder, "documents")).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
    )


URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_sql(rounds: int = 300) -> str:
    """Scores as the series of what seeds pass on, to a tail of 0.85 ** rounds."""
    def fits(r: Rule) -> str:
        return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"

    ordered = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in ordered) + " END"
    host = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE p0 AS (
  SELECT page_id, html, coalesce({host.format('url')}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p1 AS (SELECT *, {rule} AS rule FROM p0),
p AS (SELECT *, {verdict} AS ruled FROM p1),
h AS (SELECT host, count_if(ruled = 'allow') AS a, count_if(ruled = 'block') AS b FROM p GROUP BY host),
t0 AS MATERIALIZED (
  SELECT * FROM (
    SELECT 'trust' AS kind, host, a / (SELECT sum(a + b) FROM h) AS score FROM h
    UNION ALL SELECT 'distrust', host, b / (SELECT sum(a + b) FROM h) FROM h) WHERE score > 0),
l0 AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
l AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
share AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM l
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
flow AS (
  SELECT kind, host, score, 0 AS turn FROM t0
  UNION ALL
  SELECT flow.kind, share.dst, sum(0.85e0 * score * share), turn + 1
  FROM flow JOIN share ON flow.kind = share.kind AND flow.host = share.src WHERE turn < {rounds} GROUP BY flow.kind, share.dst, turn),
e AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
  FROM flow GROUP BY host)
SELECT page_id, p.host, path, rule,
       coalesce(ruled, CASE WHEN distrust > 0 AND distrust > trust * (1 + {MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN e ON p.host = e.host"""


@query("op2_url_filter", url_sql())
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op9_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS bits FROM pages),
d AS (
  SELECT page_id, strlen(body) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           CAST(1 + 16 * get_bit(bits, CAST(5 * i AS INTEGER)) + 8 * get_bit(bits, CAST(5 * i + 1 AS INTEGER))
             + 4 * get_bit(bits, CAST(5 * i + 2 AS INTEGER)) + 2 * get_bit(bits, CAST(5 * i + 3 AS INTEGER))
             + get_bit(bits, CAST(5 * i + 4 AS INTEGER)) AS INTEGER)]), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM f""",
)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = write_archives(_table(spark, folder, "pages"), f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    return read_archives(archives, payloads=False).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"),
    )


def _fold(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    learn = _fold("doc_id", 5) != 0
    scored = score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"), learn)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(_fold("id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def languages(docs: DataFrame) -> DataFrame:
    learned = learn_dictionaries(docs.filter(F.col("doc_id").isNotNull() & (_fold("doc_id", 4) != 2)))
    return predict_language(docs, learned)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(_table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.coalesce(_fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op4_ann_search")
def op4_ann_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(text: str) -> str:
    parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


@query(
    "op11_merkle_manifest",
    f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
         {_leaf_sql("replace(text, chr(10), '')")} AS cut
  FROM documents),
k AS MATERIALIZED (
  SELECT r, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(0, 8 * strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(get_bit(CAST(encode(CAST(doc_id AS VARCHAR)) AS BIT), CAST(i // 8 * 8 + 7 - i % 8 AS INTEGER)) AS BIGINT))),
         lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384 ELSE 0 END))) % 2 = 0 AS even
  FROM d),
o AS MATERIALIZED (
  SELECT d.*, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         CASE WHEN coalesce(even, false) THEN cut ELSE leaf END AS tampered
  FROM d JOIN k ON d.r = k.r),
up AS (
  SELECT 0 AS lvl, s, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM o
  UNION ALL
  SELECT lvl + 1, s, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY lvl, s, i // 3, n),
sub AS MATERIALIZED (SELECT s, s - 1 AS i, h, lvl AS top FROM up WHERE n = 1),
over_ AS (
  SELECT 0 AS lvl, i, h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM over_ WHERE n > 1 GROUP BY lvl, i // 3, n),
every AS MATERIALIZED (
  SELECT s, lvl, i, h FROM up WHERE n > 1
  UNION ALL SELECT sub.s, sub.top + over_.lvl, over_.i, over_.h FROM over_ JOIN sub ON true WHERE over_.n > 1),
way AS (
  SELECT r, o.s, lvl, CASE WHEN lvl < sub.top THEN o.i // CAST(pow(3, lvl) AS BIGINT) ELSE sub.i // CAST(pow(3, lvl - sub.top) AS BIGINT) END AS i
  FROM o JOIN sub ON o.s = sub.s JOIN range(0, 30) AS t(lvl) ON lvl < sub.top + (SELECT max(lvl) FROM over_)),
step AS MATERIALIZED (
  SELECT r, way.lvl, coalesce(string_agg(h, '' ORDER BY every.i) FILTER (every.i < way.i), '') AS l,
         coalesce(string_agg(h, '' ORDER BY every.i) FILTER (every.i > way.i), '') AS g
  FROM way JOIN every ON every.s = way.s AND every.lvl = way.lvl AND every.i // 3 = way.i // 3 GROUP BY r, way.lvl),
folded AS (
  SELECT r, 0 AS lvl, tampered AS h FROM o
  UNION ALL
  SELECT folded.r, folded.lvl + 1, sha256(l || h || g) FROM folded JOIN step ON folded.r = step.r AND folded.lvl = step.lvl),
e AS (SELECT r, arg_max(h, lvl) AS h FROM folded GROUP BY r),
proof AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY lvl)) AS p FROM step GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM over_ WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256,
       e.h AS folded_root, e.h = (SELECT h FROM over_ WHERE n = 1) AS verified
FROM o JOIN sub ON o.s = sub.s JOIN e ON o.r = e.r LEFT JOIN proof ON o.r = proof.r""",
)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    cut = F.translate("text", "\n", "")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = leaf_digest(*[F.when(even, cut).otherwise(F.col("text")) if c == "text" else F.col(c) for c in LEAF_FIELDS])
    signed = manifest(docs.withColumn("tampered", tampered), LEAF_FIELDS, carry=["tampered"])
    folded = signed.withColumn("folded_root", fold(F.col("tampered"), F.col("left"), F.col("right")))
    return folded.select(
        F.col("order_key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query(
    "op12_phrase_mining",
    r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w CROSS JOIN range(1, 5) AS t(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
t AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j AS cut, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
  FROM f CROSS JOIN range(1, 4) AS t(j) WHERE k >= 2 AND j < k),
c AS (
  SELECT t.*, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM t JOIN f AS x ON x.lang = t.lang AND x.phrase = head JOIN f AS y ON y.lang = t.lang AND y.phrase = tail),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT f.lang, f.f, array_to_string(f.ws[s:s + z - 1], ' ') AS phrase
  FROM f CROSS JOIN range(1, 4) AS t(s) CROSS JOIN range(2, 4) AS u(z) WHERE f.k >= 3 AND z < f.k AND s + z - 1 <= f.k),
e AS (SELECT lang, phrase, max(f) AS f FROM i GROUP BY lang, phrase),
k AS (SELECT m.* FROM m LEFT JOIN e ON m.lang = e.lang AND m.phrase = e.phrase WHERE e.f IS NULL OR CAST(100 AS HUGEINT) * e.f < CAST(80 AS HUGEINT) * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000""",
)
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


@query("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_quality(_table(spark, folder, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "ratio", "n_chunks", "n_chunks_out", "reason")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # at the repository top; its stages use the operators above

    return corpus_pipeline.run(spark, folder)
