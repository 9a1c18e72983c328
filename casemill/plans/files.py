"""Queries: file sources and sinks, fed with files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.operators import metrics, splits
from casemill.plans import detector, experiments
from casemill.plans.registry import SQL, TX, query
from casemill.plans.reviews import REPORTS_SQL, run_texts
from casemill.plans.texts import _VERDICTS_SQL, _verdicts
from casemill.session import shared_dir
from casemill.sources import files, sinks
from casemill.sources.tables import load, transactions
from casemill.sources.versions import VersionedLog

R = F.round


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s2_multi_file_ingest",
    """SELECT 'T' || o_orderkey AS trans_num, o_custkey AS cc_num, round(o_totalprice, 2) AS amt,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS category FROM orders WHERE o_orderstatus <> 'P'""",
)
def s2_multi_file_ingest(spark, d):
    # Two header layouts, and one kind of file without the key column that must be skipped.
    base = _new(spark, "raw")
    orders = load(spark, d, "orders").select(
        F.concat(F.lit("T"), F.col("o_orderkey")).alias("trans_num"), F.col("o_custkey").alias("cc_num"),
        R("o_totalprice", 2).alias("amt"), F.col("o_orderpriority").alias("category"), "o_orderstatus",
    )
    for status, cols in (
        ("F", ["trans_num", "cc_num", "amt", "category"]), ("O", ["cc_num", "trans_num", "amt"]), ("P", ["cc_num", "amt"]),
    ):
        rows = orders.filter(F.col("o_orderstatus") == status).select(*cols)
        if status == "P":  # a data line that looks like a header does not make these files count
            rows = rows.withColumn("amt", F.lit("trans_num"))
        rows.write.option("header", True).option("sep", "|").csv(f"{base}/{status}")
    return files.read_raw_folder(spark, f"{base}/*").select("trans_num", "cc_num", "amt", "category")


@query(
    "p7_prepare_raw",
    """WITH g AS (SELECT o_orderkey, c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey, o_totalprice, o_orderpriority,
         CAST(o_orderdate AS DATE) AS day, o_orderkey % 24 AS h, o_orderkey % 60 AS mi, c_custkey % 90 * 1e0 AS la1, c_custkey % 180 * 1e0 AS lo1,
         c_nationkey * 3e0 AS la2, c_nationkey * 7e0 AS lo2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
       SELECT printf('%s %02d:%02d:30', strftime(day, '%Y-%m-%d'), h, mi) AS marca_temporal, 'T' || o_orderkey AS trans_num, c_custkey AS cc_num,
         c_name AS comercio, c_mktsegment AS categoria, o_totalprice AS importe, round(h + mi / 60e0, 9) AS hora,
         CAST(isodow(day) - 1 AS INTEGER) AS dia_semana, round(date_diff('day', DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER), day) / 365.25e0, 9) AS edad,
         round(2 * 6371e0 * asin(sqrt(pow(sin((radians(la2) - radians(la1)) / 2), 2)
           + cos(radians(la1)) * cos(radians(la2)) * pow(sin((radians(lo2) - radians(lo1)) / 2), 2))), 6) AS distancia_km,
         c_custkey * 10 AS poblacion_ciudad, 'N' || c_nationkey AS city, 'S' || c_nationkey AS state, c_mktsegment AS job,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS es_fraude FROM g""",
)
def p7_prepare_raw(spark, d):
    """Raw delimited files of two layouts and one without the key column, read and prepared."""
    base = _new(spark, "business")
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    key, cust, nation = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_nationkey")
    raw = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderstatus",
        F.concat(F.lit("T"), key).alias("trans_num"), cust.alias("cc_num"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("trans_date"), F.format_string("%02d:%02d:30", key % 24, key % 60).alias("trans_time"),
        F.concat(F.lit("fraud_"), "c_name").alias("merchant"), F.col("c_mktsegment").alias("category"), F.col("o_totalprice").alias("amt"),
        F.date_add(F.lit("1950-01-01").cast("date"), (cust % 18000).cast("int")).alias("dob"),
        (cust % 90).cast("double").alias("lat"), (cust % 180).cast("double").alias("long"), (nation * 3.0).alias("merch_lat"), (nation * 7.0).alias("merch_long"),
        (cust * 10).alias("city_pop"), F.concat(F.lit("N"), nation).alias("city"), F.concat(F.lit("S"), nation).alias("state"), F.col("c_mktsegment").alias("job"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_fraud"),
    )
    columns = raw.columns[1:]
    for status, cols in (("F", columns), ("O", columns[::-1]), ("P", columns[1:])):
        raw.filter(F.col("o_orderstatus") == status).select(*cols).write.option("header", True).option("sep", "|").csv(f"{base}/{status}")
    out = files.prepare_business(files.read_raw_folder(spark, f"{base}/*"))
    return out.withColumns(
        {
            "marca_temporal": F.date_format("marca_temporal", "yyyy-MM-dd HH:mm:ss"),
            "hora": R("hora", 9), "edad": R("edad", 9), "distancia_km": R("distancia_km", 6),
        }
    )


@query("s4_split_sink", SQL["d4_split_summary"])
def s4_split_sink(spark, d):
    path = _new(spark, "split")
    rows = splits.temporal_split(transactions(spark, d), "t_sec", "tx_id").select("tx_id", "amount", "label", "split")
    sinks.write_split(rows, path)
    back = spark.read.option("header", True).schema("tx_id bigint, amount double, label int, split string").csv(path)
    return splits.split_summary(back, "split", "label").withColumn("prevalence", R("prevalence", 9))


@query(
    "s5_jsonl_sink",
    f"""WITH p AS ({SQL['d16_val_split']}), c AS (SELECT p.part, t.* FROM p JOIN (WITH {TX} SELECT * FROM tx) t USING (tx_id))
      SELECT count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val,
      count(*) FILTER (part = 'train' AND label = 1) AS positives_train, count(*) FILTER (part = 'train' AND label = 1 AND amount <= 5) AS low_positives_train FROM c""",
)
def s5_jsonl_sink(spark, d):
    path = _new(spark, "jsonl")
    rows = splits.hash_split(transactions(spark, d).filter(F.col("prob") >= 0.4), "tx_id", 0.1)
    sinks.write_training_json(rows.select("tx_id", "amount", "label", "part"), path)
    back = spark.read.schema("tx_id bigint, amount double, label int, part string").json(path)
    return sinks.training_summary(back)


@query(
    "s6_run_log_append",
    f"WITH {experiments.RUNLOG_SQL} SELECT concat_ws('/', model, mode, level, seed, repetition) AS run_id, n_rows FROM runlog0",
)
def s6_run_log_append(spark, d):
    path = _new(spark, "runlog")
    log = experiments.full_run_log(spark, d).select(
        F.concat_ws("/", "model", "mode", "level", "seed", "repetition").alias("run_id"), "model", "n_rows"
    )
    # Two writers start from the first half: one brings everything, one the second half, and it all again.
    first = sinks.append_runs(log.filter(F.col("model") == "m_a"), path)
    second = sinks.append_runs(log.unionByName(log), path, base=first.version)
    third = sinks.append_runs(log.filter(F.col("model") == "m_b"), path, base=first.version)
    if second.conflict or not third.conflict:
        raise RuntimeError("the second of two writers must learn of the first")
    sinks.append_runs(log, path)
    return VersionedLog(spark, path, ["run_id"]).read().select("run_id", "n_rows")


@query("s8_metric_docs", f"SELECT * REPLACE ('temporal' AS split) FROM ({SQL['e8_model_table']}) WHERE split = 'test'")
def s8_metric_docs(spark, d):
    path = _new(spark, "metrics")
    tx = splits.temporal_split(transactions(spark, d), "t_sec", "tx_id").withColumn(
        "split", F.when(F.col("split") == "test", "temporal").otherwise("train")
    )
    table = metrics.metric_block(detector._three_scores(tx), "score", "label", "tx_id", by=["model", "split"])
    # One document: an array of records, a handful of models wide.
    doc = table.select(F.to_json(F.struct("*")).alias("r")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value")
    )
    doc.write.text(path)
    return detector._rounded(files.read_metric_documents(spark, path), "model", "split")



@query(
    "s9_window_docs",
    f"""WITH {TX}, o AS (SELECT min(t_sec) AS s FROM tx), w AS (SELECT m, floor((t_sec - s) / (m * 60e0)) AS win, count(*) FILTER (prob >= 0.8e0) AS c FROM tx, o, (VALUES (30), (60), (120)) v(m) GROUP BY 1, 2)
      SELECT CAST(m AS DOUBLE) AS ventana_min, round(sum(CASE WHEN c > 0 THEN (least(c, 60) + 2) * 6.8e0 ELSE 0 END) / (count(*) * m * 60e0), 9) AS ocupacion FROM w WHERE m <> 120 GROUP BY m""",
)
def s9_window_docs(spark, d):
    from casemill.operators import windows

    path = _new(spark, "windows")
    tx = transactions(spark, d)
    for minutes in (30, 60, 120):
        log = windows.window_log(windows.with_window(tx, "t_sec", minutes * 60), "t_sec", minutes * 60)
        o = windows.occupancy(log, minutes * 60).withColumn("ventana_min", F.lit(float(minutes)))
        # The last size writes an incomplete document, which the reader must skip.
        kept = ["ventana_min", F.col("occupancy").alias("ocupacion")] if minutes < 120 else ["ventana_min"]
        o.select(F.to_json(F.struct(*kept)).alias("value")).write.text(f"{path}/{minutes}")
    docs = files.read_window_documents(spark, f"{path}/*")
    return docs.withColumn("ocupacion", R("ocupacion", 9))


@query(
    "s10_report_scan",
    f"WITH {REPORTS_SQL} SELECT 'm_' || (run_id % 2) AS model, 'revisa' AS mode, CAST(run_id AS INTEGER) AS seed, 1 AS repetition, text FROM reports",
)
def s10_report_scan(spark, d):
    path = _new(spark, "reports")
    page = F.concat(
        F.lit("# Ejecucion\n\n## Informe final\n"), F.col("text"),
        F.lit("\n---\n\n## Salida del Investigador\n\nnotas\n"),
    )
    name = F.concat(F.lit("m_"), F.col("run_id") % 2, F.lit("_revisa_s"), F.col("run_id"), F.lit("_r1.md"))
    pages = run_texts(spark, d).select(page.alias("value"), name.alias("name"))
    pages.write.partitionBy("name").text(path)
    return files.read_reports(spark, path)


@query(
    "z7_json_verdicts",
    f"WITH {_VERDICTS_SQL} SELECT run_id, case_no, verdict FROM verdicts",
)
def z7_json_verdicts(spark, d):
    # One verdict object per run, keyed by case number; the case file bounds its size.
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("case_no").cast("string"), "verdict")))
    docs = _verdicts(spark, d).groupBy("run_id").agg(F.to_json(entries).alias("veredictos"))
    return files.json_verdicts(docs, ["run_id"], "veredictos")
