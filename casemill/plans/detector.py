"""Queries: scans, projections, filters, splits, samples, selection, detector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import scalar as S
from casemill.operators import metrics, profile, sampling, selection, splits
from casemill.operators.ranks import before
from casemill.plans.registry import TX, hash32_sql, query
from casemill.sources.tables import embedding_rows, load, scored_transactions, transactions

R = F.round


# ---- scans and profile -------------------------------------------------------------


@query("s1_scan_tx", f"WITH {TX} SELECT tx_id, t_sec, amount, label, hour FROM tx")
def s1_scan_tx(spark, d):
    return transactions(spark, d).select("tx_id", "t_sec", "amount", "label", "hour")


@query(
    "s3_profile",
    f"""WITH {TX} SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives,
      round(avg(label), 9) AS positive_share,
      count(*) - count(amount) + count(*) - count(t_sec) + count(*) - count(k) AS nulls,
      min(amount) AS min_amount, round(median(amount), 9) AS median_amount, max(amount) AS max_amount,
      count(*) = 284807 AND sum(label) = 492 AS as_expected FROM tx""",
)
def s3_profile(spark, d):
    return profile.dataset_profile(transactions(spark, d), "label", "amount", ["amount", "t_sec", "k"])


# ---- projections -------------------------------------------------------------------


@query("p1_hour_of_day", f"WITH {TX} SELECT tx_id, (t_sec / 3600e0) % 24e0 AS hour FROM tx")
def p1_hour_of_day(spark, d):
    return transactions(spark, d).select("tx_id", S.hour_of_day(F.col("t_sec")).alias("hour"))


@query("p2_risk_tier", f"WITH {TX} SELECT tx_id, tier FROM tx")
def p2_risk_tier(spark, d):
    return transactions(spark, d).select("tx_id", S.risk_tier(F.col("prob")).alias("tier"))


@query(
    "p3_calendar",
    """SELECT event_id AS tx_id, round(hour(ts) + minute(ts) / 60e0, 9) AS hour,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events""",
)
def p3_calendar(spark, d):
    # The raw form keeps date and time as two strings; they are joined and parsed here.
    raw = load(spark, d, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("trans_date"),
        F.date_format("ts", "HH:mm:ss").alias("trans_time"),
    )
    ts = F.to_timestamp_ntz(F.concat_ws(" ", "trans_date", "trans_time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.select(
        F.col("event_id").alias("tx_id"),
        R(S.fractional_hour(ts), 9).alias("hour"),
        F.weekday(ts).alias("weekday"),
    )


@query(
    "p4_age",
    """SELECT l_orderkey, l_linenumber,
       round(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 365.25e0, 9) AS age
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def p4_age(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey", "l_linenumber", R(S.age_years(F.col("l_shipdate"), F.col("o_orderdate")), 9).alias("age")
    )


@query(
    "p5_haversine",
    """WITH g AS (SELECT c_custkey, c_custkey % 90 * 1e0 AS la1, c_custkey % 180 * 1e0 AS lo1,
         c_nationkey * 3e0 AS la2, c_nationkey * 7e0 AS lo2 FROM customer)
       SELECT c_custkey, round(2 * 6371e0 * asin(sqrt(pow(sin((radians(la2) - radians(la1)) / 2), 2)
         + cos(radians(la1)) * cos(radians(la2)) * pow(sin((radians(lo2) - radians(lo1)) / 2), 2))), 6)
         AS distance_km FROM g""",
)
def p5_haversine(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    km = S.haversine_km(
        (key % 90).cast("double"), (key % 180).cast("double"), nation * 3.0, nation * 7.0
    )
    return load(spark, d, "customer").select("c_custkey", R(km, 6).alias("distance_km"))


@query(
    "p6_strip_prefix",
    "SELECT c_custkey, regexp_replace(c_name, '^Customer#', '') AS name FROM customer",
)
def p6_strip_prefix(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("name")
    )


@query(
    "p7_prepare",
    """SELECT CAST(o_orderdate AS VARCHAR)[1:10] AS day, o_orderkey AS trans_num, c_custkey AS cc_num,
       regexp_replace(c_name, '^Customer#', '') AS merchant, c_mktsegment AS category,
       o_totalprice AS amount, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
       CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS is_fraud
       FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey""",
)
def p7_prepare(spark, d):
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.orderBy("o_orderdate", "o_orderkey").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderkey").alias("trans_num"),
        F.col("c_custkey").alias("cc_num"),
        F.regexp_replace("c_name", "^Customer#", "").alias("merchant"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_totalprice").alias("amount"),
        F.weekday("o_orderdate").alias("weekday"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_fraud"),
    )


@query(
    "p8_one_hot",
    f"""WITH {TX}, known AS (SELECT DISTINCT category FROM tx WHERE t_sec < 1728000 AND category <> 'view')
      SELECT tx_id, coalesce((SELECT string_agg(CASE WHEN c.category = tx.category THEN '1' ELSE '0' END, ''
        ORDER BY c.category) FROM known c), '') AS encoded FROM tx""",
)
def p8_one_hot(spark, d):
    tx = transactions(spark, d)
    # 'view' is held out of the fit, so it is unknown later and encodes as all zeros.
    fit_rows = tx.filter((F.col("t_sec") < 1728000) & (F.col("category") != "view"))
    encoded = profile.one_hot(fit_rows, tx, "category", "_vec")
    return encoded.select(
        "tx_id",
        F.array_join(
            F.transform(profile.vector_array("_vec"), lambda x: x.cast("int").cast("string")), ""
        ).alias("encoded"),
    )


@query(
    "p9_standardise",
    f"""WITH {TX}, m AS (SELECT avg(amount) AS a, stddev_pop(amount) AS sa, avg(hour) AS h, stddev_pop(hour) AS sh FROM tx)
      SELECT tx_id, round((amount - a) / sa, 6) AS amount_z, round((hour - h) / sh, 6) AS hour_z FROM tx, m""",
)
def p9_standardise(spark, d):
    tx = transactions(spark, d)
    z = profile.standardise(tx, tx, ["amount", "hour"])
    return z.select("tx_id", R("amount", 6).alias("amount_z"), R("hour", 6).alias("hour_z"))


@query(
    "p10_minmax_batch",
    f"""WITH {TX}, b AS (SELECT *, CAST(floor(t_sec / 86400e0) AS BIGINT) AS batch FROM tx)
      SELECT tx_id, batch, round(CASE WHEN mx > mn THEN (amount - mn) / (mx - mn) ELSE 0 END, 9) AS score
      FROM b JOIN (SELECT batch, min(amount) mn, max(amount) mx FROM b GROUP BY batch) USING (batch)""",
)
def p10_minmax_batch(spark, d):
    tx = transactions(spark, d).withColumn("batch", F.floor(F.col("t_sec") / 86400.0))
    return profile.minmax_by_batch(tx, "amount", ["batch"], "score").select(
        "tx_id", "batch", R("score", 9).alias("score")
    )


@query(
    "p11_feature_groups",
    """WITH e AS (SELECT vec_id, embedding[1:28] AS v, (vec_id * 37) % 500 / 2e0 AS amount, vec_id * 7 % 240 / 10e0 AS hour FROM embeddings),
      s AS (SELECT vec_id, list_sum([CAST(x AS DOUBLE) for x in v]) AS pca, amount, hour FROM e)
      SELECT vec_id AS tx_id, g.grp, g.n_features, round(pca + g.a * amount + g.h * hour, 6) AS total
      FROM s, (VALUES ('full', 30, 1, 1), ('without_hour', 29, 1, 0), ('without_amount', 29, 0, 1), ('pca_only', 28, 0, 0)) g(grp, n_features, a, h)""",
)
def p11_feature_groups(spark, d):
    rows = embedding_rows(spark, d)
    return profile.feature_group_totals(rows, "tx_id").select(
        "tx_id", "grp", "n_features", R("total", 6).alias("total")
    )


@query(
    "p13_vs_mean",
    f"WITH {TX} SELECT tx_id, CASE WHEN amount > (SELECT avg(amount) FROM tx) THEN 'por encima' ELSE 'por debajo' END AS side FROM tx",
)
def p13_vs_mean(spark, d):
    return profile.versus_mean(transactions(spark, d), "amount").select("tx_id", "side")


# ---- filters -----------------------------------------------------------------------


@query("f1_over_threshold", f"WITH {TX} SELECT tx_id, prob FROM tx WHERE prob >= 0.8e0")
def f1_over_threshold(spark, d):
    return transactions(spark, d).filter(F.col("prob") >= K.HIGH_FROM).select("tx_id", "prob")


@query(
    "f3_shift_range",
    """SELECT event_id AS tx_id, value AS amount FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 04:00:00'""",
)
def f3_shift_range(spark, d):
    ts = F.col("ts")
    return load(spark, d, "events").filter(
        (ts >= F.expr("timestamp_ntz'2024-01-10 00:00:00'")) & (ts < F.expr("timestamp_ntz'2024-01-10 04:00:00'"))
    ).select(F.col("event_id").alias("tx_id"), F.col("value").alias("amount"))


_TRAIN_CUT = f"""WITH {TX}, o AS (SELECT *, row_number() OVER (ORDER BY t_sec, tx_id) - 1 AS rk,
      count(*) OVER () AS n FROM tx)"""


@query(
    "f7_leak_guard",
    f"""{_TRAIN_CUT}, lim AS (SELECT t_sec AS limit_sec FROM o WHERE rk = CAST(floor(n * 0.8e0) AS BIGINT))
      SELECT count(*) AS n_checked, count(*) FILTER (t_sec >= limit_sec) AS violations, any_value(limit_sec) AS limit_sec
      FROM (SELECT t_sec FROM o WHERE rk < floor(n * 0.8e0) AND label = 0 ORDER BY prob DESC, tx_id LIMIT 150), lim""",
)
def f7_leak_guard(spark, d):
    tx = transactions(spark, d)
    cut = splits.time_cut(tx, "t_sec", "tx_id")
    train = tx.filter(before(["t_sec", "tx_id"], cut))
    return splits.leak_guard(sampling.hard_negatives(train, "label", "prob", "tx_id", 150), "t_sec", cut[0])


# ---- splits ------------------------------------------------------------------------


@query(
    "d1_temporal_split",
    f"{_TRAIN_CUT} SELECT tx_id, CASE WHEN rk < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM o",
)
def d1_temporal_split(spark, d):
    return splits.temporal_split(transactions(spark, d), "t_sec", "tx_id").select("tx_id", "split")


_HASHED = f"""WITH {TX}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
      {hash32_sql('42', 'tx_id')}, tx_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM tx)"""


@query(
    "d2_stratified_split",
    f"{_HASHED} SELECT tx_id, label, CASE WHEN rk < round_even(0.2e0 * n, 0) THEN 'test' ELSE 'train' END AS split FROM o",
)
def d2_stratified_split(spark, d):
    return splits.stratified_split(transactions(spark, d), "label", "tx_id").select("tx_id", "label", "split")


@query(
    "d3_date_split",
    "SELECT event_id AS tx_id, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split FROM events",
)
def d3_date_split(spark, d):
    return load(spark, d, "events").select(
        F.col("event_id").alias("tx_id"),
        F.when(F.col("ts") < F.expr("timestamp_ntz'2024-01-21 00:00:00'"), "train").otherwise("test").alias("split"),
    )


@query(
    "d4_split_summary",
    f"""{_TRAIN_CUT} SELECT CASE WHEN rk < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split,
      count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 9) AS prevalence FROM o GROUP BY 1""",
)
def d4_split_summary(spark, d):
    split = splits.temporal_split(transactions(spark, d), "t_sec", "tx_id")
    return splits.split_summary(split, "split", "label").withColumn("prevalence", R("prevalence", 9))


@query(
    "d5_fixed_batch",
    f"""{_TRAIN_CUT}, p AS (SELECT *, {hash32_sql('42', 'tx_id')} AS h FROM o WHERE rk >= floor(n * 0.8e0)),
      c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, tx_id) AS r FROM p),
      pos AS (SELECT * FROM c WHERE label = 1 AND r <= 5),
      neg AS (SELECT * FROM c WHERE label = 0 AND r <= 500 - (SELECT count(*) FROM pos)),
      u AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)
      SELECT row_number() OVER (ORDER BY {hash32_sql('42', "'shuffle'", 'tx_id')}, tx_id) - 1 AS batch_no, tx_id, label FROM u""",
)
def d5_fixed_batch(spark, d):
    tx = transactions(spark, d)
    period = tx.filter(~before(["t_sec", "tx_id"], splits.time_cut(tx, "t_sec", "tx_id")))
    return sampling.fixed_batch(period, "label", "tx_id").select("batch_no", "tx_id", "label")


_START = f"{_TRAIN_CUT}, st AS (SELECT t_sec AS s FROM o WHERE rk = CAST(floor(n * 0.8e0) AS BIGINT))"


@query(
    "d6_shift",
    f"{_START} SELECT tx_id, t_sec, prob, label FROM o, st WHERE t_sec >= s + 2 * 3600e0 AND t_sec < s + 6 * 3600e0",
)
def d6_shift(spark, d):
    tx = transactions(spark, d)
    start = splits.time_cut(tx, "t_sec", "tx_id")[0]
    near = transactions(spark, d, (start + 2 * 3600, start + 6 * 3600))
    return splits.shift(near, "t_sec", start, hours=4.0, offset_h=2.0).select("tx_id", "t_sec", "prob", "label")


@query(
    "d7_multi_shift",
    f"""{_START} SELECT offset_h, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(sum(amount), 6) AS amount
      FROM o, st, (VALUES (0e0), (1e0), (2e0), (3e0)) v(offset_h)
      WHERE t_sec >= s + offset_h * 3600e0 AND t_sec < s + (offset_h + 4e0) * 3600e0 GROUP BY offset_h""",
)
def d7_multi_shift(spark, d):
    tx = transactions(spark, d)
    start = splits.time_cut(tx, "t_sec", "tx_id")[0]
    near = transactions(spark, d, (start, start + 7 * 3600))
    rows = splits.shifts(near, "t_sec", splits.shift_table(spark, start, 4.0, [0.0, 1.0, 2.0, 3.0]))
    return rows.groupBy("offset_h").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("positives"), R(F.sum("amount"), 6).alias("amount")
    )


@query(
    "d7_shift_table",
    f"""{_START}, v AS (SELECT i / 10e0 AS offset_h, s + i / 10e0 * 3600 AS lo, s + (i / 10e0 + 4) * 3600 AS hi FROM range(1000) r(i), st)
      SELECT offset_h, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(sum(amount), 6) AS amount
      FROM o JOIN v ON t_sec >= lo AND t_sec < hi GROUP BY offset_h""",
)
def d7_shift_table(spark, d):
    # A thousand overlapping shifts of four hours, one every six minutes.
    start = splits.time_cut(transactions(spark, d), "t_sec", "tx_id")[0]
    table = splits.shift_table(spark, start, 4.0, [i / 10 for i in range(1000)])
    near = transactions(spark, d, (start, start + 104 * 3600))
    rows = splits.shifts(near.select("t_sec", "label", "amount"), "t_sec", table)
    return rows.groupBy("offset_h").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("positives"), R(F.sum("amount"), 6).alias("amount")
    )


@query(
    "d8_stratified_folds",
    f"""{_HASHED} SELECT tx_id, label, CAST((rk >= n * 1 // 3) AS INTEGER) + CAST((rk >= n * 2 // 3) AS INTEGER) AS fold FROM o""",
)
def d8_stratified_folds(spark, d):
    return splits.stratified_folds(transactions(spark, d), "label", "tx_id", 3).select("tx_id", "label", "fold")


@query(
    "d9_time_folds",
    f"""{_TRAIN_CUT} SELECT tx_id, CAST(rk >= n - 3 * (n // 4) AS INTEGER) + CAST(rk >= n - 2 * (n // 4) AS INTEGER)
      + CAST(rk >= n - (n // 4) AS INTEGER) AS block FROM o""",
)
def d9_time_folds(spark, d):
    return splits.time_folds(transactions(spark, d), "t_sec", "tx_id", 3).select("tx_id", "block")


@query(
    "d10_class_weights",
    f"""WITH {TX}, c AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tx)
      SELECT 0 AS label, n0 AS n, 1e0 AS w_gradient, 1e0 AS w_sqrt, round((n0 + n1) / (2e0 * n0), 9) AS w_balanced FROM c
      UNION ALL SELECT 1, n1, round(n0 / CAST(n1 AS DOUBLE), 9), round(sqrt(n0 / CAST(n1 AS DOUBLE)), 9), round((n0 + n1) / (2e0 * n1), 9) FROM c""",
)
def d10_class_weights(spark, d):
    w = splits.class_weights(transactions(spark, d), "label")
    return w.select("label", "n", *[R(c, 9).alias(c) for c in ("w_gradient", "w_sqrt", "w_balanced")])


@query(
    "d14_hard_negatives",
    f"{_TRAIN_CUT} SELECT tx_id, prob FROM o WHERE rk < floor(n * 0.8e0) AND label = 0 ORDER BY prob DESC, tx_id LIMIT 150",
)
def d14_hard_negatives(spark, d):
    tx = transactions(spark, d)
    train = tx.filter(before(["t_sec", "tx_id"], splits.time_cut(tx, "t_sec", "tx_id")))
    return sampling.hard_negatives(train, "label", "prob", "tx_id", 150).select("tx_id", "prob")


@query(
    "d15_quota_positives",
    f"""WITH {TX}, p AS (SELECT *, {hash32_sql('42', 'tx_id')} AS h FROM tx WHERE k >= 90 AND prob >= 0.05e0),
      r AS (SELECT *, row_number() OVER (PARTITION BY amount <= 5 ORDER BY h, tx_id) AS rk FROM p)
      SELECT tx_id, amount FROM r ORDER BY CASE WHEN amount > 5 THEN 1 WHEN rk <= 100 THEN 0 ELSE 2 END, rk LIMIT 200""",
)
def d15_quota_positives(spark, d):
    tx = transactions(spark, d).withColumn("positive", (F.col("k") >= 90).cast("int"))
    raised = tx.filter(F.col("prob") >= 0.05)
    return sampling.quota_positives(raised, "positive", "amount", "tx_id", 200).select("tx_id", "amount")


@query(
    "d16_val_split",
    f"""WITH {TX}, o AS (SELECT tx_id, row_number() OVER (ORDER BY {hash32_sql('42', 'tx_id')}, tx_id) - 1 AS rk,
      count(*) OVER () AS n FROM tx WHERE prob >= 0.4e0)
      SELECT tx_id, CASE WHEN rk < greatest(1, floor(n * 0.1e0)) THEN 'val' ELSE 'train' END AS part FROM o""",
)
def d16_val_split(spark, d):
    rows = transactions(spark, d).filter(F.col("prob") >= K.MEDIUM_FROM)
    return splits.hash_split(rows, "tx_id", 0.1).select("tx_id", "part")


# ---- selection ---------------------------------------------------------------------


def _select_sql(threshold: str, capacity: int, minimum: int, fill: int) -> str:
    return f"""WITH {TX}, r AS (SELECT *, row_number() OVER (ORDER BY prob DESC, tx_id) AS case_no,
      (SELECT count(*) FROM tx WHERE prob >= {threshold}) >= {minimum} AS enough FROM tx)
      SELECT case_no, tx_id, prob, label, CASE WHEN enough THEN 'threshold' ELSE 'fallback' END AS branch FROM r
      WHERE CASE WHEN enough THEN prob >= {threshold} AND case_no <= {capacity} ELSE case_no <= {fill} END"""


_CASE_COLS = ("case_no", "tx_id", "prob", "label", "branch")


@query("k1_select_cases", _select_sql("0.8e0", 10, 3, 10))
def k1_select_cases(spark, d):
    return selection.select_cases(transactions(spark, d), "prob", "tx_id").select(*_CASE_COLS)


@query("k1_select_fallback", _select_sql("0.999e0", 10, 3, 10))
def k1_select_fallback(spark, d):
    return selection.select_cases(transactions(spark, d), "prob", "tx_id", threshold=0.999).select(*_CASE_COLS)


@query("k1_select_minimum", _select_sql("0.999e0", 10, 3, 3))
def k1_select_minimum(spark, d):
    tx = transactions(spark, d)
    return selection.select_cases(tx, "prob", "tx_id", threshold=0.999, fallback="minimum").select(*_CASE_COLS)


@query("k2_top_n", f"WITH {TX} SELECT tx_id, prob FROM tx ORDER BY prob DESC, tx_id LIMIT 20")
def k2_top_n(spark, d):
    return selection.top_n(transactions(spark, d), "prob", "tx_id", 20).select("tx_id", "prob")


@query(
    "k3_priority_list",
    f"""WITH {TX} SELECT row_number() OVER (ORDER BY prob DESC, tx_id) AS case_no, prob, tier, amount, hour
      FROM tx ORDER BY prob DESC, tx_id LIMIT 80""",
)
def k3_priority_list(spark, d):
    return selection.priority_list(scored_transactions(spark, d), "prob", "tx_id", 80, "completo")


@query("k4_bottom_n", f"WITH {TX} SELECT tx_id, prob FROM tx ORDER BY prob, tx_id LIMIT 20")
def k4_bottom_n(spark, d):
    return selection.bottom_n(transactions(spark, d), "prob", "tx_id", 20).select("tx_id", "prob")


@query(
    "k5_disagreement_queue",
    f"""WITH {TX}, u AS ((SELECT * FROM tx WHERE label = 1 ORDER BY prob, tx_id LIMIT 6)
      UNION ALL (SELECT * FROM tx WHERE label = 0 ORDER BY prob DESC, tx_id LIMIT 3))
      SELECT row_number() OVER (ORDER BY prob, tx_id) AS case_no, tx_id, prob, label FROM u""",
)
def k5_disagreement_queue(spark, d):
    return selection.disagreement_queue(transactions(spark, d), "prob", "label", "tx_id").select(
        "case_no", "tx_id", "prob", "label"
    )


@query(
    "k6_top_true_positives",
    f"WITH {TX} SELECT tx_id, prob FROM tx WHERE label = 1 AND prob >= 0.5e0 ORDER BY prob DESC, tx_id LIMIT 5",
)
def k6_top_true_positives(spark, d):
    return selection.top_true_positives(transactions(spark, d), "prob", "label", "tx_id").select("tx_id", "prob")


@query(
    "w1_case_number",
    f"""WITH {TX}, b AS (SELECT *, CAST(floor(t_sec / 86400e0) AS BIGINT) AS day FROM tx WHERE prob >= 0.8e0)
      SELECT day, row_number() OVER (PARTITION BY day ORDER BY prob DESC, tx_id) AS case_no, tx_id FROM b
      QUALIFY case_no <= 10""",
)
def w1_case_number(spark, d):
    tx = transactions(spark, d).withColumn("day", F.floor(F.col("t_sec") / 86400.0))
    return selection.select_cases_by(tx, ["day"], "prob", "tx_id").select("day", "case_no", "tx_id")


@query(
    "w2_precision_curve",
    f"""WITH {TX}, r AS (SELECT label, row_number() OVER (ORDER BY prob DESC, tx_id) AS rank FROM tx)
      SELECT rank, CAST(sum(label) OVER (ORDER BY rank) AS BIGINT) AS hits,
      round(sum(label) OVER (ORDER BY rank) / CAST(rank AS DOUBLE), 9) AS precision,
      round(sum(label) OVER (ORDER BY rank) / CAST((SELECT sum(label) FROM tx) AS DOUBLE), 9) AS recall
      FROM r WHERE rank <= 400""",
)
def w2_precision_curve(spark, d):
    c = metrics.precision_curve(transactions(spark, d), "prob", "label", "tx_id")
    return c.select("rank", "hits", R("precision", 9).alias("precision"), R("recall", 9).alias("recall"))


@query(
    "w6_zone",
    f"""WITH {TX}, r AS (SELECT tx_id, row_number() OVER (ORDER BY prob DESC, tx_id) AS case_no FROM tx QUALIFY case_no <= 40)
      SELECT 'head' AS zone, case_no, tx_id FROM r WHERE case_no <= 12
      UNION ALL SELECT 'tail', case_no, tx_id FROM r WHERE case_no > (SELECT max(case_no) FROM r) - 12
      UNION ALL SELECT 'list', case_no, tx_id FROM r WHERE case_no IN (3, 7, 21)""",
)
def w6_zone(spark, d):
    cases = selection.select_cases(
        transactions(spark, d), "prob", "tx_id", capacity=40, threshold=0.05
    ).select("case_no", "tx_id")
    parts = [
        selection.zone(cases, where, 12).select(F.lit(name).alias("zone"), "case_no", "tx_id")
        for name, where in (("head", "head"), ("tail", "tail"), ("list", [3, 7, 21]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- detector metrics --------------------------------------------------------------

_STEPS = f"""WITH {TX}, g AS (SELECT prob, sum(label) AS pos, count(*) AS n FROM tx GROUP BY prob),
      s AS (SELECT prob, pos, n, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY prob DESC))"""


@query(
    "e1_average_precision",
    f"{_STEPS} SELECT round(sum(pos * (cp / CAST(cn AS DOUBLE))) / sum(pos), 9) AS auc_pr FROM s",
)
def e1_average_precision(spark, d):
    return metrics.curve_areas(transactions(spark, d), "prob", "label").select(R("auc_pr", 9).alias("auc_pr"))


@query(
    "e2_roc_auc",
    f"""{_STEPS}, t AS (SELECT sum(pos) AS p, sum(n) - sum(pos) AS m FROM g)
      SELECT round(sum(pos * ((m - (cn - cp)) + (n - pos) / 2e0)) / any_value(p) / any_value(m), 9) AS roc_auc FROM s, t""",
)
def e2_roc_auc(spark, d):
    return metrics.curve_areas(transactions(spark, d), "prob", "label").select(R("roc_auc", 9).alias("roc_auc"))


@query(
    "e3_pr_curve",
    f"""{_STEPS} SELECT prob AS threshold, round(cp / CAST(cn AS DOUBLE), 9) AS precision,
      round(cp / CAST((SELECT sum(pos) FROM g) AS DOUBLE), 9) AS recall FROM s""",
)
def e3_pr_curve(spark, d):
    c = metrics.pr_curve(transactions(spark, d), "prob", "label")
    return c.select("threshold", R("precision", 9).alias("precision"), R("recall", 9).alias("recall"))


def _block_sql(source: str, names: str) -> str:
    """Metric block of ``source(model, tx_id, score, label)``, one row per model."""
    ns = ", ".join(
        f"CAST(sum(label) FILTER (rank <= {n}) AS BIGINT) AS hits_{n}, "
        f"round(sum(label) FILTER (rank <= {n}) / CAST(least({n}, count(*)) AS DOUBLE), 9) AS precision_{n}"
        for n in K.TOP_N
    )
    return f"""g AS (SELECT model, score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY 1, 2),
      s AS (SELECT model, pos, n, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS p,
        sum(n - pos) OVER (PARTITION BY model) AS m FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
      a AS (SELECT model, round(sum(pos * (cp / CAST(cn AS DOUBLE))) / sum(pos), 9) AS auc_pr,
        round(sum(pos * ((m - (cn - cp)) + (n - pos) / 2e0)) / any_value(p) / any_value(m), 9) AS roc_auc FROM s GROUP BY model),
      c AS (SELECT model, count(*) FILTER (score >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (score >= 0.5e0 AND label = 0) AS fp,
        count(*) FILTER (score < 0.5e0 AND label = 1) AS fn, count(*) FILTER (score < 0.5e0 AND label = 0) AS tn,
        round(avg(label), 9) AS prevalence FROM {source} GROUP BY model),
      h AS (SELECT model, {ns} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, tx_id) AS rank FROM {source}) GROUP BY model)
      SELECT {names} auc_pr, roc_auc, tp, fp, fn, tn, prevalence,
        round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 9) AS precision,
        round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 9) AS recall,
        round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 9) AS f1,
        {", ".join(f"hits_{n}, precision_{n}" for n in K.TOP_N)}
      FROM a JOIN c USING (model) JOIN h USING (model)"""


_BLOCK_COLS = ["auc_pr", "roc_auc", "tp", "fp", "fn", "tn", "prevalence", "precision", "recall", "f1"] + [
    f"{p}_{n}" for n in K.TOP_N for p in ("hits", "precision")
]


def _rounded(df, *extra):
    whole = {"tp", "fp", "fn", "tn"} | {f"hits_{n}" for n in K.TOP_N}
    return df.select(*extra, *[c if c in whole else R(c, 9).alias(c) for c in _BLOCK_COLS])


@query(
    "e4_metric_block",
    f"WITH {TX}, src AS (SELECT 'm' AS model, tx_id, prob AS score, label FROM tx), " + _block_sql("src", ""),
)
def e4_metric_block(spark, d):
    return _rounded(metrics.metric_block(transactions(spark, d), "prob", "label", "tx_id"))


def _three_scores(tx):
    """Three deterministic detectors over the same rows, in long form."""
    return tx.select(
        "tx_id",
        "label",
        "split",
        F.explode(
            F.create_map(
                F.lit("amount"), F.col("prob"),
                F.lit("k"), F.col("k") / 99.0,
                F.lit("mixed"), (F.col("prob") + F.col("k") / 99.0) / 2,
            )
        ).alias("model", "score"),
    )


_MODELS = """CASE m WHEN 'amount' THEN prob WHEN 'k' THEN k / 99e0 ELSE (prob + k / 99e0) / 2 END AS score"""


@query(
    "e4b_precision_at_n",
    f"""WITH {TX}, r AS (SELECT *, row_number() OVER (ORDER BY prob DESC, tx_id) AS rank FROM tx) SELECT """
    + ", ".join(
        f"CAST(sum(label) FILTER (rank <= {n}) AS BIGINT) AS hits_{n}, "
        f"round(sum(label) FILTER (rank <= {n}) / {n}e0, 9) AS precision_{n}"
        for n in K.COMPARE_N
    )
    + " FROM r",
)
def e4b_precision_at_n(spark, d):
    p = metrics.precision_at(
        transactions(spark, d), "prob", "label", "tx_id", K.COMPARE_N, divide_by_n=True
    )
    return p.select(*[f"hits_{n}" for n in K.COMPARE_N], *[R(f"precision_{n}", 9).alias(f"precision_{n}") for n in K.COMPARE_N])


@query(
    "e7_head_equivalence",
    f"""WITH {TX}, v AS (SELECT tx_id, label, m AS model, {_MODELS} FROM tx, (VALUES ('amount'), ('mixed')) t(m)),
      r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, tx_id) AS rank FROM v),
      p AS (SELECT n, model, avg(label) AS p FROM r, (VALUES (20), (50), (100)) t(n) WHERE rank <= n GROUP BY 1, 2)
      SELECT round(max(abs(a.p - b.p)), 6) AS gap, round(max(abs(a.p - b.p)), 6) <= 0.02 AS equivalent
      FROM p a JOIN p b USING (n) WHERE a.model = 'amount' AND b.model = 'mixed'""",
)
def e7_head_equivalence(spark, d):
    tx = transactions(spark, d).withColumn("split", F.lit("all"))
    scores = _three_scores(tx).filter(F.col("model").isin("amount", "mixed"))
    p = metrics.precision_at(scores, "score", "label", "tx_id", K.COMPARE_N, ["model"])
    return profile.head_equivalence(p, "model", ("amount", "mixed"), [n for n in K.COMPARE_N if n <= 100])


@query(
    "e8_model_table",
    f"""{_TRAIN_CUT}, src AS (SELECT m || '/' || CASE WHEN rk < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS model, tx_id, label, {_MODELS}
      FROM o, (VALUES ('amount'), ('k'), ('mixed')) t(m)), """
    + _block_sql("src", "split_part(model, '/', 1) AS model, split_part(model, '/', 2) AS split,"),
)
def e8_model_table(spark, d):
    tx = splits.temporal_split(transactions(spark, d), "t_sec", "tx_id")
    table = metrics.metric_block(_three_scores(tx), "score", "label", "tx_id", by=["model", "split"])
    return _rounded(table, "model", "split")


@query(
    "m4_score_rule",
    f"WITH {TX} SELECT tx_id, prob, tier FROM tx",
)
def m4_score_rule(spark, d):
    return scored_transactions(spark, d).select("tx_id", "prob", "tier")


@query(
    "m10_quantile_threshold",
    f"""WITH {TX}, r AS (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS rk FROM tx),
      s AS (SELECT (1 - avg(label)) * (count(*) - 1) AS spot FROM tx),
      v AS (SELECT spot - floor(spot) AS f, (SELECT prob FROM r WHERE rk = floor(spot)) AS a,
        (SELECT prob FROM r WHERE rk = floor(spot) + 1) AS b FROM s)
      SELECT round(a + f * (b - a), 9) AS threshold FROM v""",
)
def m10_quantile_threshold(spark, d):
    tx = transactions(spark, d)
    return profile.quantile_threshold(tx, "prob", "label").select(R("threshold", 9).alias("threshold"))
