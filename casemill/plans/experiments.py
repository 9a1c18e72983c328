"""Queries: batch summaries, run analytics, small-sample tests, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators import audit, metrics, profile, runs, stats, summaries, system, windows
from casemill.plans import detector, texts
from casemill.plans.registry import SQL, TX, query
from casemill.plans.reviews import TEXTS_SQL, case_texts, run_cases
from casemill.session import shared_dir
from casemill.sources import files
from casemill.sources.tables import scored_transactions, transactions
from casemill.sources.versions import VersionedLog

R = F.round


def _rounded(df, cols, digits=9):
    return df.withColumns({c: R(c, digits) for c in cols})


# ---- summaries ---------------------------------------------------------------------

_DAYS = f"{TX}, b AS (SELECT *, CAST(floor(t_sec / 86400e0) AS BIGINT) AS day FROM tx)"


def _days(df):
    return df.withColumn("day", F.floor(F.col("t_sec") / 86400.0))


@query(
    "a1_batch_summary",
    f"""WITH {_DAYS} SELECT day, count(*) AS n_rows, count(*) FILTER (tier = 'ALTO') AS n_high, count(*) FILTER (tier = 'MEDIO') AS n_medium,
      count(*) FILTER (tier = 'BAJO') AS n_low, max(prob) AS prob_max, round(avg(prob), 9) AS prob_mean, round(sum(amount), 6) AS amount_total,
      round(coalesce(sum(amount) FILTER (tier <> 'BAJO'), 0), 6) AS amount_at_risk FROM b GROUP BY day""",
)
def a1_batch_summary(spark, d):
    s = summaries.batch_summary(_days(scored_transactions(spark, d)), ["day"])
    return _rounded(_rounded(s, ["prob_mean"]), ["amount_total", "amount_at_risk"], 6)


@query(
    "a2_batch_stats",
    f"""WITH {_DAYS}, s AS (SELECT day, count(*) AS n_rows, count(*) FILTER (tier = 'ALTO') AS hi, count(*) FILTER (tier = 'MEDIO') AS me,
        count(*) FILTER (tier = 'BAJO') AS lo, max(prob) AS pm, round(avg(prob), 9) AS pa, round(sum(amount), 6) AS amount_total,
        round(avg(amount), 6) AS amount_mean, min(hour) AS hour_min, max(hour) AS hour_max FROM b GROUP BY day)
      SELECT day, level, n_rows, CASE WHEN level = 'completo' THEN hi END AS n_high, CASE WHEN level = 'completo' THEN me END AS n_medium,
      CASE WHEN level = 'completo' THEN lo END AS n_low, CASE WHEN level <> 'ciego' THEN pm END AS prob_max, CASE WHEN level <> 'ciego' THEN pa END AS prob_mean,
      amount_total, amount_mean, hour_min, hour_max FROM s, (VALUES ('completo'), ('sin_nivel'), ('ciego')) v(level)""",
)
def a2_batch_stats(spark, d):
    scored = _days(scored_transactions(spark, d))
    out = summaries.batch_statistics(scored, K.LEVELS, ["day"])
    return _rounded(_rounded(out, ["prob_mean"]), ["amount_total", "amount_mean"], 6)


@query(
    "a8_share_below",
    f"""WITH {TX}, s AS (SELECT label, up_to, round(avg(CAST(amount <= up_to AS INTEGER)), 9) AS share FROM tx, (VALUES (1e0), (2e0), (5e0), (10e0)) v(up_to) GROUP BY 1, 2),
      m AS (SELECT label, round(median(amount), 9) AS median_amount FROM tx GROUP BY label) SELECT * FROM s JOIN m USING (label)""",
)
def a8_share_below(spark, d):
    tx = transactions(spark, d)
    shares = summaries.share_at_or_below(tx, "label", "amount")
    medians = profile.grouped_quantiles(tx, ["label"], "amount", [0.5], ["median_amount"])
    return _rounded(shares.join(medians, "label"), ["share", "median_amount"])


@query(
    "a9_ecdf",
    f"""WITH {TX}, g AS (SELECT label, amount, count(*) AS n FROM tx WHERE amount > 0 GROUP BY 1, 2)
      SELECT label, amount, round(sum(n) OVER (PARTITION BY label ORDER BY amount) / (SELECT CAST(count(*) AS DOUBLE) FROM tx t WHERE t.label = g.label), 9) AS ecdf FROM g""",
)
def a9_ecdf(spark, d):
    return _rounded(summaries.positive_ecdf(transactions(spark, d), "label", "amount"), ["ecdf"])


@query(
    "a10_five_numbers",
    f"""WITH {TX} SELECT category, round(min(amount), 9) AS low, round(quantile_cont(amount, 0.25), 9) AS q1, round(quantile_cont(amount, 0.5), 9) AS mid,
      round(quantile_cont(amount, 0.75), 9) AS q3, round(max(amount), 9) AS high FROM tx GROUP BY category""",
)
def a10_five_numbers(spark, d):
    names = ["low", "q1", "mid", "q3", "high"]
    tx = transactions(spark, d)
    return _rounded(
        profile.grouped_quantiles(tx, ["category"], "amount", [0, 0.25, 0.5, 0.75, 1], names), names
    )


@query(
    "a11_distincts",
    f"""WITH {TX} SELECT count(DISTINCT card) AS n_card, count(DISTINCT category) AS n_category, count(DISTINCT k) AS n_k,
      min(t_sec) AS first, max(t_sec) AS last FROM tx""",
)
def a11_distincts(spark, d):
    return summaries.distinct_counts(transactions(spark, d), ["card", "category", "k"], "t_sec")


_RANGES = [(0, 0), (0, 6), (3, 19), (0, 29)]


@query(
    "a11_period_distincts",
    f"""WITH {TX}, v(first, last) AS (VALUES {', '.join(f'({a}, {b})' for a, b in _RANGES)})
      SELECT first, last, count(*) AS n_rows, count(DISTINCT card) AS n_card, count(DISTINCT amount) AS n_amount, TRUE AS within
      FROM v JOIN tx ON floor(t_sec / 86400e0) BETWEEN first AND last GROUP BY first, last""",
)
def a11_period_distincts(spark, d):
    """Distinct cards and amounts of ranges of days, from sketches kept per day; exact counts beside them."""
    day = F.floor(F.col("t_sec") / 86400.0).cast("int")
    tx = transactions(spark, d)
    path = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    named = tx.withColumn("cents", F.col("amount").cast("string"))
    summaries.distinct_sketches(named, day, ["card", "cents"]).write.parquet(path)
    ranges = spark.createDataFrame(_RANGES, "first int, last int")
    told = summaries.distinct_between(spark.read.parquet(path), ranges, ["card", "cents"])
    exact = ranges.join(named.withColumn("_day", day), F.col("_day").between(F.col("first"), F.col("last"))).groupBy("first", "last").agg(
        F.count("*").alias("n"), F.count_distinct("card").alias("card"), F.count_distinct("amount").alias("amount")
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b)
    return told.join(exact, ["first", "last"]).select(
        "first", "last", "n_rows", F.col("card").alias("n_card"), F.col("amount").alias("n_amount"), (near("n_card", "card") & near("n_cents", "amount")).alias("within")
    )


# ---- the run log derived from events -----------------------------------------------

RUNLOG_SQL = f"""{TX},
runlog0 AS (SELECT CASE WHEN card % 2 = 0 THEN 'm_a' ELSE 'm_b' END AS model, CASE WHEN k % 2 = 0 THEN 'interpreta' ELSE 'revisa' END AS mode,
  CASE category WHEN 'error' THEN 'sin_nivel' WHEN 'click' THEN 'completo' WHEN 'view' THEN 'completo' ELSE 'ciego' END AS level,
  CAST(floor(t_sec / 259200e0) AS BIGINT) AS seed, (k // 2) % 2 AS repetition, count(*) AS n_rows,
  count(*) FILTER (amount + k >= 130) AS positives, count(*) FILTER (prob >= 0.4e0) AS n_raised, count(*) FILTER (prob >= 0.4e0 AND amount + k >= 130) AS pos_raised,
  count(*) FILTER (k % 2 = 1 AND prob >= 0.4e0 AND card % 5 = 0) AS n_discarded, count(*) FILTER (k % 2 = 1 AND prob >= 0.4e0 AND card % 5 = 0 AND amount + k >= 130) AS n_destroyed,
  round(sum(amount) / 10e0, 6) AS seconds, max(k) >= 97 AS reliable, CASE WHEN count(*) < 12 THEN 'timeout' END AS error FROM tx GROUP BY 1, 2, 3, 4, 5),
runlog AS (SELECT *, n_discarded - n_destroyed AS n_right_discards, pos_raised / greatest(positives, 1e0) AS recall_detector,
  (pos_raised - n_destroyed) / greatest(positives, 1e0) AS recall_system FROM runlog0 WHERE error IS NULL)"""


def full_run_log(spark, d):
    tx = transactions(spark, d)
    k, card = F.col("k"), F.col("card")
    raised, pos = F.col("prob") >= 0.4, F.col("amount") + k >= 130
    out = (k % 2 == 1) & raised & (card % 5 == 0)
    level = (
        F.when(F.col("category") == "error", "sin_nivel")
        .when(F.col("category").isin("click", "view"), "completo")
        .otherwise("ciego")
    )
    log = tx.groupBy(
        F.when(card % 2 == 0, "m_a").otherwise("m_b").alias("model"),
        F.when(k % 2 == 0, K.MODE_INTERPRET).otherwise(K.MODE_REVIEW).alias("mode"),
        level.alias("level"),
        F.floor(F.col("t_sec") / 259200.0).alias("seed"),
        (F.floor(k / 2) % 2).alias("repetition"),
    ).agg(
        F.count("*").alias("n_rows"),
        F.count_if(pos).alias("positives"),
        F.count_if(raised).alias("n_raised"),
        F.count_if(raised & pos).alias("pos_raised"),
        F.count_if(out).alias("n_discarded"),
        F.count_if(out & pos).alias("n_destroyed"),
        R(F.sum("amount") / 10.0, 6).alias("seconds"),
        (F.max(k) >= 97).alias("reliable"),
        F.when(F.count("*") < 12, "timeout").alias("error"),
    )
    p = F.greatest(F.col("positives"), F.lit(1))
    return log.withColumns(
        {
            "n_right_discards": F.col("n_discarded") - F.col("n_destroyed"),
            "recall_detector": F.col("pos_raised") / p,
            "recall_system": (F.col("pos_raised") - F.col("n_destroyed")) / p,
        }
    )


def run_log(spark, d):
    return runs.valid_runs(full_run_log(spark, d))


@query(
    "s7_valid_runs",
    f"WITH {RUNLOG_SQL} SELECT model, mode, level, seed, repetition, n_rows, round(seconds, 6) AS seconds FROM runlog",
)
def s7_valid_runs(spark, d):
    """The valid runs of the newest of several log files, picked by name."""
    base = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    log = full_run_log(spark, d).select("model", "mode", "level", "seed", "repetition", "n_rows", "seconds", "error")
    older = log.filter(F.col("model") == "m_a")
    for name, rows in (("runs_20240131.csv", log), ("runs_20240115.csv", older), ("runs_20231231.csv", older)):
        rows.write.option("header", True).csv(f"{base}/{name}")
    return files.read_newest_log(spark, f"{base}/runs_*", log.schema).drop("error")


@query(
    "a3_run_table",
    f"""WITH {RUNLOG_SQL} SELECT model, mode, count(*) AS n, round(avg(recall_detector), 9) AS recall_detector_mean, round(coalesce(stddev_samp(recall_detector), 0), 9) AS recall_detector_sd,
      round(avg(recall_system), 9) AS recall_system_mean, round(coalesce(stddev_samp(recall_system), 0), 9) AS recall_system_sd, CAST(sum(n_destroyed) AS BIGINT) AS n_destroyed,
      count(*) FILTER (reliable) AS n_reliable, round(avg(seconds), 6) AS seconds_mean FROM runlog GROUP BY 1, 2""",
)
def a3_run_table(spark, d):
    t = runs.run_table(run_log(spark, d))
    cols = [c for c in t.columns if c.startswith("recall")]
    return _rounded(_rounded(t, cols), ["seconds_mean"], 6)


@query(
    "a4_wrong_discards",
    f"""WITH {RUNLOG_SQL}, r AS (SELECT model, count(*) FILTER (n_destroyed > 0) AS runs_with_loss, count(*) AS n_runs, CAST(sum(n_destroyed) AS BIGINT) AS positives_lost
      FROM runlog WHERE mode = 'revisa' GROUP BY 1) SELECT *, round(runs_with_loss / CAST(n_runs AS DOUBLE), 9) AS share FROM r""",
)
def a4_wrong_discards(spark, d):
    return _rounded(runs.wrong_discards(run_log(spark, d)), ["share"])


@query(
    "a5_reproducibility",
    f"""WITH {RUNLOG_SQL}, g AS (SELECT model, seed, level, max(recall_system) - min(recall_system) AS r FROM runlog WHERE mode = 'revisa' GROUP BY 1, 2, 3)
      SELECT model, count(*) AS n_batches, count(*) FILTER (r > 0) AS n_unstable, round(max(r), 9) AS worst_range, round(count(*) FILTER (r > 0) / CAST(count(*) AS DOUBLE), 9) AS unstable_share FROM g GROUP BY model""",
)
def a5_reproducibility(spark, d):
    return _rounded(runs.reproducibility(run_log(spark, d), "model", ["seed", "level"]), ["worst_range", "unstable_share"])


@query(
    "a6_reliable_rate",
    f"WITH {RUNLOG_SQL} SELECT model, count(*) FILTER (reliable) AS n_reliable, count(*) AS n_runs, round(count(*) FILTER (reliable) / CAST(count(*) AS DOUBLE), 9) AS rate FROM runlog GROUP BY 1",
)
def a6_reliable_rate(spark, d):
    return _rounded(runs.reliable_rate(run_log(spark, d), "model"), ["rate"])


@query(
    "a13_cost_dispersion",
    f"""WITH {RUNLOG_SQL}, r AS (SELECT model, seconds, row_number() OVER (PARTITION BY model ORDER BY seconds) - 1 AS rk, count(*) OVER (PARTITION BY model) AS n,
        min(seconds) OVER (PARTITION BY model) AS low, max(seconds) OVER (PARTITION BY model) AS high FROM runlog)
      SELECT model, seconds AS upper_median, low, high, round(high / greatest(low, 1), 6) AS dispersion FROM r WHERE rk = n // 2""",
)
def a13_cost_dispersion(spark, d):
    return _rounded(runs.cost_dispersion(run_log(spark, d), ["model"], "seconds"), ["dispersion"], 6)


@query(
    "a15_cost_per_case",
    f"""WITH {RUNLOG_SQL}, s AS (SELECT model, seconds / greatest(n_raised, 1) AS s, seconds, n_raised FROM runlog)
      SELECT model, round(avg(s), 6) AS mean_seconds, round(min(s), 6) AS min_seconds, round(max(s), 6) AS max_seconds, round(sum(seconds), 4) AS total_seconds, CAST(sum(n_raised) AS BIGINT) AS n_cases,
      round(avg(s) * sum(n_raised), 4) AS extrapolated, round(CASE model WHEN 'm_a' THEN 2.5e0 ELSE 5e0 END * sum(n_raised), 4) AS prior_seconds FROM s GROUP BY model""",
)
def a15_cost_per_case(spark, d):
    c = runs.cost_per_case(run_log(spark, d), "model", "seconds", "n_raised", {"m_a": 2.5})
    c = _rounded(c, ["mean_seconds", "min_seconds", "max_seconds"], 6)
    return _rounded(c, ["total_seconds", "extrapolated", "prior_seconds"], 4)


@query(
    "a16_level_ablation",
    f"""WITH {RUNLOG_SQL}, r AS (SELECT * FROM runlog WHERE mode = 'revisa'), p AS (SELECT level, avg(n_discarded) AS m, sum(n_right_discards) / nullif(CAST(sum(n_discarded) AS DOUBLE), 0) AS rs FROM r GROUP BY level),
      s AS (SELECT level, model, seed, min(n_discarded) = max(n_discarded) AS same FROM r GROUP BY 1, 2, 3), i AS (SELECT level, count(*) FILTER (same) AS n_identical, count(*) AS n_batches FROM s GROUP BY level)
      SELECT level, round(m, 9) AS mean_discards, round(rs, 9) AS right_share, n_identical, n_batches, round(100 * m / nullif((SELECT m FROM p WHERE level = 'completo'), 0), 6) AS volume_pct FROM p JOIN i USING (level)""",
)
def a16_level_ablation(spark, d):
    out = runs.level_ablation(run_log(spark, d), ["model", "seed"])
    return _rounded(_rounded(out, ["mean_discards", "right_share"]), ["volume_pct"], 6)


_PAIRS_SQL = f"""{RUNLOG_SQL}, pairs AS (SELECT model, level, seed, repetition, max(recall_system) FILTER (mode = 'interpreta') AS interpreta,
  max(recall_system) FILTER (mode = 'revisa') AS revisa FROM runlog GROUP BY 1, 2, 3, 4 HAVING interpreta IS NOT NULL AND revisa IS NOT NULL)"""
_PAIR_KEYS = ["model", "level", "seed", "repetition"]


@query(
    "j5_mode_pairs",
    f"WITH {_PAIRS_SQL} SELECT model, level, seed, repetition, interpreta, revisa, revisa - interpreta AS diff FROM pairs",
)
def j5_mode_pairs(spark, d):
    return runs.mode_pairs(run_log(spark, d), _PAIR_KEYS)


@query(
    "j6_reaudit_update",
    f"""WITH a AS ({SQL['t13_audit']}), n AS (SELECT CAST(substr(text_id, 5) AS BIGINT) AS run_id, audit, audit = '{K.AUDIT_RELIABLE}' AS reliable FROM a WHERE text_id LIKE 'run:%'),
      lg AS (SELECT DISTINCT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 / 21600e0) AS BIGINT) AS run_id FROM events),
      old AS (SELECT run_id, run_id % 2 = 0 AS reliable, CASE WHEN run_id % 2 = 0 THEN '{K.AUDIT_RELIABLE}' ELSE '{K.AUDIT_INCOMPLETE}' END AS audit FROM lg)
      SELECT o.run_id, CASE WHEN n.reliable <> o.reliable THEN n.reliable ELSE o.reliable END AS reliable,
      CASE WHEN n.reliable <> o.reliable THEN n.audit ELSE o.audit END AS audit, coalesce(n.reliable <> o.reliable, false) AS changed FROM old o LEFT JOIN n USING (run_id)""",
)
def j6_reaudit_update(spark, d):
    from casemill.plans.reviews import run_texts, with_run

    even = F.col("run_id") % 2 == 0
    old = with_run(transactions(spark, d)).select("run_id").distinct().withColumns(
        {"reliable": even, "audit": F.when(even, K.AUDIT_RELIABLE).otherwise(K.AUDIT_INCOMPLETE)}
    )
    known = F.sequence(F.lit(1).cast("bigint"), F.lit(texts.UNIVERSE).cast("bigint"))
    new = audit.audit_reports(run_texts(spark, d).withColumn("universe", known), "text", "case_ids", "universe")
    # The log as it was stays readable beside the version that the new audit makes.
    log = VersionedLog(spark, f"{shared_dir(spark)}/audits-{uuid.uuid4().hex}", ["run_id"])
    before = log.append(old)
    changes = audit.reaudit_update(log.read(), new, ["run_id"]).filter("changed").drop("changed")
    after = log.update(changes, before.version)
    was = log.read(before.version).select("run_id", F.col("reliable").alias("_was"))
    now = log.read(after.version).join(was, "run_id")
    return now.select("run_id", "reliable", "audit", (F.col("reliable") != F.col("_was")).alias("changed"))


@query(
    "h1_fisher",
    f"""WITH {RUNLOG_SQL}, t AS (SELECT level, count(*) FILTER (model = 'm_a' AND n_destroyed > 0) AS a, count(*) FILTER (model = 'm_a' AND n_destroyed = 0) AS b,
        count(*) FILTER (model = 'm_b' AND n_destroyed > 0) AS c, count(*) FILTER (model = 'm_b' AND n_destroyed = 0) AS d FROM runlog WHERE mode = 'revisa' GROUP BY level),
      k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t),
      pr AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1)
        - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM k),
      o AS (SELECT level, p AS po FROM pr WHERE x = a)
      SELECT level, round(least(sum(p) FILTER (p <= po * (1 + 1e-7)), 1), 8) AS p_value, least(sum(p) FILTER (p <= po * (1 + 1e-7)), 1) < 0.05 AS significant FROM pr JOIN o USING (level) GROUP BY level""",
)
def h1_fisher(spark, d):
    rev = run_log(spark, d).filter(F.col("mode") == K.MODE_REVIEW)
    lost = F.col("n_destroyed") > 0
    cells = rev.groupBy("level").agg(
        *[
            F.count_if((F.col("model") == m) & (lost if bad else ~lost)).alias(name)
            for m, bad, name in (("m_a", True, "a"), ("m_a", False, "b"), ("m_b", True, "c"), ("m_b", False, "d"))
        ]
    )
    return _rounded(stats.fisher_exact(cells, ["level"], "a", "b", "c", "d"), ["p_value"], 8)


_ERFC = "1 - exp(-x * x) * list_sum([exp((2 * i + 1) * ln(x) - lgamma(i + 1.5e0)) for i in range(120)])"


@query(
    "h2_wilcoxon",
    f"""WITH {_PAIRS_SQL}, df AS (SELECT model, revisa - interpreta AS d FROM pairs),
      c AS (SELECT model, count(*) AS n_pairs, count(*) FILTER (d < 0) AS n_worse, count(*) FILTER (d = 0) AS n_zero FROM df GROUP BY model),
      r AS (SELECT model, d, abs(d) AS m, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2e0 AS rk,
        count(*) OVER (PARTITION BY model, abs(d)) AS t FROM df WHERE d <> 0),
      s AS (SELECT model, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1e0) AS ties FROM r GROUP BY model),
      z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4e0) / sqrt((n * (n + 1) * (2e0 * n + 1) - ties / 2) / 24) AS z FROM s),
      x AS (SELECT *, greatest(abs(z) / sqrt(2e0), 1e-12) AS x FROM z)
      SELECT model, n_pairs, n_worse, n_zero, w_plus, w_minus, round(z, 8) AS z, round({_ERFC}, 8) AS p_value FROM c JOIN x USING (model)""",
)
def h2_wilcoxon(spark, d):
    pairs = runs.mode_pairs(run_log(spark, d), _PAIR_KEYS)
    return _rounded(stats.wilcoxon(pairs, "diff", ["model"]).drop("method"), ["z", "p_value"], 8)


@query(
    "f6_timeout_flag",
    f"""WITH {TEXTS_SQL}, g AS (SELECT run_id, round(avg(amount), 6) AS seconds_per_task, list(text) AS outs FROM texts GROUP BY run_id)
      SELECT run_id, seconds_per_task, seconds_per_task > 162 OR len([x for x in outs if length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 50]) > 0 AS suspected FROM g""",
)
def f6_timeout_flag(spark, d):
    per_run = case_texts(run_cases(spark, d)).groupBy("run_id").agg(
        R(F.avg("amount"), 6).alias("seconds_per_task"), F.collect_list("text").alias("outputs")
    )
    return per_run.select(
        "run_id", "seconds_per_task",
        runs.timeout_suspected(F.col("seconds_per_task"), F.col("outputs")).alias("suspected"),
    )


@query(
    "e9_inflation",
    f"""WITH {TX}, v AS (SELECT m AS model, label, CASE m WHEN 'amount' THEN prob WHEN 'k' THEN k / 99e0 ELSE (prob + k / 99e0) / 2 END AS score FROM tx, (VALUES ('amount'), ('k'), ('mixed')) t(m)),
      g AS (SELECT model, score, sum(label) AS pos, count(*) AS n FROM v GROUP BY 1, 2),
      s AS (SELECT model, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
      a AS (SELECT model, sum(pos * (cp / CAST(cn AS DOUBLE))) / sum(pos) AS ap FROM s GROUP BY model),
      b AS (SELECT max(ap) AS best, arg_max(model, ap) AS who FROM a WHERE model <> 'mixed')
      SELECT model, round(ap, 9) AS auc_pr, who AS best_clean, round(best, 9) AS best_value, round(ap - best, 9) AS inflation, round((ap - best) / best, 9) AS relative FROM a, b WHERE model = 'mixed'""",
)
def e9_inflation(spark, d):
    tx = transactions(spark, d).withColumn("split", F.lit("all"))
    areas = metrics.curve_areas(detector._three_scores(tx), "score", "label", ["model"])
    flagged = areas.withColumn("clean", F.col("model") != "mixed")
    return _rounded(
        system.inflation(flagged, "model", "clean", "auc_pr"), ["auc_pr", "best_value", "inflation", "relative"]
    )


# ---- windows -----------------------------------------------------------------------

HOUR = 3600

_WIN_SQL = f"""{TX}, o AS (SELECT min(t_sec) AS s FROM tx), w AS (SELECT tx.*, s, CAST(floor((t_sec - s) / 3600e0) AS BIGINT) AS window_id FROM tx, o),
wc AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY prob DESC, tx_id) AS case_no FROM w WHERE prob >= 0.7e0 QUALIFY case_no <= 60),
cnt AS (SELECT window_id, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM w GROUP BY window_id),
pc AS (SELECT window_id, count(*) AS n_cases, count(*) FILTER (label = 1) AS pr, avg(s + (window_id + 1) * 3600e0 - t_sec) FILTER (label = 1) AS wm, max(s + (window_id + 1) * 3600e0 - t_sec) FILTER (label = 1) AS wx FROM wc GROUP BY window_id),
lg0 AS (SELECT window_id, n_rows, positives, coalesce(n_cases, 0) AS n_cases, coalesce(pr, 0) AS positives_raised, CASE WHEN coalesce(n_cases, 0) > 0 THEN (n_cases + 2) * 6.8e0 ELSE 0 END AS cost_sec, wm, wx FROM cnt LEFT JOIN pc USING (window_id)),
lg AS (SELECT window_id, n_rows, positives, n_cases, positives_raised, cost_sec, CASE WHEN n_cases > 0 THEN 'ESTIMADO' ELSE 'sin casos' END AS status,
  round((wm + cost_sec) / 60, 2) AS latency_mean_min, round((wx + cost_sec) / 60, 2) AS latency_max_min FROM lg0)"""


def _windowed(spark, d):
    return windows.with_window(transactions(spark, d), "t_sec", HOUR)


def _log(spark, d):
    return windows.window_log(_windowed(spark, d), "t_sec", HOUR, 60, 0.7)


@query("w5_window_id", f"WITH {_WIN_SQL} SELECT tx_id, window_id FROM w")
def w5_window_id(spark, d):
    return _windowed(spark, d).select("tx_id", "window_id")


@query("x1_window_counts", f"WITH {_WIN_SQL} SELECT window_id, n_rows, positives FROM cnt")
def x1_window_counts(spark, d):
    return windows.window_counts(_windowed(spark, d))


@query("x2_window_cases", f"WITH {_WIN_SQL} SELECT window_id, case_no, tx_id, prob FROM wc")
def x2_window_cases(spark, d):
    return windows.window_cases(_windowed(spark, d), 60, 0.7).select("window_id", "case_no", "tx_id", "prob")


@query("x3_cost", f"WITH {_WIN_SQL} SELECT window_id, n_cases, round(cost_sec, 6) AS cost_sec, status FROM lg")
def x3_cost(spark, d):
    return _log(spark, d).select("window_id", "n_cases", R("cost_sec", 6).alias("cost_sec"), "status")


@query(
    "x4_latency",
    f"WITH {_WIN_SQL} SELECT window_id, positives_raised, latency_mean_min, latency_max_min FROM lg",
)
def x4_latency(spark, d):
    return _log(spark, d).select("window_id", "positives_raised", "latency_mean_min", "latency_max_min")


@query(
    "x5_occupancy",
    f"""WITH {_WIN_SQL} SELECT count(*) AS n_windows, count(*) FILTER (n_cases > 0) AS n_with_cases, round(sum(cost_sec), 6) AS total_cost_sec,
      count(*) FILTER (cost_sec > 3600) AS n_overflow, round(avg(latency_mean_min), 6) AS latency_mean_min, max(latency_max_min) AS latency_max_min,
      round(sum(cost_sec) / (count(*) * 3600e0), 9) AS occupancy FROM lg""",
)
def x5_occupancy(spark, d):
    o = windows.occupancy(_log(spark, d), HOUR)
    return _rounded(_rounded(o, ["total_cost_sec", "latency_mean_min"], 6), ["occupancy"])


@query(
    "x6_size_sweep",
    f"""WITH {TX}, o AS (SELECT min(t_sec) AS s FROM tx) SELECT m AS minutes, round(avg((floor((t_sec - s) / (m * 60e0)) + 1) * m * 60e0 - (t_sec - s)) / 60, 6) AS mean_wait_min, m / 2e0 AS expected_min
      FROM tx, o, (VALUES (5), (10), (15), (30), (60)) v(m) GROUP BY m""",
)
def x6_size_sweep(spark, d):
    return _rounded(windows.size_sweep(transactions(spark, d), "t_sec", [5, 10, 15, 30, 60]), ["mean_wait_min"], 6)


@query(
    "x7_max_windows",
    f"""WITH {_WIN_SQL}, n AS (SELECT max(window_id) AS last FROM (SELECT window_id FROM lg WHERE n_cases > 0 ORDER BY window_id LIMIT 20))
      SELECT window_id, n_rows, n_cases FROM lg, n WHERE window_id <= last""",
)
def x7_max_windows(spark, d):
    return windows.first_windows(_log(spark, d), 20).select("window_id", "n_rows", "n_cases")
