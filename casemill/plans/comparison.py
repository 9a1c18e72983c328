"""Queries: bootstrap comparison of two detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators import bootstrap, metrics, profile, stats
from casemill.plans.registry import TX, hash32_sql, query
from casemill.sources.tables import transactions

R = F.round
REPS = 2000

_HASH_RUN = f"CAST(('0x' || substr(md5('42:' || {{tag}} || ':' || CAST(r AS VARCHAR)), 1, 8)) AS BIGINT) % {bootstrap.PRIME}"
_STEPS = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in bootstrap.STEPS)
_BOOT_SQL = f"""{TX},
reps AS (SELECT r, greatest({_HASH_RUN.format(tag="'mul'")}, 1) AS mul, {_HASH_RUN.format(tag="'add'")} AS add_ FROM range({REPS}) t(r)),
base AS (SELECT tx_id, label, prob AS a, (prob + k / 99e0) / 2 AS b, {hash32_sql('42', 'tx_id')} % {bootstrap.PRIME} AS h FROM tx),
draws AS (SELECT r, label, a, b, (h * mul + add_) % {bootstrap.PRIME} AS u FROM base, reps),
w AS (SELECT r, label, a, b, {_STEPS} AS w FROM draws),
sz AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM base),
long_ AS (SELECT r, 'a' AS m, a AS s, label, w FROM w UNION ALL SELECT r, 'b', b, label, w FROM w),
g AS (SELECT m, r, s, coalesce(sum(w) FILTER (label = 1), 0) AS p, coalesce(sum(w) FILTER (label = 0), 0) AS n FROM long_ GROUP BY 1, 2, 3),
c AS (SELECT m, r, p, sum(p) OVER x AS cp, sum(n) OVER x AS cn, sum(p) OVER y AS tp, sum(n) OVER y AS tn FROM g
  WINDOW x AS (PARTITION BY m, r ORDER BY s DESC), y AS (PARTITION BY m, r)),
ap AS (SELECT m, r, sum(c.p / CAST(tp AS DOUBLE) * (cp * (sz.p / CAST(tp AS DOUBLE)) / (cp * (sz.p / CAST(tp AS DOUBLE)) + cn * (sz.n / CAST(tn AS DOUBLE))))) AS ap FROM c, sz WHERE c.p > 0 GROUP BY 1, 2),
df AS (SELECT r AS rep, max(ap) FILTER (m = 'b') - max(ap) FILTER (m = 'a') AS diff FROM ap GROUP BY r),
boot AS (SELECT count(*) AS n_reps, avg(diff) AS mean_diff, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high,
  avg(CAST(diff > 0 AS INTEGER)) AS p_better FROM df)"""


def _two_scores(spark, d):
    tx = transactions(spark, d)
    return tx.select("tx_id", "label", F.col("prob").alias("a"), ((F.col("prob") + F.col("k") / 99.0) / 2).alias("b"))


def _boot(spark, d):
    return bootstrap.summarise(
        bootstrap.paired_difference(_two_scores(spark, d), "a", "b", "label", "tx_id", REPS)
    )


@query(
    "d13_bootstrap_ap",
    f"""WITH {_BOOT_SQL} SELECT n_reps, round(mean_diff, 8) AS mean_diff, round(low, 8) AS low, round(high, 8) AS high,
      round(p_better, 8) AS p_better, low > 0 OR high < 0 AS significant FROM boot""",
)
def d13_bootstrap_ap(spark, d):
    return _boot(spark, d).withColumns({c: R(c, 8) for c in ("mean_diff", "low", "high", "p_better")})


@query(
    "h3_reading",
    f"""WITH {_BOOT_SQL}, rk AS (SELECT m, label, row_number() OVER (PARTITION BY m ORDER BY s DESC, tx_id) AS rank FROM
        (SELECT tx_id, label, 'a' AS m, a AS s FROM base UNION ALL SELECT tx_id, label, 'b', b FROM base)),
      pn AS (SELECT n, m, avg(label) AS p FROM rk, (VALUES (20), (50), (100)) t(n) WHERE rank <= n GROUP BY 1, 2),
      gap AS (SELECT round(max(abs(x.p - y.p)), 6) <= 0.02 AS eq FROM pn x JOIN pn y USING (n) WHERE x.m = 'a' AND y.m = 'b')
      SELECT CASE WHEN mean_diff > 0 THEN 'b' ELSE 'a' END AS winner, CASE WHEN NOT (low > 0 OR high < 0) THEN 'no evidence of a difference'
      WHEN eq THEN 'significant but alike at the head of the ranking' WHEN mean_diff <= 0 THEN 'the chosen model wins at the head too'
      ELSE 'the other model wins at the head: reconsider the choice' END AS reading FROM boot, gap""",
)
def h3_reading(spark, d):
    rows = _two_scores(spark, d)
    long = rows.select(
        "tx_id", "label", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("model", "score")
    )
    p = metrics.precision_at(long, "score", "label", "tx_id", K.COMPARE_N, ["model"])
    alike = profile.head_equivalence(p, "model", ("a", "b"), [n for n in K.COMPARE_N if n <= 100])
    row = _boot(spark, d).withColumn("equivalent", alike.select("equivalent").scalar())
    return stats.comparison_reading(row).select("winner", "reading")
