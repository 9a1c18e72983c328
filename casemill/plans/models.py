"""Queries: trained detectors, contributions, oversampling, search and ablations.

The detectors learn transactions, whose label follows from amount, category and ``k``, so a model that
learned nothing fails the bounds that SQL states.  The ablations and the search work on embeddings.
"""

from __future__ import annotations

import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import risk_tier
from casemill.operators import anomaly, metrics, models, oversample, splits, trees
from casemill.operators.explain import ranked
from casemill.operators.selection import select_cases
from casemill.operators.system import inflation
from casemill.plans.registry import TX, hash32_sql, query
from casemill.session import durable, shared_dir
from casemill.sources.tables import embedding_rows, transactions

R = F.round
COLS = K.FEATURE_COLS
#: Sizes of the ablation of variables here (README).
SMALL = {"n_estimators": 5, "max_depth": 3}


def _transactions(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    """Transactions with a column per category, the earlier four fifths and the later fifth, and the feature names."""
    tx = transactions(spark, d)
    names = sorted(r[0] for r in tx.select("category").distinct().limit(101).collect())  # event types: five
    if len(names) > 100:
        raise ValueError("more than 100 categories: encode them first")
    flags = {f"is_{n}": (F.col("category") == n).cast("double") for n in names}
    rows = splits.temporal_split(tx.withColumns({**flags, "k": F.col("k").cast("double")}), "t_sec", "tx_id")
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test"), ["amount", "k", "hour", *flags]


_LATER = f"""{TX}, o AS (SELECT *, row_number() OVER (ORDER BY t_sec, tx_id) - 1 AS rk, count(*) OVER () AS n FROM tx),
te AS (SELECT * FROM o WHERE rk >= floor(n * 0.8e0))"""


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = splits.temporal_split(embedding_rows(spark, d), "Time", "tx_id")
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")


#: The later fifth of the labelled rows, on which models are judged.
_TEST = """o AS (SELECT vec_id AS tx_id, CAST(label = 0 AS INTEGER) AS cls, row_number() OVER (ORDER BY vec_id) - 1 AS rk, count(*) OVER () AS n FROM embeddings),
te AS (SELECT * FROM o WHERE rk >= floor(n * 0.8e0))"""


def _holds(model, test: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Counts of the judged rows, whether probabilities, tiers and metrics agree, and whether the model ranks well."""
    scored = durable(models.score(model, test, cols).select("tx_id", "label", "prob", "tier")).withColumn("model", F.lit(name))
    rows = scored.groupBy("model").agg(
        F.sum("label").alias("n_pos"),
        F.bool_and(F.col("prob").between(0, 1)).alias("prob_in_range"),
        F.bool_and(F.col("tier") == risk_tier(F.col("prob"))).alias("tier_agrees"),
    )
    block = metrics.metric_block(scored, "prob", "label", "tx_id", by=["model"])
    # A constant score has the prevalence as its area and one half of the ROC square.
    ranks_well = (F.col("auc_pr") >= 5 * F.col("n_pos") / F.col("n_rows")) & (F.col("roc_auc") >= 0.9)
    return block.join(rows, "model").select(
        "model", "n_rows", "n_pos", "prob_in_range", "tier_agrees", ranks_well.alias("ranks_well"),
        (F.col("tp") + F.col("fn") == F.col("n_pos")).alias("positives_agree"),
    )


def _holds_sql(name: str) -> str:
    return f"""WITH {_LATER} SELECT '{name}' AS model, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos, TRUE AS prob_in_range, TRUE AS tier_agrees,
      TRUE AS ranks_well, TRUE AS positives_agree FROM te"""


@query("m1_boosted_trees", _holds_sql("boosted"))
def m1_boosted_trees(spark, d):
    train, test, cols = _transactions(spark, d)
    return _holds(models.train_boosted(train, cols, "label"), test, cols, "boosted")


@query("m2_random_forest", _holds_sql("forest"))
def m2_random_forest(spark, d):
    train, test, cols = _transactions(spark, d)
    return _holds(models.train_forest(train, cols, "label"), test, cols, "forest")


@query(
    "m3_isolation_forest",
    f'WITH {_TEST} SELECT tx_id, cls AS "Class", TRUE AS in_range, 0e0 AS lowest, 1e0 AS highest FROM te',
)
def m3_isolation_forest(spark, d):
    train, test = _parts(spark, d)
    scored = anomaly.fit_isolation_forest(train, COLS, "tx_id").score(test)
    ends = scored.agg(F.struct(F.min("score_anomalia").alias("lo"), F.max("score_anomalia").alias("hi"))).scalar()
    return scored.select(
        "tx_id", "Class", F.col("score_anomalia").between(0, 1).alias("in_range"), ends["lo"].alias("lowest"), ends["hi"].alias("highest")
    )


@query("m5_tree_contrib", f"WITH {_LATER} SELECT tx_id, TRUE AS prob_in_range, TRUE AS additive, prob >= 0.5e0 AND label = 1 AS raised_by_category FROM te")
def m5_tree_contrib(spark, d):
    train, test, cols = _transactions(spark, d)
    model = models.train_boosted(train, cols, "label", n_estimators=100)
    scored = models.score(model, test.withColumn("rule", F.col("prob")).drop("prob", "tier"), cols)
    out = trees.tree_contributions(model, scored, cols)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contrib"]) + F.col("bias")
    # The parts and the bias must give back the log-odds of the score.
    margin = F.log(F.col("prob") / (1 - F.col("prob")))
    of_category = F.aggregate(F.filter("contributions", lambda c: c["var"] == "is_error"), F.lit(0.0), lambda a, c: a + c["contrib"])
    # Only errors are positive: the category speaks for every positive row.
    speaks = (F.col("rule") >= 0.5) & (F.col("label") == 1) & (of_category > 0)
    return out.select("tx_id", F.col("prob").between(0, 1).alias("prob_in_range"), (F.abs(total - margin) < 1e-6).alias("additive"), speaks.alias("raised_by_category"))


_SMOTE_SQL = f"""e AS (SELECT vec_id AS id, CAST(embedding[1:28] AS DOUBLE[]) || [(vec_id * 37) % 500 / 2e0, vec_id * 7 % 240 / 10e0] AS x, label = 0 AS pos FROM embeddings),
m AS (SELECT id, x, {hash32_sql('42', "'smote'", 'id')} AS h FROM e WHERE pos),
nn AS (SELECT a.id AS parent, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM m a JOIN m b ON a.id <> b.id),
sz AS (SELECT count(*) FILTER (NOT pos) AS n0, count(*) FILTER (pos) AS n1, max(id) + 1 AS top FROM e),
cp AS (SELECT id AS parent, x, (n0 - n1) // n1 AS base_, (n0 - n1) // n1 + CAST(row_number() OVER (ORDER BY h, id) - 1 < (n0 - n1) % n1 AS INTEGER) AS copies, top FROM m, sz),
made AS (SELECT parent, x, base_, top, unnest(range(copies)) AS replica FROM cp),
pk AS (SELECT *, {hash32_sql('42', "'nb'", 'parent', 'replica')} % 5 AS p, {hash32_sql('42', "'lam'", 'parent', 'replica')} / 4294967296e0 AS lam FROM made),
syn AS (SELECT top + pk.parent * (base_ + 1) + replica AS tx_id, pk.parent, replica, neighbour, lam, pk.x[1] + lam * (m.x[1] - pk.x[1]) AS v1, pk.x[29] + lam * (m.x[29] - pk.x[29]) AS amount
  FROM pk JOIN nn ON nn.parent = pk.parent AND nn.r = p + 1 JOIN m ON m.id = neighbour)"""


def _synthetic(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = embedding_rows(spark, d)
    # The SQL beside it knows all pairs.
    return rows, oversample.oversample(rows, "Class", "tx_id", COLS, method="exact")


@query(
    "d11_smote",
    f"WITH {_SMOTE_SQL} SELECT tx_id, parent, replica, neighbour, round(lam, 9) AS lam, round(v1, 8) AS v1, round(amount, 6) AS amount FROM syn",
)
def d11_smote(spark, d):
    made = _synthetic(spark, d)[1]
    return made.select(
        "tx_id", "parent", "replica", "neighbour", R("lam", 9).alias("lam"), R("V1", 8).alias("v1"), R("Amount", 6).alias("amount")
    )


@query(
    "d12_leak_share",
    f"""WITH {_SMOTE_SQL}, al AS (SELECT id AS tx_id, CAST(pos AS INTEGER) AS label FROM e UNION ALL SELECT tx_id, 1 FROM syn),
      o AS (SELECT tx_id, row_number() OVER (PARTITION BY label ORDER BY {hash32_sql('42', 'tx_id')}, tx_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM al),
      s AS (SELECT tx_id, rk < round_even(0.2e0 * n, 0) AS test FROM o),
      j AS (SELECT NOT p.test OR NOT q.test AS leaky FROM syn JOIN s t ON t.tx_id = syn.tx_id AND t.test JOIN s p ON p.tx_id = parent JOIN s q ON q.tx_id = neighbour)
      SELECT (SELECT count(*) FROM s WHERE test) AS n_test, count(*) AS n_synthetic_test, count(*) FILTER (leaky) AS n_leaky,
      round(count(*) FILTER (leaky) / (SELECT CAST(count(*) AS DOUBLE) FROM s WHERE test), 9) AS share FROM j""",
)
def d12_leak_share(spark, d):
    rows, made = _synthetic(spark, d)
    everything = rows.select("tx_id", "Class").unionByName(made.select("tx_id", "Class"))
    split = splits.stratified_split(everything, "Class", "tx_id")
    return oversample.leak_share(split, made, "tx_id").withColumn("share", R("share", 9))


_DRAWS = 50


@query(
    "m7_param_search",
    f"WITH {_LATER} SELECT scheme, count(*) AS n_test, {_DRAWS} AS n_draws, TRUE AS best_was_drawn, TRUE AS ranks_well, TRUE AS gain_agrees "
    "FROM te, (VALUES ('stratified'), ('past_only')) v(scheme) GROUP BY scheme",
)
def m7_param_search(spark, d):
    """The published search: its space, fifty draws, three folds, under both schemes."""
    train, test, cols = _transactions(spark, d)
    space = K.SEARCH_SPACE
    ways = {
        "stratified": (splits.stratified_folds(train, "label", "tx_id", 3), "fold", False),
        "past_only": (splits.time_folds(train, "t_sec", "tx_id", 3), "block", True),
    }
    rows = []
    prevalence = test.agg(F.avg("label")).first()[0]
    for scheme, (folded, column, past_only) in ways.items():
        found = models.random_search(
            train, test, folded, column, 3, past_only, cols, "label", space=space, base=K.SEARCH_BASE, n_draws=_DRAWS
        )
        best = {k: v for k, v in found["best"].items() if k in space}
        gain = found["auc_pr_tuned"] - found["auc_pr_reference"]
        well = min(found["auc_pr_cv"], found["auc_pr_tuned"]) >= 3 * prevalence
        rows.append((scheme, found["n_draws"], best in list(models.draws(space, _DRAWS)), bool(well), found["gain"] == gain))
    told = spark.createDataFrame(rows, "scheme string, n_draws int, best_was_drawn boolean, ranks_well boolean, gain_agrees boolean")
    n = test.agg(F.count("*").alias("n_test"))
    return told.withColumn("n_test", n.scalar()).select("scheme", "n_test", "n_draws", "best_was_drawn", "ranks_well", "gain_agrees")


@query(
    "m8_group_ablation",
    f"""WITH {_TEST} SELECT model, n_features, n_rows, TRUE AS delta_agrees, TRUE AS reading_agrees
      FROM (VALUES ('full', 30), ('without_hour', 29), ('without_amount', 29), ('pca_only', 28)) g(model, n_features), (SELECT count(*) AS n_rows FROM te)""",
)
def m8_group_ablation(spark, d):
    train, test = _parts(spark, d)
    out = models.group_ablation(train, test, "Class", "tx_id", **SMALL)
    out = durable(out.select("model", "n_features", "n_rows", "auc_pr", "delta", "reading"))
    full = out.filter(F.col("model") == "full").select("auc_pr").scalar()
    gap = F.col("auc_pr") - full
    says = F.when(gap > K.ABLATION_TOLERANCE, "better without").when(gap < -K.ABLATION_TOLERANCE, "worse without").otherwise("no difference")
    return out.select(
        "model", "n_features", "n_rows", (F.abs(F.col("delta") - gap) < 1e-12).alias("delta_agrees"), (F.col("reading") == says).alias("reading_agrees")
    )


def _imbalance(spark, d) -> DataFrame:
    """Five evaluations of four treatments; the last two leak on purpose."""
    train, test = _parts(spark, d)
    keep = ["tx_id", *COLS, "Class"]
    more = train.select(keep).unionByName(oversample.oversample(train, "Class", "tx_id", COLS).select(keep))
    rows, made = _synthetic(spark, d)
    mixed = splits.stratified_split(rows.select(keep).unionByName(made.select(keep)), "Class", "tx_id")
    treated = [(train, 1.0), (train, None), (more, 1.0), (mixed.filter(F.col("split") == "train"), 1.0)]
    # Fits of the published size, side by side.
    with ThreadPool(len(treated)) as pool:
        plain, weighted, after, leaky = pool.map(lambda t: models.train_boosted(t[0], pos_weight=t[1]), treated)
    blocks = []

    def add(name: str, clean: bool, model, rows: DataFrame) -> None:
        block = models.evaluate(model, rows, COLS, "Class", "tx_id", name)
        blocks.append(block.withColumn("clean", F.lit(clean)))

    add("none", True, plain, test)
    add("weights", True, weighted, test)
    add("oversample_after_split", True, after, test)
    add("oversample_before_split", False, leaky, mixed.filter(F.col("split") == "test"))
    add("oversample_before_split_original_test", False, leaky, test)
    return reduce(DataFrame.unionByName, blocks)


@query(
    "m9_imbalance_ablation",
    f"""WITH {_SMOTE_SQL}, {_TEST}, al AS (SELECT id AS tx_id, CAST(pos AS INTEGER) AS label FROM e UNION ALL SELECT tx_id, 1 FROM syn),
      rk AS (SELECT row_number() OVER (PARTITION BY label ORDER BY {hash32_sql('42', 'tx_id')}, tx_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM al),
      mixed AS (SELECT count(*) AS n FROM rk WHERE rk < round_even(0.2e0 * n, 0))
      SELECT model, clean, CASE WHEN own THEN (SELECT n FROM mixed) ELSE (SELECT count(*) FROM te) END AS n_rows, NOT clean AS inflated, TRUE AS area_in_range
      FROM (VALUES ('none', TRUE, FALSE), ('weights', TRUE, FALSE), ('oversample_after_split', TRUE, FALSE), ('oversample_before_split', FALSE, TRUE),
        ('oversample_before_split_original_test', FALSE, FALSE)) t(model, clean, own)""",
)
def m9_imbalance_ablation(spark, d):
    out = _imbalance(spark, d)
    worse = inflation(out, "model", "clean", "auc_pr").select("model", "best_value", "inflation")
    both = out.join(worse, "model", "left")
    # Only treatments that leak are held against the best clean one.
    agrees = F.abs(F.col("inflation") - (F.col("auc_pr") - F.col("best_value"))) < 1e-12
    return both.select("model", "clean", "n_rows", F.coalesce(agrees, F.lit(False)).alias("inflated"), F.col("auc_pr").between(0, 1).alias("area_in_range"))


@query(
    "s11_model_roundtrip",
    f"WITH {_LATER}, top AS (SELECT tx_id FROM te WHERE label = 1) SELECT tx_id, TRUE AS prob_in_range, TRUE AS same, tx_id IN (SELECT tx_id FROM top) AS positive FROM te",
)
def s11_model_roundtrip(spark, d):
    """The forest saved, loaded and scored again."""
    from pyspark.ml.classification import RandomForestClassificationModel

    train, test, cols = _transactions(spark, d)
    model = models.train_forest(train, cols, "label")
    path = f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    again = RandomForestClassificationModel.load(path)
    a = models.score(model, test, cols).select("tx_id", "label", "prob")
    b = models.score(again, test, cols).select("tx_id", F.col("prob").alias("prob_loaded"))
    return a.join(b, "tx_id").select(
        "tx_id", F.col("prob").between(0, 1).alias("prob_in_range"), (F.col("prob") == F.col("prob_loaded")).alias("same"), (F.col("label") == 1).alias("positive")
    )


@query(
    "m4_trained_triage",
    f"WITH {_LATER}, s AS (SELECT min(t_sec) AS s FROM te), w AS (SELECT te.* FROM te, s WHERE t_sec >= s.s AND t_sec < s.s + 86400) "
    "SELECT (SELECT count(*) FROM w) AS n_rows, (SELECT CAST(sum(label) AS BIGINT) FROM w) AS n_pos, TRUE AS all_selected, TRUE AS in_score_order, TRUE AS explained",
)
def m4_trained_triage(spark, d):
    """Train, save, load, score a shift of a day, select its cases and explain them, at the published forest size.

    All positives of the shift are among the selected cases, a share of its rows; each case comes with
    its largest contributions.
    """
    from pyspark.ml.classification import GBTClassificationModel

    train, test, cols = _transactions(spark, d)
    path = f"{shared_dir(spark)}/triage-{uuid.uuid4().hex}"
    models.train_boosted(train, cols, "label", n_estimators=100).write().overwrite().save(path)
    model = GBTClassificationModel.load(path)
    start = test.agg(F.min("t_sec")).first()[0]
    day = splits.shift(test.drop("prob", "tier"), "t_sec", start, hours=24.0)
    scored = durable(models.score(model, day, cols))
    n = scored.agg(F.count("*"), F.sum("label")).first()
    cases = durable(select_cases(scored, "prob", "tx_id", max(10, n[0] // 10), 0.2, 5))
    top = trees.tree_contributions(model, cases, cols).withColumn("top", ranked(F.col("contributions"), 3))
    return top.agg(
        F.sum("label").alias("_found"), F.max(F.struct("case_no", "prob")).alias("_last"), F.min(F.struct("case_no", "prob")).alias("_first"),
        F.bool_and((F.size("top") == 3) & (F.abs(F.get("top", F.lit(0))["contrib"]) >= F.abs(F.get("top", F.lit(2))["contrib"]))).alias("explained"),
    ).select(
        F.lit(n[0]).alias("n_rows"), F.lit(n[1]).alias("n_pos"), (F.col("_found") == n[1]).alias("all_selected"),
        (F.col("_first.prob") >= F.col("_last.prob")).alias("in_score_order"), "explained",
    )


@query(
    "m8_delta_table",
    """WITH t(model, auc_pr) AS (SELECT CASE label % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'without_hour' WHEN 2 THEN 'without_amount' ELSE 'pca_only' END,
        round(avg(CAST(embedding[1] AS DOUBLE)), 9) FROM embeddings GROUP BY 1)
      SELECT model, auc_pr, round(auc_pr - f, 9) AS delta, CASE WHEN auc_pr - f > 0.005 THEN 'better without' WHEN auc_pr - f < -0.005 THEN 'worse without' ELSE 'no difference' END AS reading
      FROM t, (SELECT auc_pr AS f FROM t WHERE model = 'full')""",
)
def m8_delta_table(spark, d):
    # The table step of the ablation alone, on four group means of the embeddings.
    from casemill.sources.tables import load

    name = F.element_at(F.array(*[F.lit(g) for g in K.FEATURE_GROUPS]), F.col("label") % 4 + 1)
    rows = load(spark, d, "embeddings").groupBy(name.alias("model")).agg(
        R(F.avg(F.col("embedding")[0].cast("double")), 9).alias("auc_pr")
    )
    return models.ablation_deltas(rows, "model", "full", "auc_pr").withColumn("delta", R("delta", 9))
