"""Verdicts, joins with labels and the detector-versus-system measurement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.scalar import action_for, ratio
from casemill.functions.text import verdict_pairs


def extract_verdicts(texts: DataFrame, run: Sequence[str], text: str) -> DataFrame:
    """One verdict per (run, case number): the last one in the text wins."""
    run = list(run)
    pairs = texts.select(*run, F.posexplode(verdict_pairs(F.col(text))).alias("pos", "p"))
    return (
        pairs.select(*run, "pos", "p.case_no", "p.verdict")
        .filter(F.col("case_no").isNotNull())
        .groupBy(*run, "case_no")
        .agg(F.max_by("verdict", "pos").alias("verdict"))
    )


def lookup_cases(asked: DataFrame, cases: DataFrame, run: Sequence[str]) -> DataFrame:
    """Resolve case numbers to rows; unknown numbers stay, flagged, with a message."""
    run = list(run)
    found = asked.join(cases.select(*run, "case_no", "tx_id"), [*run, "case_no"], "left")
    return found.withColumn("known", F.col("tx_id").isNotNull()).withColumn(
        "message",
        F.when(~F.col("known"), F.concat(F.lit("ERROR: no existe el caso "), F.col("case_no"))),
    )


def labelled_verdicts(verdicts: DataFrame, cases: DataFrame, run: Sequence[str]) -> DataFrame:
    """Verdicts joined to the rows they refer to; unknown case numbers drop out."""
    run = list(run)
    return verdicts.join(cases.select(*run, "case_no", "tx_id", "label"), [*run, "case_no"])


def missed_positives(batch: DataFrame, cases: DataFrame, run: Sequence[str]) -> DataFrame:
    keys = [*run, "tx_id"]
    return batch.filter(F.col("label") == 1).join(cases.select(*keys), keys, "left_anti")


def missed_digest(missed: DataFrame, run: Sequence[str], amount: str, top: int = 8) -> DataFrame:
    """Per run: the largest missed amounts in order, and count and sum of the rest."""
    run = list(run)
    w = Window.partitionBy(*run).orderBy(F.desc(amount), "tx_id")
    head = missed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    heads = head.groupBy(*run).agg(
        F.sort_array(F.collect_list(F.struct("_r", "tx_id", amount))).alias("_top"),
        F.sum(amount).alias("_top_sum"),
    )
    totals = missed.groupBy(*run).agg(F.count("*").alias("n_missed"), F.sum(amount).alias("total"))
    return totals.join(heads, run).select(
        *run,
        "n_missed",
        F.transform("_top", lambda t: F.struct(t["tx_id"], t[amount])).alias("top"),
        (F.col("n_missed") - F.size("_top")).alias("n_rest"),
        (F.col("total") - F.col("_top_sum")).alias("rest"),
        "total",
    )


def measure_system(
    batch: DataFrame,
    cases: DataFrame,
    verdicts: DataFrame | None,
    run: Sequence[str],
    mode: str = K.MODE_INTERPRET,
) -> DataFrame:
    """What the detector raised against what survives review, one row per run.

    ``batch`` holds every row (run, tx_id, label), ``cases`` the selected file, and
    ``verdicts`` (run, case_no, verdict).  Without review authority verdicts are ignored.
    """
    run = list(run)
    totals = batch.groupBy(*run).agg(
        F.count("*").alias("n_batch"), F.sum(F.col("label").cast("long")).alias("positives")
    )
    file = cases.select(*run, "case_no", "tx_id", "label")
    if mode == K.MODE_REVIEW:
        given = verdicts.select(*run, "case_no", "verdict")
        joined = file.join(given, [*run, "case_no"], "left")
        # Confirmations are counted over all verdicts, also those of unknown cases.
        confirmed = given.groupBy(*run).agg(
            F.count_if(F.col("verdict") == K.CONFIRMED).alias("n_confirmed")
        )
    else:
        joined = file.withColumn("verdict", F.lit(None).cast("string"))
        confirmed = None
    out = F.col("verdict") == K.DISMISSED
    pos = F.col("label") == 1
    per_run = joined.groupBy(*run).agg(
        F.count("*").alias("n_cases"),
        F.count_if(pos).alias("positives_raised"),
        F.count_if(out).alias("n_discarded"),
        F.count_if(out & pos).alias("n_destroyed"),
        F.count_if(out & ~pos).alias("n_right_discards"),
        F.sort_array(F.collect_list(F.when(out & pos, F.col("tx_id")))).alias("destroyed_ids"),
    )
    wide = totals.join(per_run, run, "left")
    wide = (
        wide.join(confirmed, run, "left")
        if confirmed is not None
        else wide.withColumn("n_confirmed", F.lit(0).cast("long"))
    )
    counts = ["n_cases", "positives_raised", "n_discarded", "n_destroyed", "n_right_discards", "n_confirmed"]
    wide = wide.na.fill(0, counts)
    survived = F.col("positives_raised") - F.col("n_destroyed")
    return wide.select(
        *run,
        F.lit(mode).alias("mode"),
        "n_batch",
        "positives",
        *counts,
        (F.col("positives") - F.col("positives_raised")).alias("n_missed"),
        ratio(F.col("positives_raised"), F.col("positives")).alias("recall_detector"),
        ratio(F.col("positives_raised"), F.col("n_cases")).alias("precision_detector"),
        ratio(survived, F.col("positives")).alias("recall_system"),
        ratio(survived, F.col("n_cases") - F.col("n_discarded")).alias("precision_system"),
        F.coalesce("destroyed_ids", F.array().cast("array<bigint>")).alias("destroyed_ids"),
    )


def destroyed_share(measured: DataFrame) -> DataFrame:
    """Share of the detection lost in review, null when nothing was lost."""
    d, s = F.col("recall_detector"), F.col("recall_system")
    return measured.withColumn("destroyed_share", F.when(s < d, F.try_divide(d - s, d)))


def recommended_actions(cases: DataFrame, verdicts: DataFrame, run: Sequence[str]) -> DataFrame:
    run = list(run)
    joined = cases.join(verdicts.select(*run, "case_no", "verdict"), [*run, "case_no"], "left")
    return joined.withColumn("action", action_for(F.col("verdict")))


def completeness(cases: DataFrame, verdicts: DataFrame, run: Sequence[str]) -> DataFrame:
    """Verdicts against cases per run; a run with fewer verdicts is to be excluded."""
    run = list(run)
    want = cases.groupBy(*run).agg(F.count("*").alias("n_cases"))
    have = verdicts.groupBy(*run).agg(F.count("*").alias("n_verdicts"))
    return (
        want.join(have, run, "left")
        .na.fill(0, ["n_verdicts"])
        .withColumn("excluded", F.col("n_verdicts") < F.col("n_cases"))
    )


def split_complete(rows: DataFrame, status: DataFrame, run: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of complete runs, list of excluded runs)."""
    run = list(run)
    bad = status.filter("excluded")
    return rows.join(bad.select(*run), run, "left_anti"), bad


def verdict_flips(verdicts: DataFrame, key: Sequence[str], condition: str, pair: tuple[str, str]) -> DataFrame:
    """Verdict under two conditions side by side, and whether it changes."""
    a, b = pair
    wide = verdicts.groupBy(*key).pivot(condition, [a, b]).agg(F.max("verdict"))
    return wide.withColumn("flips", ~F.col(a).eqNullSafe(F.col(b)))


def condition_confusion(verdicts: DataFrame, condition: Sequence[str]) -> DataFrame:
    """Per condition: positives saved and lost, controls rightly dropped and kept."""
    pos, out, conf = F.col("label") == 1, F.col("verdict") == K.DISMISSED, F.col("verdict") == K.CONFIRMED
    return verdicts.groupBy(*condition).agg(
        F.count_if(pos & conf).alias("positives_saved"),
        F.count_if(pos & out).alias("positives_lost"),
        F.count_if(~pos & out).alias("controls_dropped"),
        F.count_if(~pos & conf).alias("controls_kept"),
        F.count_if(~(conf | out) | F.col("verdict").isNull()).alias("without_verdict"),
    )


def inflation(procedures: DataFrame, name: str, clean: str, value: str) -> DataFrame:
    """A leaky procedure against the best clean one, absolute and relative."""
    best = procedures.filter(F.col(clean)).agg(
        F.struct(F.max(value).alias("v"), F.max_by(name, value).alias("n"))
    ).scalar()
    leaky = procedures.filter(~F.col(clean)).withColumn("_best", best)
    diff = F.col(value) - F.col("_best.v")
    return leaky.select(
        name,
        value,
        F.col("_best.n").alias("best_clean"),
        F.col("_best.v").alias("best_value"),
        diff.alias("inflation"),
        F.coalesce(F.try_divide(diff, F.col("_best.v")), F.lit(0.0)).alias("relative"),
    )
