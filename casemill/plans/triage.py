"""The API a review team uses: DataFrames in, DataFrames out.

``Triage`` holds one scored batch.  The case file is selected once and passed on,
never recomputed, so numbering, dossiers, audits and measurements refer to the same
cases.
"""

from __future__ import annotations

from dataclasses import dataclass
import warnings
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators import audit, dossiers, runs, selection, splits, summaries, system
from casemill.sources.files import read_metric_documents

RUN = ["run_id"]


@dataclass
class Triage:
    """A scored batch with columns tx_id, prob, tier, amount, hour, label and optional contributions."""

    scored: DataFrame
    capacity: int = K.CASES_MAX
    threshold: float | None = None
    minimum: int = K.CASES_MIN
    level: str = "completo"
    fallback: str = "capacity"

    def __post_init__(self):
        if self.level not in K.LEVELS:
            raise ValueError(f"level must be one of {K.LEVELS}")

    @cached_property
    def _batch(self) -> DataFrame:
        return self.scored.withColumn("run_id", F.lit(0))

    @cached_property
    def cases(self) -> DataFrame:
        """The case file; at most ``max(capacity, minimum)`` rows, so keeping it is cheap."""
        return selection.select_cases(
            self._batch, "prob", "tx_id", self.capacity, self.threshold, self.minimum, self.fallback
        ).cache()

    # The four tools of the review desk.

    def statistics(self) -> DataFrame:
        return summaries.batch_statistics(self.scored, self.level)

    def prioritise(self, n: int = 10, max_size: int = 50) -> DataFrame:
        """The first ``n`` cases; the desk shows ``max_size`` of them at most and warns if that cuts."""
        if int(n) > max_size:
            warnings.warn(f"the list was cut from {n} to {max_size} rows", stacklevel=2)
        return selection.priority_list(self.scored, "prob", "tx_id", min(int(n), max_size), self.level)

    def close(self) -> None:
        """Free the kept case file."""
        if "cases" in self.__dict__:
            self.cases.unpersist()

    def __enter__(self) -> Triage:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def explain(self, case_no) -> str:
        """Narrative of one case with its place against the batch mean, or an error text."""
        try:
            no = int(case_no)
        except (TypeError, ValueError):
            return f"ERROR: '{case_no}' no es un identificador valido."
        mean = self.scored.agg(F.avg("amount")).scalar()
        side = F.when(F.col("amount") > mean, "por encima").otherwise("por debajo")
        row = self.cases.filter(F.col("case_no") == no).select(
            F.concat(dossiers.narrative(self.level), F.lit("\n  Respecto a la media del lote: "), side).alias("text")
        ).first()
        if row is None:
            return f"ERROR: no existe el caso {no}. Los casos van del 1 al {self.cases.count()}."
        return row["text"]

    def detector_performance(self, pattern: str) -> DataFrame:
        return read_metric_documents(self.scored.sparkSession, pattern)

    # Views of the shift.

    def summary(self) -> DataFrame:
        return summaries.batch_summary(self.scored)

    def measurement(self, verdicts: DataFrame | None = None, mode: str = K.MODE_INTERPRET) -> DataFrame:
        given = None if verdicts is None else verdicts.withColumn("run_id", F.lit(0))
        return system.measure_system(self._batch, self.cases, given, RUN, mode).drop("run_id")

    def case_detail(self, case_no: int, level: str | None = None) -> DataFrame:
        mean = self.scored.agg(F.avg("amount")).scalar()
        text = dossiers.case_dossier(mean, level or self.level)
        return self.cases.filter(F.col("case_no") == case_no).select("case_no", "tx_id", "label", text.alias("dossier"))

    def dossier(self) -> DataFrame:
        means = self._batch.groupBy("run_id").agg(F.avg("amount").alias("mean_amount"))
        return dossiers.batch_dossier(self.cases, means, RUN, self.level).drop("run_id")

    def case_table(self, verdicts: DataFrame) -> DataFrame:
        return dossiers.case_table(self.cases, verdicts.withColumn("run_id", F.lit(0)), RUN).drop("run_id")

    def evaluate_report(self, report: DataFrame, mode: str = K.MODE_REVIEW) -> DataFrame:
        """Audit, verdicts and measurement of report texts (column ``text``), in one row each."""
        # A case file is bounded by the capacity, so its numbers fit an array.
        ids = self.cases.agg(F.sort_array(F.collect_list(F.col("case_no").cast("bigint")))).scalar()
        texts = report.select("text").withColumns({"run_id": F.lit(0), "case_ids": ids})
        audited = audit.audit_reports(texts, "text", "case_ids", "case_ids")
        verdicts = system.extract_verdicts(texts, RUN, "text")
        known = verdicts.join(self.cases.select("run_id", "case_no"), ["run_id", "case_no"])
        measured = system.measure_system(self._batch, self.cases, verdicts, RUN, mode)
        n_known = known.groupBy("run_id").agg(F.count("*").alias("_known"))
        out = audited.join(measured, "run_id").join(n_known, "run_id", "left").na.fill(0, ["_known"])
        return out.withColumn("n_without_verdict", F.col("n_cases") - F.col("_known")).drop("_known", "run_id")


def triage_shift(
    scored: DataFrame,
    time: str = "t_sec",
    hours: float = 4.0,
    offset_h: float = 0.0,
    threshold: float | None = None,
    capacity: int = K.CASES_MAX,
    within: Callable[[tuple[float, float]], DataFrame] | None = None,
    **options,
) -> Triage:
    """Triage of one shift of the test period; an empty shift is an error.

    ``within`` gives the rows of a range of seconds, for a source that can read just these;
    without it the shift is filtered from ``scored``.
    """
    start = splits.time_cut(scored, time, "tx_id")[0]
    near = within((start + offset_h * 3600, start + (offset_h + hours) * 3600)) if within else scored
    rows = splits.require_rows(splits.shift(near, time, start, hours, offset_h), "shift")
    return Triage(rows, capacity, threshold, **options)


experiment_grid = runs.experiment_grid
