"""Paired stratified bootstrap of an average-precision difference.

Every row gets a Poisson(1) weight per replicate, derived from its id, so both
detectors see the same resample and no row is copied.  Stratum totals are scaled
back to their observed sizes.

Rows are range-partitioned once on (detector, score, hash), the hash splits scores shared by
many rows over several tasks, and kept in that order.  A first pass sums the weights of every
partition: one vector over the replicates for the first score, the last score and all between.
Running sums of these few vectors give every partition its start.  A second pass walks the
scores between from there; scores at the border of a partition, which the next may share, are
read from the sums.  No row per (positive, replicate) leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.hashing import hash32
from casemill.session import durable

PRIME = 2_147_483_647
# Poisson(1) cumulative probabilities as integers below the prime.
STEPS = [int(sum(exp(-1) / factorial(i) for i in range(j + 1)) * PRIME) for j in range(11)]

CHUNK = 128  # replicates weighed at once
PIECE = 512  # rows weighed at once, so that their weights stay in a core's cache


def multipliers(b: int, seed: int = K.SEED) -> list[tuple[int, int]]:
    """One affine map of the row hash per replicate."""

    def draw(tag: str, r: int) -> int:
        return int(hashlib.md5(f"{seed}:{tag}:{r}".encode()).hexdigest()[:8], 16) % PRIME

    return [(max(draw("mul", r), 1), draw("add", r)) for r in range(b)]


def _leading() -> np.ndarray:
    """Weight of each stretch of 2^15 numbers below 2^32, remainders taken; -1 where it changes within."""
    ends = (np.arange(1 << 17) << 15)[:, None] + [0, (1 << 15) - 1]
    w = np.searchsorted(STEPS, ends % PRIME, side="right")
    return np.where((w[:, 0] == w[:, 1]) & (ends // PRIME == ends[:, :1] // PRIME).all(axis=1), w[:, 0], -1).astype(np.int8)


_LEADING = _leading()


def _weights(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    u = np.multiply(h[:, None], mul)
    u += add
    # The upper bits added to the lower ones keep the remainder by 2^31 - 1.
    high = np.right_shift(u, 31)
    u &= PRIME
    u += high
    w = _LEADING.take(np.right_shift(u, 15, out=high))
    near = np.flatnonzero(w.ravel() < 0)
    if len(near):
        w.ravel()[near] = np.searchsorted(STEPS, u.ravel()[near] % PRIME, side="right")
    return w.astype(np.float32)  # sums of a piece stay whole numbers below 2^24


def _long(df: DataFrame, scores: Mapping[str, str], label: str, row_id: str, seed: int) -> DataFrame:
    """One row per (row, detector): model, score, label, row hash."""
    each = F.array(
        *[F.struct(F.lit(name).alias("m"), F.col(c).cast("double").alias("s")) for name, c in scores.items()]
    )
    h = hash32(seed, F.col(row_id)) % F.lit(PRIME)
    return df.select(F.col(label).cast("int").alias("y"), h.alias("h"), each.alias("_e")).select(
        F.inline("_e"), "y", "h"
    )


class _Segment:
    """The scores of one detector in one partition, met in falling order, piece by piece.

    ``pos`` and ``neg`` hold the weights of the score being read, which the next piece may
    go on with; subclasses say what to do with a finished score and with those between.
    """

    def __init__(self, pairs: np.ndarray):
        self.pairs, self.score, self.first = pairs, None, True
        self.pos, self.neg = np.zeros((2, len(pairs)))

    def add(self, s: np.ndarray, y: np.ndarray, h: np.ndarray) -> None:
        if self.score is None:
            self.score = s[0]
        more = int(np.argmax(s != self.score)) if s[-1] != self.score else len(s)
        last = int(np.argmax(s == s[-1])) if more < len(s) else more
        for i in range(0, len(self.pairs), CHUNK):
            part = slice(i, i + CHUNK)
            w = _weights(h, self.pairs[part, 0], self.pairs[part, 1])
            self.pos[part] += y[:more] @ w[:more]
            self.neg[part] += (1 - y[:more]) @ w[:more]
            if more < len(s):
                self.finish(part)
                if last > more:
                    self.between(part, s[more:last], y[more:last], w[more:last])
                self.pos[part] = y[last:] @ w[last:]
                self.neg[part] = (1 - y[last:]) @ w[last:]
        if more < len(s):
            self.turn(s[more] if last > more else None)
            self.score, self.first = s[-1], False


class _Sums(_Segment):
    """Weights of the first score, the last one and all between: rows (score, border, pos, neg)."""

    def __init__(self, pairs: np.ndarray):
        super().__init__(pairs)
        self.inner, self.inner_score, self.rows = np.zeros((2, len(pairs))), None, []
        self.head = np.zeros((2, len(pairs)))

    def finish(self, part: slice) -> None:
        into = self.head if self.first else self.inner
        into[:, part] += (self.pos[part], self.neg[part])

    def between(self, part: slice, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.inner[:, part] += (y @ w, (1 - y) @ w)

    def turn(self, between: float | None) -> None:
        if self.first:
            self.rows.append((self.score, True, self.head))
        elif self.inner_score is None:
            self.inner_score = self.score
        if self.inner_score is None:
            self.inner_score = between

    def result(self) -> list[tuple]:
        inner = [] if self.inner_score is None else [(self.inner_score, False, self.inner)]
        return [*self.rows, *inner, (self.score, True, np.stack([self.pos, self.neg]))]


class _Precision(_Segment):
    """Share of the average precision that the scores between the first and the last one add."""

    def __init__(self, pairs: np.ndarray, start: np.ndarray, scale: np.ndarray, total: np.ndarray):
        super().__init__(pairs)
        self.run, self.scale, self.total, self.sum = start.copy(), scale, total, np.zeros(len(pairs))

    def _share(self, part: slice, pos: np.ndarray, run_pos: np.ndarray, run_neg: np.ndarray) -> np.ndarray:
        p, n = run_pos * self.scale[0, part], run_neg * self.scale[1, part]
        return np.where(pos > 0, pos / np.maximum(self.total[part], 1) * p / np.where(pos > 0, p + n, 1), 0)

    def finish(self, part: slice) -> None:
        self.run[:, part] += (self.pos[part], self.neg[part])
        if not self.first:
            self.sum[part] += self._share(part, self.pos[part], *self.run[:, part])

    def between(self, part: slice, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        if part.start == 0:
            self.steps = _Steps(s, y)
        pos, neg = self.steps.sums(w)
        run_pos, run_neg = self.run[0, part] + pos.cumsum(0), self.run[1, part] + neg.cumsum(0)
        self.sum[part] += self._share(part, pos, run_pos, run_neg).sum(0)
        self.run[:, part] = run_pos[-1], run_neg[-1]

    def turn(self, between: float | None) -> None:
        pass


class _Steps:
    """Sums of weights over the steps of a piece; labels other than 0 and 1 count as they are."""

    def __init__(self, s: np.ndarray, y: np.ndarray):
        self.y, self.starts = y, score_steps(s, y)
        self.plain = bool(((y == 0) | (y == 1)).all())
        # Few rows are positive; every step but the last has some.
        self.found = np.flatnonzero(y)
        at = np.searchsorted(self.found, self.starts)
        self.some = at[at < len(self.found)]
        step = np.searchsorted(self.starts, np.arange(len(y)), side="right") - 1
        few = len(self.starts) <= 64
        self.member = (step == np.arange(len(self.starts))[:, None]).astype(y.dtype) if few else None

    def sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = self.member @ w if self.member is not None else np.add.reduceat(w, self.starts, axis=0)
        if not self.plain:
            pos = np.add.reduceat(w * self.y[:, None], self.starts, axis=0)
            return pos, every - pos
        pos = np.zeros_like(every)
        if len(self.some):
            pos[: len(self.some)] = np.add.reduceat(w[self.found], self.some, axis=0)
        return pos, every - pos


def score_steps(score: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """First row of every step of whole scores in falling order; a step ends with a score that has a positive."""
    starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    closes = np.add.reduceat(positive, starts) > 0
    return starts[np.append(True, closes[:-1])]


def _pieces(r: slice) -> Iterator[slice]:
    for a in range(r.start, r.stop, PIECE):
        yield slice(a, min(a + PIECE, r.stop))


def _runs(*keys: np.ndarray) -> Iterator[slice]:
    """Stretches of rows with equal keys; none of an empty batch."""
    if not len(keys[0]):
        return
    new = np.any([np.append(True, k[1:] != k[:-1]) for k in keys], axis=0)
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(new)), strict=True):
        yield slice(a, b)


def _sums(pairs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, segment = None, None

        def out():
            rows = segment.result()
            return pd.DataFrame(
                {"p": at[0], "m": at[1], "s": [r[0] for r in rows], "border": [r[1] for r in rows],
                 "pos": [r[2][0] for r in rows], "neg": [r[2][1] for r in rows]}
            )

        for pdf in batches:
            p, m, s, y, h = (pdf[c].to_numpy() for c in ("p", "m", "s", "y", "h"))
            for r in _runs(p, m):
                if at != (p[r][0], m[r][0]):
                    if segment:
                        yield out()
                    at, segment = (p[r][0], m[r][0]), _Sums(pairs)
                for piece in _pieces(r):
                    segment.add(s[piece], y[piece].astype(np.float32), h[piece])
        if segment:
            yield out()

    return run


def _inner_precision(pairs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, segment = None, None

        def out():
            return pd.DataFrame({"m": [at[1]], "parts": [segment.sum]})

        for pdf in batches:
            p, m, s, y, h, start = (pdf[c].to_numpy() for c in ("p", "m", "s", "y", "h", "start"))
            for r in _runs(p, m):
                k = r.start
                if at != (p[k], m[k]):  # the start comes before the rows
                    if segment:
                        yield out()
                    of = np.stack(start[k]).astype(float)
                    at, segment, k = (p[k], m[k]), _Precision(pairs, of[:2], of[2:4], of[4]), k + 1
                for piece in _pieces(slice(k, r.stop)):
                    segment.add(s[piece], y[piece].astype(np.float32), h[piece].astype(np.int64))
        if segment:
            yield out()

    return run


def replicate_precision(
    df: DataFrame, scores: Mapping[str, str], label: str, row_id: str, b: int, seed: int = K.SEED
) -> DataFrame:
    """Average precision of every replicate of every detector: (m, rep, auc_pr).

    ``scores`` names the score column of each detector.  A replicate that draws no positive
    has no row.
    """
    pairs = np.array(multipliers(b, seed), dtype=np.int64)
    order = [F.asc("m"), F.desc("s"), F.asc("h")]
    # A stated number, one per core: a row is small but heavy, so partitions are not merged by
    # their bytes, and the sums per partition cost as much as some thousand rows.
    parts = df.sparkSession.sparkContext.defaultParallelism
    ordered = _long(df, scores, label, row_id, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Both passes must see the same partitions.
    rows = durable(ordered.withColumn("p", F.spark_partition_id()))
    sums = durable(rows.mapInPandas(_sums(pairs), "p int, m string, s double, border boolean, pos array<double>, neg array<double>"))
    each = sums.select("p", "m", "s", "border", F.posexplode(F.arrays_zip("pos", "neg")).alias("rep", "w")).select(
        "p", "m", "s", "border", "rep", "w.pos", "w.neg"
    )
    size = df.agg(
        F.struct(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) == 0).cast("double").alias("n"))
    ).scalar()
    whole = Window.partitionBy("m", "rep")

    def curve(table: DataFrame, *order_by) -> DataFrame:
        """Running sums before and with each row, and the factors that restore the stratum sizes."""
        so_far = whole.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return table.select(
            "*", F.sum("pos").over(so_far).alias("cp"), F.sum("neg").over(so_far).alias("cn"),
            F.sum("pos").over(whole).alias("tp"), F.sum("neg").over(whole).alias("tn"), size.alias("_size"),
        ).withColumns(
            {
                "fp": F.coalesce(F.try_divide(F.col("_size.p"), F.col("tp")), F.lit(0.0)),
                "fn": F.coalesce(F.try_divide(F.col("_size.n"), F.col("tn")), F.lit(0.0)),
            }
        )

    by_part = curve(each.groupBy("p", "m", "rep").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "p")
    listed = F.sort_array(F.collect_list(F.struct("rep", (F.col("cp") - F.col("pos")).alias("p0"), (F.col("cn") - F.col("neg")).alias("n0"), "fp", "fn", "tp")))
    starts = by_part.groupBy("p", "m").agg(listed.alias("l")).select(
        "p", "m", F.array(*[F.col(f"l.{c}") for c in ("p0", "n0", "fp", "fn", "tp")]).alias("start")
    )
    met = rows.unionByName(starts, allowMissingColumns=True).repartition(parts, "p").sortWithinPartitions(
        "p", "m", F.col("start").isNull(), F.desc("s"), "h"
    )
    inner = met.mapInPandas(_inner_precision(pairs), "m string, parts array<double>").select(
        "m", F.posexplode("parts").alias("rep", "part")
    )
    at_border = curve(each.groupBy("m", "rep", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("border").alias("border")), F.desc("s"))
    cp, cn = F.col("cp") * F.col("fp"), F.col("cn") * F.col("fn")
    border = at_border.filter(F.col("tp") > 0).select(
        "m", "rep", F.lit(True).alias("drawn"),
        F.when(F.col("border") & (F.col("pos") > 0), F.col("pos") / F.col("tp") * (cp / (cp + cn))).otherwise(0.0).alias("part"),
    )
    both = border.unionByName(inner, allowMissingColumns=True).groupBy("m", "rep").agg(F.sum("part").alias("auc_pr"), F.max("drawn").alias("drawn"))
    return both.filter("drawn").drop("drawn")


def paired_difference(
    df: DataFrame, score_a: str, score_b: str, label: str, row_id: str, b: int = 2000, seed: int = K.SEED
) -> DataFrame:
    """(rep, diff): average precision of ``score_b`` minus that of ``score_a``."""
    both = replicate_precision(df, {"a": score_a, "b": score_b}, label, row_id, b, seed)

    def of(name: str):
        return F.max(F.when(F.col("m") == name, F.col("auc_pr")))

    return both.groupBy("rep").agg((of("b") - of("a")).alias("diff"))


def summarise(diffs: DataFrame) -> DataFrame:
    """Mean, 95 % interval, share above zero, and whether the interval leaves zero out."""
    s = diffs.agg(
        F.count("*").alias("n_reps"),
        F.avg("diff").alias("mean_diff"),
        F.percentile("diff", 0.025).alias("low"),
        F.percentile("diff", 0.975).alias("high"),
        F.avg((F.col("diff") > 0).cast("double")).alias("p_better"),
    )
    return s.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))
