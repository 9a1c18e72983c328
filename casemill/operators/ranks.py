"""Global order without a global sort.

``order_statistics`` finds the key tuple at given ranks in three passes for up to some ten
billion rows: a mergeable quantile sketch says where a rank lies, an exact count over one
side of that range - a filter that reaches the files - places it, and the few rows left
are put in order.  ``prefix_sums`` gives running totals over a globally ordered key: rows
are bucketed by quantile bounds, summed inside each bucket, and shifted by the totals of
the earlier buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HISTOGRAM = 1024
#: Rows of one range that may be put in order in one task; larger ranges are cut again.
_TAKE = 100_000
_SKETCH_K = 4096
#: Rank error of a sketch of that size (99 %), times three.  A miss costs a pass, never the result.
_SKETCH_ERROR = 0.004


@dataclass
class _Spot:
    """One wanted rank: the rows it counts among, and the range it is known to lie in."""

    cond: Column
    rank: int | None | Callable[[int], int | None]
    found: list = field(default_factory=list)
    lo: object = None
    hi: object = None
    side: str = "both"  # which rows the next count must see: those up to hi, from lo on, or between
    n: int = 0
    below: int = 0
    count: float = float("inf")

    def rows(self, x: Column) -> Column:
        if self.lo is None:
            return self.cond & x.isNotNull()
        if self.side == "low":
            return self.cond & (x <= F.lit(self.hi))
        if self.side == "high":
            return self.cond & (x >= F.lit(self.lo))
        return self.cond & (x >= F.lit(self.lo)) & (x <= F.lit(self.hi))


def order_statistics(
    df: DataFrame, keys: Sequence[str], targets: Sequence[tuple[Column | None, int | Callable[[int], int | None]]], nulls: str = "skip"
) -> list[tuple | None]:
    """Key tuple at each 0-based rank.

    ``targets`` holds (row condition or None, rank); a rank may be a function of the number of
    rows that meet the condition, which the first pass counts anyway, and None if it returns
    None.  All targets are answered together.  Ties on one key are resolved by the next, so the last key should be unique.
    Rows without a key have no rank; ``nulls="error"`` refuses a missing first key.
    """
    every = F.lit(True)
    spots = [_Spot(every if c is None else c, r) for c, r in targets]
    for at in range(len(keys)):
        open_ = [s for s in spots if len(s.found) == at]
        if open_:
            _find(df, keys[at:], open_, nulls if at == 0 else "skip")
    return [None if s.rank is None else tuple(s.found) for s in spots]


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _find(df: DataFrame, keys: Sequence[str], spots: list[_Spot], nulls: str) -> None:
    """Settle the first of ``keys`` for all spots, or all of them where few rows are left."""
    _sketch(df, keys[0], spots, nulls)
    for s in spots:
        if s.rank is None:
            s.found = [None] * len(keys)
    spots = [s for s in spots if s.rank is not None]
    while spots:
        few = [s for s in spots if s.count <= _TAKE]
        if few:
            _take(df, keys, few)
        spots = [s for s in spots if s.count > _TAKE]
        if spots:
            _narrow(df, keys, spots)
        spots = [s for s in spots if s.lo != s.hi or s.side != "both"]


def _sketch(df: DataFrame, key: str, spots: list[_Spot], nulls: str) -> None:
    """One pass: how many rows each condition has, and between which values its ranks lie."""
    kind = "double" if isinstance(df.schema[key].dataType, T.FractionalType) else "bigint"
    x = F.col(key)
    build, read = getattr(F, f"kll_sketch_agg_{kind}"), getattr(F, f"kll_sketch_get_quantile_{kind}")
    conds: list[Column] = []
    for s in spots:
        if not any(s.cond is c for c in conds):
            conds.append(s.cond)
    seen = df.filter(_any(conds)).agg(
        *[
            c
            for i, cond in enumerate(conds)
            for c in (
                build(F.when(cond, x.cast(kind)), F.lit(_SKETCH_K)).alias(f"s{i}"), F.count(F.when(cond, x)).alias(f"n{i}"), F.count_if(cond & x.isNull()).alias(f"m{i}"),
            )
        ]
    ).first()
    asked: list[Column] = []
    for k, s in enumerate(spots):
        i = next(i for i, c in enumerate(conds) if c is s.cond)
        n, missing = seen[f"n{i}"], seen[f"m{i}"]
        if missing and nulls == "error":
            raise ValueError(f"{missing} of {n + missing} rows have no {key}: drop them or give them one first")
        s.rank = s.rank(n) if callable(s.rank) else int(s.rank)
        if s.rank is None:
            continue
        if not 0 <= s.rank < n:
            raise ValueError(f"rank {s.rank} is outside the data")
        s.n = s.count = n
        s.lo, s.hi, s.side, s.below = None, None, "both", 0
        if n > _TAKE:
            share = s.rank / n
            ends = [max(share - _SKETCH_ERROR, 0.0), min(share + _SKETCH_ERROR, 1.0)]
            asked.append(F.array(*[read(F.lit(bytes(seen[f"s{i}"])), F.lit(e)) for e in ends]).alias(f"q{k}"))
            s.side = "low" if share <= 0.5 else "high"
    if asked:
        told = df.sparkSession.range(1).select(*asked).first()
        for k, s in enumerate(spots):
            if s.rank is not None and s.n > _TAKE:
                s.lo, s.hi = told[f"q{k}"]
                s.count = float("inf")


def _bucket(x: Column, lo, hi, whole: bool) -> Column:
    """Number of the part of [lo, hi] that holds ``x``; the ends never share one."""
    if lo == hi:
        return F.lit(0)
    exact = whole and hi - lo < 1 << 52
    step = (hi - lo if exact else float(hi) - float(lo)) / _HISTOGRAM
    if step <= 0:
        return (x > F.lit(lo)).cast("int")
    away = (x - F.lit(lo)).cast("double") if exact else x.cast("double") - F.lit(float(lo))
    return F.least(F.floor(away / F.lit(float(step))), F.lit(_HISTOGRAM - 1)).cast("int")


def _narrow(df: DataFrame, keys: Sequence[str], spots: list[_Spot]) -> None:
    """One pass over the spots' sides: a histogram of each range, and the rows beside it."""
    key, rest = keys[0], keys[1:]
    x, whole = F.col(key), not isinstance(df.schema[key].dataType, T.FractionalType)
    parts = []
    for i, s in enumerate(spots):
        place = F.when(x < F.lit(s.lo), -1).when(x > F.lit(s.hi), _HISTOGRAM).otherwise(_bucket(x, s.lo, s.hi, whole))
        parts.append(F.when(s.rows(x), F.struct(F.lit(i).alias("t"), place.alias("b"))))
    rows = (
        df.filter(_any([s.rows(x) for s in spots]))
        .select(x.alias("x"), *[F.col(c).alias(f"k{j}") for j, c in enumerate(rest)], F.explode(F.array_compact(F.array(*parts))).alias("s"))
        .groupBy("s.t", "s.b")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), *[F.min(f"k{j}").alias(f"k{j}") for j in range(len(rest))])
        .collect()
    )
    for i, s in enumerate(spots):
        mine = sorted((r["b"], r) for r in rows if r["t"] == i)
        if s.side == "high":
            s.below = s.n - sum(r["n"] for _, r in mine)
        at, hit = s.below, None
        for b, r in mine:
            if at <= s.rank < at + r["n"] and 0 <= b < _HISTOGRAM:
                hit = r
                break
            at += r["n"]
        if hit is None:  # the sketch missed: everything between the outermost values
            ends = df.filter(s.cond).agg(F.min(x), F.max(x)).first()
            s.lo, s.hi, s.below, s.count, s.side = *ends, 0, float("inf"), "both"
            if s.lo != s.hi:
                continue
            s.found.append(s.lo)
        else:
            s.lo, s.hi, s.below, s.count, s.side = hit["lo"], hit["hi"], at, hit["n"], "both"
            if s.lo != s.hi:
                continue
            s.found.append(s.lo)
            if s.count == 1:  # that row has the other keys
                s.found.extend(hit[f"k{j}"] for j in range(len(rest)))
        s.cond, s.rank = s.cond & (x == F.lit(s.lo)), s.rank - s.below


def _take(df: DataFrame, keys: Sequence[str], spots: list[_Spot]) -> None:
    """Put the rows of ranges of at most ``_TAKE`` rows in order."""
    x = F.col(keys[0])
    marks = [F.when(s.rows(x), F.struct(F.lit(i).alias("t"), F.lit(s.rank - s.below + 1).alias("r"))) for i, s in enumerate(spots)]
    order = Window.partitionBy("t").orderBy(*[f"k{j}" for j in range(len(keys))])
    picked = (
        df.filter(_any([s.rows(x) for s in spots]))
        .select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keys)], F.explode(F.array_compact(F.array(*marks))).alias("s"))
        .select("s.*", *[f"k{j}" for j in range(len(keys))])
        .withColumn("_at", F.row_number().over(order))
        .filter(F.col("_at") == F.col("r"))
        .collect()
    )
    for r in picked:
        spots[r["t"]].found.extend(r[f"k{j}"] for j in range(len(keys)))


def before(keys: Sequence[str], cut: tuple) -> Column:
    """Rows whose key tuple is strictly smaller than ``cut``."""
    cond, equal = F.lit(False), F.lit(True)
    for key, v in zip(keys, cut):
        cond = cond | (equal & (F.col(key) < F.lit(v)))
        equal = equal & (F.col(key) == F.lit(v))
    return cond


def quantile_bounds(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Distinct inner bounds that split ``key`` into about ``buckets`` equal shares."""
    if buckets is None:
        shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(4 * shuffles, 16)
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(key).cast("double").alias(key)).approxQuantile(
        key, probs, 1.0 / (4 * buckets)
    )
    return sorted(set(found))


def with_bucket(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """Bucket number by binary search over ``bounds``."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    tmp = f"_{out}_x"
    splits = [float("-inf"), *bounds, float("inf")]
    binned = Bucketizer(splits=splits, inputCol=tmp, outputCol=out).transform(
        df.withColumn(tmp, F.col(key).cast("double"))
    )
    return binned.withColumn(out, F.col(out).cast("int")).drop(tmp)


def prefix_sums(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Add ``cum_<c>``, the inclusive running total of each column in key order.

    ``df`` must hold one row per (by, key); aggregate first.  The offsets table has
    one row per (by, bucket), so the only window without a bucket key is that small.
    """
    bounds = quantile_bounds(df, key) if bounds is None else bounds
    by = list(by)
    binned = with_bucket(df, key, bounds, "_bucket")
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = binned.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    shift = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(shift), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(key)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = binned.withColumns({f"_r_{c}": F.sum(c).over(inside) for c in sums})
    # Without groups the offsets are one row per bucket, a few thousand at most.
    joined = running.join(offsets if by else F.broadcast(offsets), [*by, "_bucket"])
    kept = [c for c in df.columns if c not in by]
    return joined.select(
        *by, *kept, *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums]
    )
