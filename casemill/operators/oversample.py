"""Synthetic minority oversampling with nearest neighbours.

By default neighbours are found in hash buckets: several tables each cut the rows by the signs of
random projections, buckets that are still over-full are cut again at their own median, and rows meet
by exact distance inside their buckets.  A row so meets a bounded number of others, however many
there are, and misses few neighbours.  ``method="exact"`` lets all blocks of rows meet.  Of rows with
identical features only the first k + 1 take part; the others already know their neighbours among
these, so a vector shared by many rows stays cheap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions.hashing import hash32, uniform
from casemill.operators.ranks import before, order_statistics
from casemill.operators.splits import class_counts
from casemill.session import durable

#: Blocks of the exact method, and rows of a block that meet another one at once, which bounds a task's memory.
BLOCK_ROWS = 4096
CHUNK_ROWS = 256
#: Hash tables, and rows from which a bucket is cut again.  Recall beside the exact method, 10^5 rows of
#: 30 columns: 0.97 for independent columns of one variance, 0.99 where variances fall as those of
#: principal components do.
TABLES = 24
BUCKET_ROWS = 2048
_DEEPEST = 60
FAN_OUT = 10_000
_MET = "id bigint, nb bigint, d double"


def _best(mine: np.ndarray, ids: np.ndarray, theirs: np.ndarray, others: np.ndarray, k: int, by_place: bool = False) -> pd.DataFrame:
    """The k nearest of ``theirs`` for each of ``mine`` by (distance, id), the row itself left out.

    A row is told by its id, or by its place where both sides are the same rows.  Rows that are not
    finite are near to none.
    """
    left, right = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (mine, theirs))
    if not len(left) or not len(right):
        return pd.DataFrame({"id": [], "nb": [], "d": []})
    right = right[np.argsort(others[right], kind="stable")]
    one, two = (left, right) if by_place else (ids[left], others[right])
    mine, ids, theirs, others = mine[left], ids[left], theirs[right], others[right]
    middle = theirs.mean(axis=0)
    near, far = mine - middle, theirs - middle
    size, far_size = (near**2).sum(axis=1), (far**2).sum(axis=1)
    parts = []
    for a in range(0, len(ids), CHUNK_ROWS):
        here = slice(a, a + CHUNK_ROWS)
        rough = size[here, None] + far_size - 2 * near[here] @ far.T
        own = one[here, None] == two
        rough[own] = np.inf
        last = min(k, len(others)) - 1
        # One product ranks roughly; whatever may be among the k nearest is measured exactly.
        reach = np.partition(rough, last, axis=1)[:, last] + 1e-9 * (size[here] + far_size.max())
        row, col = np.nonzero((rough <= reach[:, None]) & ~own)
        # Differences are summed per column for full precision.
        d = np.zeros(len(row))
        for j in range(mine.shape[1]):
            d += (mine[row + a, j] - theirs[col, j]) ** 2
        d = np.sqrt(d)
        best = np.lexsort((col, d, row))
        start = np.searchsorted(row[best], np.arange(len(rough)))
        kept = best[np.arange(len(best)) - start[row[best]] < k]
        parts.append(pd.DataFrame({"id": ids[row[kept] + a], "nb": others[col[kept]], "d": d[kept]}))
    out = pd.concat(parts)
    return out[np.isfinite(out["d"])]


def _exact_meetings(first: DataFrame, k: int, seed: int, block_rows: int) -> DataFrame:
    """Every block against every block, k candidates per row and meeting."""
    blocks = max(ceil(first.count() / block_rows), 1)
    spots = first.withColumn("block", (hash32(seed, "block", F.col("id")) % blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = spots.select("id", "x", F.col("block").alias("a"), every.alias("b"), F.lit(0).alias("side"))
    right = spots.select("id", "x", every.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"id": [], "nb": [], "d": []})
        return _best(np.stack(mine["x"].to_numpy()), mine["id"].to_numpy(), np.stack(theirs["x"].to_numpy()), theirs["id"].to_numpy(), k)

    return left.unionByName(right).groupBy("a", "b").applyInPandas(meet, _MET)


def _direction(seed: int, table: int, depth: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, table, depth]).normal(size=width)


def hash_buckets(rows: DataFrame, width: int, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = K.SEED) -> DataFrame:
    """(table, bucket, id, x): every row once per table, in a bucket of at most ``bucket_rows`` rows.

    The first cuts are signs of projections around the mean of all rows, as many as even shares
    need.  Rows of over-full buckets are cut by one more projection a round, at the median of their
    bucket, until none is over-full; only these rows are touched again.  Rows of up to ``bucket_rows``
    in number need no cut and one table.
    """
    n, centre = rows.agg(F.count("*"), F.array(*[F.avg(F.col("x")[j]) for j in range(width)])).first()
    if n <= bucket_rows:
        return rows.select(F.lit(0).alias("table"), F.lit(1).cast("long").alias("bucket"), "id", "x")
    bits = ceil(log2(n / bucket_rows))
    middle = np.array(centre, float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The leading bit keeps buckets of different depths apart.
        weights = 1 << np.arange(bits)
        planes = np.stack([np.stack([_direction(seed, t, j, width) for j in range(bits)], axis=1) for t in range(tables)])
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy()) - middle
            codes = np.stack([(x @ p > 0) @ weights + (1 << bits) for p in planes], axis=1)
            yield pdf.assign(codes=list(codes))

    def project(depth: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes = np.stack([_direction(seed, t, depth, width) for t in range(tables)])
            for pdf in batches:
                if not pdf.empty:
                    x = np.stack(pdf["x"].to_numpy()) - middle
                    yield pdf.assign(p=(x * planes[pdf["table"].to_numpy()]).sum(axis=1))

        return run

    coded = durable(rows.select("id", "x").mapInPandas(assign, "id bigint, x array<double>, codes array<bigint>"))
    open_ = coded.select(F.posexplode("codes").alias("table", "bucket"), "id", "x")
    settled, key = [], ["table", "bucket"]
    for depth in range(bits, _DEEPEST):
        full = durable(open_.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_rows).drop("_n"))
        if full.isEmpty():
            break
        settled.append(open_.join(full, key, "left_anti"))
        cut = durable(open_.join(full, key, "left_semi").mapInPandas(project(depth), "table int, bucket bigint, id bigint, x array<double>, p double"))
        middles = cut.groupBy(*key).agg(F.percentile_approx("p", 0.5, 1000).alias("_middle"))
        side = (F.col("p") > F.col("_middle")).cast("long")
        open_ = cut.join(middles, key).select("table", (F.col("bucket") * 2 + side).alias("bucket"), "id", "x")
    return reduce(DataFrame.unionByName, settled, open_)


def _bucket_meetings(buckets: DataFrame, k: int) -> DataFrame:
    """All rows of a bucket by exact distance, k candidates per row and bucket."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["x"].to_numpy())
        return _best(x, ids, x, ids, k, by_place=True)

    return buckets.groupBy("table", "bucket").applyInPandas(meet, _MET)


def nearest_neighbours(
    rows: DataFrame, row_id: str, cols: Sequence[str], k: int = K.SMOTE_NEIGHBOURS, seed: int = K.SEED,
    method: str = "hashed", tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, neighbours): the k nearest other rows by (distance, id).

    ``hashed`` compares rows that share a bucket of ``hash_buckets``; up to ``bucket_rows`` rows share
    one, and the result is exact.  ``exact`` compares all rows, at a cost that grows with their square.
    """
    if method not in ("hashed", "exact"):
        raise ValueError(f"method {method!r} is neither 'hashed' nor 'exact'")
    base = rows.select(F.col(row_id).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    # The limit on the rank holds before the shuffle too, so a common vector sends k + 1 rows per task.
    same = Window.partitionBy("x").orderBy("id")
    first = durable(base.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r"))
    if method == "exact":
        met = _exact_meetings(first, k, seed, block_rows)
    else:
        met = _bucket_meetings(hash_buckets(first, len(cols), tables, bucket_rows, seed), k)
    # At most k candidates per row and table, or block.
    near = F.slice(F.array_sort(F.collect_set(F.struct("d", "nb"))), 1, k)
    found = met.groupBy("id").agg(F.transform(near, lambda t: t["nb"]).alias("neighbours"))
    # Further copies of a vector: their nearest rows are its first k copies.
    copies = first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > k)
    rest = (
        base.join(copies, "x")
        .filter(~F.array_contains("ids", F.col("id")))
        .select("id", F.slice("ids", 1, k).alias("neighbours"))
    )
    return found.unionByName(rest)


def oversample(
    df: DataFrame, label: str, row_id: str, cols: Sequence[str], k: int = K.SMOTE_NEIGHBOURS, seed: int = K.SEED, method: str = "hashed"
) -> DataFrame:
    """Synthetic minority rows that balance the classes: id, parent, replica, neighbour, lam, features.

    Replicas are spread evenly over the parents; neighbour and interpolation point are
    functions of (seed, parent, replica).
    """
    n = class_counts(df, label)
    minority = 1 if n.get(1, 0) <= n.get(0, 0) else 0
    n_min, missing = n.get(minority, 0), abs(n.get(0, 0) - n.get(1, 0))
    rows = df.filter(F.col(label) == minority).withColumn("_h", hash32(seed, "smote", F.col(row_id)))
    if missing and n_min < 2:
        raise ValueError(f"a minority of {n_min} rows has no neighbours to interpolate with")
    each, extra = divmod(missing, max(n_min, 1))
    copies = F.lit(each)
    if extra:
        cut = order_statistics(rows, ["_h", row_id], [(None, extra)])[0]
        copies = F.when(before(["_h", row_id], cut), each + 1).otherwise(each)
    top = df.agg(F.max(row_id)).first()[0] + 1
    if top + top * (each + 1) + each >= 1 << 63:
        raise ValueError(f"{row_id} is too large to number synthetic rows after it: use smaller ids")
    near = nearest_neighbours(rows, row_id, cols, k, seed, method)
    parents = rows.select(F.col(row_id).alias("parent"), copies.cast("long").alias("_copies"), *cols).join(
        near.withColumnRenamed("id", "parent"), "parent"
    ).filter(F.col("_copies") > 0)
    # Two levels, so that one parent with very many replicas is spread over tasks.
    chunks = parents.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / FAN_OUT))))
    chunks = chunks.repartition("parent", "_chunk")
    last = F.least(F.col("_copies"), (F.col("_chunk") + 1) * FAN_OUT) - 1
    made = chunks.withColumn("replica", F.explode(F.sequence(F.col("_chunk") * FAN_OUT, last)))
    pick = (hash32(seed, "nb", F.col("parent"), F.col("replica")) % F.size("neighbours")).cast("int")
    made = made.select(
        (F.lit(top) + F.col("parent") * (each + 1) + F.col("replica")).alias(row_id),
        "parent", "replica",
        F.get("neighbours", pick).alias("neighbour"),
        uniform(seed, "lam", F.col("parent"), F.col("replica")).alias("lam"),
        *cols,
    )
    other = rows.select(F.col(row_id).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    joined = made.join(other, "neighbour")
    return joined.select(
        row_id, "parent", "replica", "neighbour", "lam",
        *[(F.col(c) + F.col("lam") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols],
        F.lit(minority).alias(label),
    )


def leak_share(split: DataFrame, synthetic: DataFrame, row_id: str) -> DataFrame:
    """How many test rows have a parent in train when resampling came before the split.

    ``split`` holds all rows, synthetic ones included, with their side.
    """
    sides = split.select(F.col(row_id).alias("_id"), F.col("split").alias("_side"))
    made = synthetic.select(row_id, "parent", "neighbour").join(split.select(row_id, "split"), row_id)
    for role in ("parent", "neighbour"):
        made = made.join(
            sides.select(F.col("_id").alias(role), F.col("_side").alias(f"{role}_side")), role
        )
    test_total = split.filter(F.col("split") == "test").agg(F.count("*")).scalar()
    leaky = (F.col("parent_side") == "train") | (F.col("neighbour_side") == "train")
    return made.filter(F.col("split") == "test").agg(
        F.count("*").alias("n_synthetic_test"), F.count_if(leaky).alias("n_leaky")
    ).select(
        test_total.alias("n_test"), "n_synthetic_test", "n_leaky",
        (F.col("n_leaky") / F.greatest(test_total, F.lit(1))).alias("share"),
    )
