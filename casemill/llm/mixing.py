"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.hashing import uniform
from casemill.llm.tokens import free_name
from casemill.session import durable

#: Sources up to which their table is sent to all tasks; beyond, Spark joins by source and splits hot ones.
BROADCAST_SOURCES = 10_000
#: Classes of the size measure, and the words at which it is a half.
CLASSES = 64
SHORT = 100


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn.  ``share`` times the
    whole is dealt by weight; a target stops at ``most`` times its source and the excess is
    dealt again by weight, until none is above.  That fixed point is a water level: in order
    of ``most x size / weight``, sources are full up to the first at which what is left, dealt
    by weight over the remaining ones, fits.  The windows run over one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w.cast("double"))
    by_fill = Window.orderBy(F.col("source_size") * most / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("source_size") * most)
    first = F.min(F.when(F.col("_fits"), F.struct(F.col("source_size") * most / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_level").alias("l")))).over(everything)
    target = F.least(F.coalesce(first["l"] * F.col("_w"), F.lit(float("inf"))), (F.col("source_size") * most).cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def measure_class(size: Column) -> Column:
    """Class 1 to ``CLASSES`` of the measure ``size / (size + SHORT)``: short documents are drawn with lower odds."""
    return F.least(F.lit(CLASSES - 1), F.floor(F.lit(CLASSES) * size / (size + SHORT)).cast("int")) + 1


def class_copies(classes: DataFrame, most: int) -> DataFrame:
    """Add ``_level``: a document of class k is to be taken ``min(most, _level * k)`` times on average.

    ``classes`` has one row per (source, class) with the ``_words`` of the class and the ``target`` of
    the source.  The level is that of water: classes are full from the highest down to the first at
    which what is left, shared in proportion to class times words, does not fill it.  A source has
    ``CLASSES`` rows at most, which is what the windows see.
    """
    down = Window.partitionBy("source").orderBy(F.desc("_class"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    weighed = F.col("_words") * F.col("_class")
    left = F.col("target") - F.coalesce(F.sum("_words").over(before), F.lit(0)) * most
    open_ = F.sum(weighed).over(every) - F.coalesce(F.sum(weighed).over(before), F.lit(0))
    rows = classes.withColumn("_try", F.when(open_ > 0, left / open_).otherwise(0.0))
    fits = F.when(F.col("_try") * F.col("_class") <= most, F.struct((-F.col("_class")).alias("c"), F.col("_try").alias("l")))
    return rows.withColumn("_level", F.coalesce(F.min(fits).over(every)["l"], F.lit(float(most)))).drop("_try")


def _odds(u: Column, expected: Column) -> tuple[Column, Column]:
    """Random odds over inclusion odds of the part of ``expected`` beyond whole copies, and the range it
    falls into as a number in [0, 1]; rows with no such part come last."""
    part = expected - F.floor(expected)
    odds = F.when(part > 0, u / (1 - u) / (part / (1 - part)))
    return F.coalesce(odds, F.lit(float("inf"))), F.coalesce(odds / (1 + odds), F.lit(1.0))


def _key_columns(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """The columns that decide: size and class, the random number, what tells ties apart, and the row's place.

    The random number is a function of the id, or of the text where there is no id.  Rows that repeat
    an id are ordered by their text, rows that repeat both by their place in the table as it is stored.
    """
    mark = F.xxhash64(F.col(text))
    u = F.when(F.col(doc_id).isNull(), uniform(seed, F.lit("text"), mark)).otherwise(uniform(seed, F.col(doc_id)))
    size = word_count(F.col(text))
    return {
        "_id": F.col(doc_id), "source": F.col(source), "_n": size, "_class": measure_class(size), "_u": u, "_mark": mark,
        "_place": F.monotonically_increasing_id(),
    }


def mixing_cuts(
    docs: DataFrame, weights: Sequence[int], share: float, most: int = 2, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", seed: int = 17,
) -> DataFrame:
    """One row per source: its size and target, the level of its copies, and the cut in Pareto order up
    to which documents get one copy more.

    A document of class k (``measure_class``) is to be taken ``r = min(most, level * k)`` times; the
    level makes the sum over a source its target.  ``floor(r)`` copies are certain.  The rest of r is
    the inclusion probability of one copy more: documents are ranked by random odds divided by
    inclusion odds and taken in that order until their words reach the rest of the target, so the
    sample has a fixed size and unequal probabilities.

    Words are summed per source and range of ranks first, and inside the range in which the target is
    reached per rank; of rows of one rank, which are copies, as many are taken as fit.  No task sees
    more than the distinct ranks of one range.  ``docs`` must be a stored table, or give its rows in
    the same partitions each time it is read.  Null text: size 0.  Null source: a source of its own.
    """
    spark = docs.sparkSession
    ranges = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Narrow rows, written once; read for the classes, the sums and the cut.
    rows = durable(docs.select(*[c.alias(n) for n, c in _key_columns(doc_id, text, source, seed).items()]))
    classes = durable(rows.groupBy("source", "_class").agg(F.sum("_n").alias("_words")))
    sources = source_targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    c, t = classes.alias("c"), sources.alias("t")
    levels = class_copies(c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.source_size", "t.target"), most)
    whole = F.floor(F.least(F.lit(float(most)), F.col("_level") * F.col("_class")))
    plan = durable(
        levels.groupBy("source", "source_size", "target", "_level").agg(F.sum(whole * F.col("_words")).alias("_certain"))
        .withColumn("_rest", F.col("target") - F.col("_certain"))
    )
    d, p = rows.alias("d"), _small(plan.select("source", "_level", "_rest")).alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p._level", "p._rest")
    odds, at = _odds(F.col("_u"), F.least(F.lit(float(most)), F.col("_level") * F.col("_class")))
    ranked = joined.withColumn("_rank", odds).withColumn("_range", F.floor(at * ranges))
    sums = durable(ranked.groupBy("source", "_range").agg(F.sum("_n").alias("_n"), F.first("_rest").alias("_rest")))
    upto = Window.partitionBy("source").orderBy("_range")
    reached = sums.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n"))
    edge = reached.filter((F.col("_range") < ranges) & (F.col("_from") < F.col("_rest"))).groupBy("source").agg(F.max(F.struct("_range", "_from")).alias("e"))
    edges = durable(edge.select("source", F.col("e._range").alias("_edge"), F.col("e._from").alias("_from")))
    inside = ranked.alias("d").join(_small(edges).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d._range") == F.col("e._edge"))).select("d.*", "e._from")
    # One row per rank: copies of a text under one id have one rank and one size.
    key = F.struct("_rank", F.col("_id").isNull().alias("null"), "_id", "_mark").alias("_key")
    ties = inside.groupBy("source", key).agg(F.count("*").alias("_m"), F.first("_n").alias("_n"), F.first("_from").alias("_from"), F.first("_rest").alias("_rest"))
    order = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("_m") * F.col("_n")).over(order), F.lit(0)) + F.col("_from")
    # Of m copies those are taken whose middle word still fits: all where texts are empty.
    fit = F.when(F.col("_n") > 0, F.floor((F.col("_rest") - F.col("_earlier")) / F.col("_n") + 0.5)).otherwise(F.when(F.col("_earlier") <= F.col("_rest"), F.col("_m")).otherwise(0))
    counted = ties.withColumn("_earlier", earlier).withColumn("_j", F.least(F.col("_m"), F.greatest(fit, F.lit(0))))
    last = counted.filter("_j > 0").groupBy("source").agg(F.max(F.struct("_key", "_j", "_m")).alias("k"))
    last = durable(last.select("source", "k._key", "k._j", "k._m"))
    # A block that is cut is counted per partition of the table, then row by row in one of them.
    k = last.filter("_j < _m").alias("k")
    block = inside.withColumn("_key", key).alias("d").join(k, F.col("d.source").eqNullSafe(F.col("k.source")) & F.col("d._key").eqNullSafe(F.col("k._key")))
    block = block.select("d.source", "d._place", F.shiftright("d._place", 33).alias("_part"), "k._j")
    by_part = Window.partitionBy("source").orderBy("_part")
    parts = block.groupBy("source", "_part").agg(F.count("*").alias("_c"), F.first("_j").alias("_j"))
    parts = parts.withColumn("_upto", F.sum("_c").over(by_part)).withColumn("_left", F.col("_j") - F.col("_upto") + F.col("_c"))
    hit = parts.filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_c"))).select("source", "_part", "_left").alias("h")
    b = block.alias("b").join(hit, F.col("b.source").eqNullSafe(F.col("h.source")) & (F.col("b._part") == F.col("h._part"))).select("b.source", "b._place", "h._left")
    nth = b.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("_place"))).filter("_r = _left").select("source", "_place").alias("n")
    p, e, k = plan.alias("p"), edges.alias("e"), last.alias("k")
    same = lambda x: F.col("p.source").eqNullSafe(F.col(f"{x}.source"))
    found = p.join(e, same("e"), "left").join(k, same("k"), "left").join(nth, same("n"), "left")
    return durable(found.select(
        "p.source", "p.source_size", "p.target", F.col("p._level").alias("level"), F.lit(float(most)).alias("most"), F.coalesce("e._edge", F.lit(-1)).alias("cut_range"),
        F.col("k._key").alias("cut"), F.coalesce("n._place", F.lit((1 << 63) - 1)).alias("cut_place"), F.lit(ranges).alias("ranges"),
    ))


def _small(table: DataFrame) -> DataFrame:
    """A table of a row per source, broadcast if it has few: then the documents stay where they are."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def with_copies(docs: DataFrame, cuts: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """Add ``_size``, ``_source_size``, ``_target``, ``_copies`` and ``_taken`` (words) to every row,
    behind one more underscore where ``docs`` has such a column.

    The cuts have one row per source and must be those of the same table and ``seed``.  Null text: size 0.
    Null source: a source of its own, the last.  Null ids are told apart by their texts.  Of equal rows as
    many are taken as fit, the first ones.  An empty table gives no rows.
    """
    inner = _key_columns(doc_id, text, source, seed)
    own = {n: free_name(f"_in_{n}", docs.columns) for n in inner}
    keyed = docs.select("*", *[c.alias(own[n]) for n, c in inner.items()])
    at = {n: F.col(f"d.{name}") for n, name in own.items()}
    joined = keyed.alias("d").join(_small(cuts).alias("c"), at["source"].eqNullSafe(F.col("c.source")))
    expected = F.least(F.col("c.most"), F.col("c.level") * at["_class"])
    odds, place = _odds(at["_u"], expected)
    part = F.floor(place * F.col("c.ranges"))
    key = F.struct(odds.alias("_rank"), at["_id"].isNull().alias("null"), at["_id"].alias("_id"), at["_mark"].alias("_mark"))
    inside = (part == F.col("c.cut_range")) & F.coalesce((key < F.col("c.cut")) | (key.eqNullSafe(F.col("c.cut")) & (at["_place"] <= F.col("c.cut_place"))), F.lit(False))
    more = ((part < F.col("c.cut_range")) | inside).cast("long")
    copies = F.when(F.col("c.source_size") > 0, F.floor(expected) + more).otherwise(0)
    added = {"_size": at["_n"], "_source_size": F.col("c.source_size"), "_target": F.col("c.target"), "_copies": copies, "_taken": copies * at["_n"]}
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], *[c.alias(free_name(n, docs.columns)) for n, c in added.items()])
