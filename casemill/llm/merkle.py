"""A Merkle manifest of a dataset: one leaf per row, a tree per group, a tree of groups, a proof per leaf.

Leaves are appended in order to trees that know only their open runs.  A run of ``fanout`` siblings
completes the moment its last one is appended: its hash is appended a level up, and the witness of every
leaf below is extended by the siblings it was missing.  Trees are cut into aligned blocks of
``fanout ** block_levels`` leaves that tasks build side by side; block roots are appends to the next tier in
the same way, and the roots of groups to the last tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm import tokens
from casemill.session import durable

FANOUT = 3
BLOCK_LEVELS = 8
_EMIT = 8192
_NO_GROUP = "*"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field_text(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, a colon and the value, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root a leaf leads to with the siblings of a proof."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, each level from left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


class Tree:
    """An append-only tree of a given height.

    ``open[level]`` holds the complete subtrees that wait for siblings: digest and the leaves below.
    ``left[i]`` and ``right[i]`` are the witness of leaf i so far, one text of siblings per level.
    """

    def __init__(self, fanout: int, height: int, witnesses: bool = True):
        self.fanout, self.height, self.witnesses = fanout, height, witnesses
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(height + 1)]
        self.left: list[list[str]] = []
        self.right: list[list[str]] = []
        self.size = 0

    def append(self, node: str) -> None:
        if self.witnesses:
            self.left.append([])
            self.right.append([])
        self._add(0, node, [self.size] if self.witnesses else [])
        self.size += 1

    def _add(self, level: int, node: str, below: list[int]) -> None:
        self.open[level].append((node, below))
        if level < self.height and len(self.open[level]) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for i, (_, below) in enumerate(run):
            before, after = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for leaf in below:
                self.left[leaf].append(before)
                self.right[leaf].append(after)
        self._add(level + 1, digest("".join(nodes)), [leaf for _, below in run for leaf in below])

    def close(self) -> str:
        """Complete the last, shorter runs and return the root."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each group within a sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch.column("g").dictionary_encode()
        code = group.indices.to_numpy()
        first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
        local = np.arange(n) - np.repeat(first, np.diff([*first, n]))
        names = group.dictionary.to_pylist()
        if names[code[0]] == last:
            end = first[1] if len(first) > 1 else n
            local[:end] += seen
        last, seen = names[code[-1]], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"]
        )


def _numbered(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(..., pos, n): the place of each row in its group and the group's size; and (g, n) by itself.

    Rows are range-partitioned on group and order, so a large group is spread over many tasks; equal
    rows are spread by their place in the input, which they may swap without any effect.  The sorted
    table is written, so the partitions that the offsets refer to are settled.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = nodes.withColumn("_salt", F.monotonically_increasing_id())
    by = [*[F.col(c).asc_nulls_first() for c in order], F.col("node"), F.col("_salt")]
    ordered = salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt")
    rows = durable(ordered.mapInArrow(_number, tokens.schema_of(ordered, [], "part int, local long")))
    sizes = rows.groupBy("g", "part").agg(F.count("*").alias("_n"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("g", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(group).alias("n"))
    placed = rows.join(offsets, ["g", "part"]).withColumn("pos", F.col("_from") + F.col("local")).drop("_from", "part", "local")
    return placed, sizes.groupBy("g").agg(F.sum("_n").alias("n"))


def _height(n: Column, fanout: int) -> Column:
    """Levels until one node remains: how many powers of ``fanout``, from 1, are smaller than ``n``."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda x: x < n))


def _grow(fanout: int, witnesses: bool):
    """Append sorted rows to the tree of their (g, block); emit a block's rows once it is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = None, None
        held: list[pa.RecordBatch] = []
        left, right, roots = [], [], []

        def close():
            root = tree.close()
            if witnesses:
                left.extend(tree.left)
                right.extend(tree.right)
                roots.extend([root] * tree.size)
            else:
                roots.append((*key, root))

        def emit():
            nonlocal held
            n = len(roots)
            if not witnesses:
                out = pa.record_batch([pa.array([r[k] for r in roots], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["g", "pos", "node"])
            else:
                table = pa.Table.from_batches(held)
                ready = table.slice(0, n).combine_chunks()
                held = table.slice(n).to_batches()
                lists = pa.list_(pa.string())
                out = ready.append_column("left", pa.array(left, lists)).append_column("right", pa.array(right, lists)).append_column("tier_root", pa.array(roots, pa.string()))
                out = out.to_batches()[0]
            for x in (left, right, roots):
                x.clear()
            return out

        for batch in batches:
            if witnesses:
                held.append(batch)
            for g, block, node, height in zip(*[batch.column(c).to_pylist() for c in ("g", "block", "node", "height")]):
                if (g, block) != key:
                    if tree is not None:
                        close()
                    tree, key = Tree(fanout, height, witnesses), (g, block)
                tree.append(node)
            if len(roots) >= _EMIT:
                yield emit()
        if tree is not None:
            close()
        if roots:
            yield emit()

    return run


def _blocks(nodes: DataFrame, fanout: int, levels: int, witnesses: bool) -> DataFrame:
    """The subtrees of one tier; ``nodes`` has (g, pos, node, left_over) and more."""
    cut = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fanout**levels)).cast("long")).withColumn("height", F.least(F.col("left_over"), F.lit(levels)))
    dealt = cut.repartition("g", "block").sortWithinPartitions("g", "pos")
    schema = tokens.schema_of(dealt, [], "left array<string>, right array<string>, tier_root string") if witnesses else "g string, pos long, node string"
    return dealt.mapInArrow(_grow(fanout, witnesses), schema)


def _witnessed(nodes: DataFrame, order: Sequence[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The numbered nodes with their witness inside their block, and per block (g, block, up_left, up_right,
    group_root): the rest of the way to the root of the group.

    Each tier has ``fanout ** levels`` times fewer nodes than the one below; the tiers above the lowest
    are written.  The lowest is built twice, once for its block roots and once, when asked for, with
    witnesses: hashing again is cheaper than storing a witness for every leaf.
    """
    placed, counts = _numbered(nodes, order)
    base = placed.withColumn("left_over", _height(F.col("n"), fanout))
    heights = counts.select("g", _height(F.col("n"), fanout).alias("left_over"))
    most = heights.agg(F.max("left_over")).first()[0] or 0
    tiers, at, done = [], base.select("g", "pos", "node", "left_over"), levels
    roots = durable(_blocks(at, fanout, levels, False))
    while done < most:
        at = roots.join(heights, "g").withColumn("left_over", F.greatest(F.col("left_over") - done, F.lit(0)))
        tier = durable(_blocks(at, fanout, levels, True).select("g", "pos", "block", "left", "right", "tier_root"))
        tiers.append(tier)
        roots = tier.groupBy("g", F.col("block").alias("pos")).agg(F.first("tier_root").alias("node"))
        done += levels
    none = F.array().cast("array<string>")
    up = roots.select("g", F.col("pos").alias("block"), none.alias("up_left"), none.alias("up_right"), F.col("node").alias("group_root"))
    for tier in reversed(tiers):
        up = tier.join(up, ["g", "block"]).select(
            "g", F.col("pos").alias("block"), F.concat("left", "up_left").alias("up_left"), F.concat("right", "up_right").alias("up_right"), "group_root"
        )
    return _blocks(base, fanout, levels, True), up


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
    fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, carry: Sequence[str] = (),
) -> DataFrame:
    """(group_key, order_key, leaf, subroot, root, left, right) for each row, with the columns ``carry``
    (a result whose name they hold gets an underscore in front).

    ``leaf`` is the digest of the ``fields``.  Per group, leaves stand in order of ``order``; while several
    nodes remain, every ``fanout`` consecutive ones, the last fewer, become the hash of their joined hex
    texts.  What remains is ``subroot``; the subroots, in order of ``group``, lead to ``root`` alike.
    Groups are compared as text.  ``left`` and ``right`` hold, level by level from leaf to root, the siblings on either side, so that
    ``fold(leaf, left, right)`` is the root.

    Null and empty values have different leaves.  A null group is a group of its own, the first; rows
    with a null or repeated order key stand first, or together, in order of their leaves, so equal rows
    are interchangeable.  An empty table gives no rows.  Other columns are not looked at.
    """
    leaves = tokens.carried(
        docs, carry, g=field_text(F.col(group)), group_key=F.col(group), order_key=F.col(order), node=leaf_digest(*[F.col(c) for c in fields])
    )
    rows, up = _witnessed(leaves, ["group_key", "order_key"], fanout, block_levels)
    up = durable(up)
    # Block 0 of each group names its subroot; the group's key is read back from its text.
    name = F.when(F.col("g") == "-", F.lit(None)).otherwise(F.expr("substring(g, instr(g, ':') + 1)"))
    tops = up.filter("block = 0").select(F.lit(_NO_GROUP).alias("g"), F.col("g").alias("of"), name.alias("name"), F.col("group_root").alias("node"))
    last, over = _witnessed(tops, ["name"], fanout, block_levels)
    over = over.withColumnRenamed("group_root", "root")
    crown = last.join(over, ["g", "block"]).select(
        F.col("of").alias("g"), F.concat("left", "up_left").alias("top_left"), F.concat("right", "up_right").alias("top_right"), "root"
    )
    rest = durable(
        up.join(crown, "g").select(
            "g", "block", F.col("group_root").alias("subroot"), "root",
            F.concat("up_left", "top_left").alias("up_left"), F.concat("up_right", "top_right").alias("up_right"),
        )
    )
    kept = [F.col(f"_k{i}") for i in range(len(carry))]
    out = rows.join(rest, ["g", "block"]).select(
        "group_key", "order_key", F.col("node").alias("leaf"), "subroot", "root",
        F.concat("left", "up_left").alias("left"), F.concat("right", "up_right").alias("right"), *kept,
    )
    return tokens.restored(out, carry)
