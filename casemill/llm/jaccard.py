"""Join of near-duplicate texts on the Jaccard similarity of their word shingles.

1. Each text becomes the set of its shingles.  Texts with one set are copies; the smallest id
   stands for them and knows how many they are.
2. The sets get MinHash signatures, cut into the labels of ``trees`` prefix tries.  Sets that
   share a label's prefix in any trie are candidates.  The prefix is shortened from the
   longest until a pair at the threshold is missed with less probability than allowed; so
   the trie nodes of that depth are what is grouped.
3. Candidates are joined to clusters, in star form, never as pairs.
4. Inside each cluster all pairs are verified exactly, block of sets against block of sets;
   a block returns one row per set: its links, and a representative of what it is linked to.
5. The representatives are joined to classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import packing, tokens
from casemill.session import durable

SHINGLE = 5
THRESHOLD = 0.8
TREES = 64
LONGEST = 12
MISSED = 1e-6
BLOCK = 512


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, missed: float = MISSED) -> int:
    """Longest prefix at which a pair at the threshold meets in some trie, but for ``missed``."""
    depth = longest
    while depth > 1 and (1 - threshold**depth) ** trees > missed:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def _labels(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of one set, a bounded block of shingles at a time."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, ((x[at : at + 1024, None] ^ b) * a).min(0), out=low)
    return low


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle fingerprints of each text; a text of fewer words is one shingle."""
    w = tokens.find_words(data, offsets, tokens.FOLDED)
    codes = tokens.window_codes(w.code, size)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= size:
            yield np.unique(codes[a : b - size + 1])
        elif b > a:
            yield tokens.window_codes(w.code[a:b], int(b - a), salt=int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _name(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    return (
        int((tokens.mix(s).sum() + np.uint64(len(s))).view(np.int64)),
        int(np.bitwise_xor.reduce(tokens.mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)),
    )


def _sign(size: int, trees: int, depth: int):
    a, b = _seeds(trees * depth)
    tree = tokens.mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text", 2 << 20):
            keys, more, codes = [], [], []
            for s in _sets(*tokens.text_buffers(batch.column("text")), size):
                if not len(s):
                    keys.append(None)
                    more.append(None)
                    codes.append(None)
                    continue
                first, second = _name(s)
                keys.append(first)
                more.append(second)
                labels = _labels(s, a, b).reshape(trees, depth).astype(np.uint64)
                code = tree.copy()
                for j in range(depth):
                    code = tokens.mix(code ^ labels[:, j])
                codes.append(code.view(np.int64))
            yield pa.record_batch(
                [batch.column("id"), pa.array(keys, pa.int64()), pa.array(more, pa.int64()), pa.array(codes, pa.list_(pa.int64()))],
                names=["id", "key", "more", "codes"],
            )

    return run


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            sets = list(_sets(*tokens.text_buffers(batch.column("text")), size))
            # An id may be repeated with other texts: only the set that was asked for goes on.
            asked = batch.column("node").to_pylist()
            same = pa.array([len(s) > 0 and _name(s)[0] == k for s, k in zip(sets, asked)], pa.bool_())
            rest = [n for n in batch.schema.names if n != "text"]
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*rest, "shingles"])
            yield out.filter(same)

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, a slab of shared shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hit, col = packing.find(shared, value)
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (lr, lc), (rr, rc) = places(left), places(right)
    for at in range(0, len(shared), slab):
        a, b = np.zeros((len(left), slab), np.float32), np.zeros((len(right), slab), np.float32)
        i, j = np.searchsorted(lc, [at, at + slab])
        a[lr[i:j], lc[i:j] - at] = 1
        i, j = np.searchsorted(rc, [at, at + slab])
        b[rr[i:j], rc[i:j] - at] = 1
        out += a @ b.T
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row it is joined with."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    def linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        both = _overlaps(x, y).astype(np.float64)
        a, b = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        return both >= threshold * (a[:, None] + b[None, :] - both) - 1e-9

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("cluster", "i", "j", "block", "node", "copies")}
        order = np.lexsort((columns["node"], columns["block"], columns["j"], columns["i"], columns["cluster"]))
        columns = {c: v[order] for c, v in columns.items()}
        new = np.ones(len(order), bool)  # a document in several equal rows comes several times
        new[1:] = np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in ("cluster", "i", "j", "node")])
        order, columns = order[new], {c: v[new] for c, v in columns.items()}
        packed = table.column("shingles")
        key = np.stack([columns["cluster"], columns["i"], columns["j"]], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(order)]
        node, links, root = [], [], []
        for at, to in zip(cuts, cuts[1:]):
            if at == to:
                continue
            sets = [np.frombuffer(packed[int(k)].as_buffer(), np.uint64) for k in order[at:to]]
            ids, copies = columns["node"][at:to], columns["copies"][at:to]
            if columns["i"][at] == columns["j"][at]:
                hit = linked(sets, sets)
                np.fill_diagonal(hit, False)
            else:
                n = int((columns["block"][at:to] == columns["i"][at]).sum())
                hit = np.zeros((len(sets), len(sets)), bool)
                if 0 < n < len(sets):
                    hit[:n, n:] = linked(sets[:n], sets[n:])
                    hit[n:, :n] = hit[:n, n:].T
            by = np.argsort(ids)
            label = np.empty(len(ids), np.int64)
            label[by] = ids[by][_components(hit[np.ix_(by, by)])]
            node.append(ids)
            links.append(hit @ copies)
            root.append(label)
        none = [np.zeros(0, np.int64)]
        return pa.table({"node": np.concatenate(node or none), "links": np.concatenate(links or none).astype(np.int64), "root": np.concatenate(root or none)})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) is connected with.

    Labels go to neighbours as partially aggregated minima, then each label takes the label of
    its own node, which halves long chains; until nothing changes.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = durable(step.join(jump, "low").select("node", "label", F.least("low", "far").alias("new")))
        moved = step.filter("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not moved:
            return labels


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
    trees: int = TREES, longest: int = LONGEST, missed: float = MISSED, block: int = BLOCK,
) -> DataFrame:
    """(id, class_id, n_links) for each row.

    Words are runs of letters and digits, A-Z lower-cased; a shingle is ``size`` words, or all
    words of a shorter text.  Two rows are linked if the Jaccard similarity of their sets is
    ``threshold`` or more; ``n_links`` counts the linked rows, copies included, and the class
    of a row is the smallest id among all that links lead to.

    Rows without words (null and empty texts too) have no links and are classes of their own.
    A null id gives a null class and no links.  Rows that repeat an id and text are copies.
    An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = forest_depth(threshold, trees, longest, missed)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = durable(source.mapInArrow(_sign(size, trees, depth), "id long, key long, more long, codes array<long>"))
    classes = durable(
        signed.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key", "more").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    chosen = classes.select(F.col("key").alias("node"), F.col("rep").alias("id"), "copies")
    labels = signed.select("id", F.col("key").alias("node"), "codes").join(chosen, ["id", "node"]).select("node", F.explode("codes").alias("code"))
    centres = labels.groupBy("code").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre <> last").drop("last")
    # A node meets at most ``trees`` centres.  It keeps the smallest, its hub; that its other
    # centres belong together is said of the hub, once for all nodes that say the same.
    met = labels.join(centres, "code").groupBy("node").agg(F.collect_set("centre").alias("all")).withColumn("hub", F.array_min("all"))
    stars = met.select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(
        met.select(F.col("hub").alias("a"), F.explode("all").alias("b")).distinct()
    ).filter("a <> b")
    clusters = connected(stars).withColumnRenamed("label", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").join(chosen, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = placed.join(source, "id").select("node", "cluster", "copies", "blocks", "block", "text").mapInArrow(
        _shingle_rows(size), "node long, cluster long, copies long, blocks int, block int, shingles binary"
    )
    sets = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "copies", "shingles"
    )
    tasks = sets.withColumn("task", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(8 * shuffles)).cast("int"))
    verified = durable(tasks.groupBy("task").applyInArrow(_verify(threshold), "node long, links long, root long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected(verified.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_set = classes.withColumnRenamed("key", "node").join(links, "node", "left").join(groups, "node", "left").withColumn(
        "group", F.coalesce("label", "node")
    )
    least = per_set.groupBy("group").agg(F.min("rep").alias("class_id"))
    per_set = per_set.join(least, "group").select(
        F.col("node").alias("key"), "more", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    own = signed.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"), "more")
    return own.join(per_set, ["key", "more"], "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
