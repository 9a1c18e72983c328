"""Benchmark passages inside training texts.

The windows of all benchmark items form a hash set.  Up to ``BROADCAST_WINDOWS`` of them, a
bound checked before anything is collected, the set is broadcast and every text is scanned
in one pass without a shuffle.  A larger set is met by buckets: groups of documents send the
fingerprints of their windows, once each, to the bucket that holds the benchmark windows of
the same codes, which answers with those it holds.  A hit counts only if its words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import packing, tokens

BROADCAST_WINDOWS = 1_000_000
_GRAM = "code long, width int, words binary, items array<long>"
_FOUND = "n_words long, n_hit long, items array<long>, starts array<long>, ends array<long>"


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)


def _codes(w: tokens.Words, width: int) -> np.ndarray:
    return tokens.window_codes(w.code, width, salt=width)


def _spell(data: np.ndarray, w: tokens.Words, at: int, width: int) -> bytes:
    """The words of a window, joined by one space; ``data`` is lower-cased."""
    return b" ".join(data[s:e].tobytes() for s, e in zip(w.start[at : at + width], w.end[at : at + width]))


def _gram_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            data, offsets = tokens.text_buffers(batch.column("text"))
            w, low = tokens.find_words(data, offsets, tokens.FOLDED), _lower(data)
            rows = []
            for row, item in enumerate(batch.column("item").to_pylist()):
                a, b = w.first[row], w.first[row + 1]
                size = int(min(width, b - a))
                if size:
                    one = _codes(tokens.Words(w.code[a:b], None, None, None), size)
                    rows += [(int(c), size, _spell(low, w, a + i, size), item) for i, c in enumerate(one.view(np.int64))]
            if rows:
                yield pa.record_batch(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                    names=["code", "width", "words", "item"],
                )

    return run


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """(code, width, words, items): the distinct windows of all items, with the items that hold them."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(
        _gram_rows(width), "code long, width int, words binary, item long"
    )
    return rows.groupBy("code", "width", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Grams:
    """Benchmark windows sorted by fingerprint."""

    def __init__(self, code, width, words, items):
        code = np.asarray(code, np.int64).view(np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.width = np.asarray(width, np.int64)[order]
        self.words = [words[i] for i in order]
        self.items = [items[i] for i in order]
        self.widths = [int(x) for x in np.unique(self.width)]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.code >> np.uint64(44)).astype(np.int64)] = True


def _scan(batch: pa.RecordBatch, grams: _Grams) -> pa.RecordBatch:
    data, offsets = tokens.text_buffers(batch.column("text"))
    w = tokens.find_words(data, offsets, tokens.FOLDED)
    low, n = None, len(w.code)
    hit = np.zeros(n, bool)
    items: dict[int, set[int]] = {}
    text_of = w.doc
    for width in grams.widths:
        at = tokens.inside(w.first, width)
        if not len(at):
            continue
        codes = _codes(w, width)[at]
        near = np.flatnonzero(grams.maybe[(codes >> np.uint64(44)).astype(np.int64)])
        found, place = packing.find(grams.code, codes[near])
        marks = []
        for i, k in zip(at[near[found]].tolist(), place[found].tolist()):
            low = _lower(data) if low is None else low
            words, code = _spell(low, w, i, width), grams.code[k]
            while k < len(grams.code) and grams.code[k] == code:
                if grams.width[k] == width and grams.words[k] == words:
                    marks.append(i)
                    items.setdefault(int(text_of[i]), set()).update(grams.items[k])
                k += 1
        hit |= tokens.spread_marks(np.array(marks, np.int64), width, n)
    total = np.concatenate([[0], np.cumsum(hit)])
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | np.isin(np.arange(1, n), w.first)
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | np.isin(np.arange(1, n), w.first)
    starts, ends = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    lists = np.searchsorted(starts, w.first).astype(np.int32)
    base = np.repeat(w.first[:-1], np.diff(lists))
    rest = [n for n in batch.schema.names if n not in ("text", "g")]
    return pa.record_batch(
        [
            *[batch.column(n) for n in rest],
            pa.array(np.diff(w.first), pa.int64()),
            pa.array(np.diff(total[w.first]), pa.int64()),
            pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.int64())),
            pa.ListArray.from_arrays(pa.array(lists), pa.array(starts - base, pa.int64())),
            pa.ListArray.from_arrays(pa.array(lists), pa.array(ends - base, pa.int64())),
        ],
        names=[*rest, "n_words", "n_hit", "items", "starts", "ends"],
    )


def _scan_all(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(*shared.value)
        for batch in tokens.pieces(batches, "text"):
            yield _scan(batch, grams)

    return run


def _send(widths: list[int], buckets: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.zeros(0, np.uint64)]
        for batch in tokens.pieces(table.to_batches(), "text"):
            w = tokens.find_words(*tokens.text_buffers(batch.column("text")), tokens.FOLDED)
            parts += [np.unique(_codes(w, width)[tokens.inside(w.first, width)]) for width in widths if len(w.code) >= width]
        code = np.unique(np.concatenate(parts))
        bucket, (packed,) = packing.dealt(packing.bucket_of(code, buckets), [code])
        g = table.column("g")[0].as_py()
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "g": pa.array(np.full(len(bucket), g), pa.int32()), "code": packed})

    return run


def _bucket_of_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = packing.bucket_of(b.column("code").to_numpy().view(np.uint64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *b.columns], names=["bucket", *b.schema.names])

    return run


def _answer(sent: pa.Table, grams: pa.Table) -> pa.Table:
    code, cuts = packing.values_of(sent.column("code"), np.uint64)
    held = grams.column("code").to_numpy().view(np.uint64)
    order = np.argsort(held, kind="stable")
    lo, hi = np.searchsorted(held[order], code), np.searchsorted(held[order], code, "right")
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    count = hi - lo
    take = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    g = sent.column("g").to_numpy()[np.repeat(row, count)] if len(code) else np.zeros(0, np.int32)
    picked = grams.take(pa.array(take, pa.int64()))
    return pa.table({"g": pa.array(g, pa.int32())} | {c: picked.column(c) for c in ("code", "width", "words", "items")})


def _mark(docs: pa.Table, grams: pa.Table) -> pa.Table:
    held = _Grams(*[grams.column(c).to_pylist() for c in ("code", "width", "words", "items")])
    parts = [_scan(b, held) for b in tokens.pieces(docs.to_batches(), "text")]
    return pa.Table.from_batches(parts) if parts else pa.table({})


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    broadcast_windows: int = BROADCAST_WINDOWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, n_words, n_hit, items, starts, ends) for each document, with the columns ``carry``
    (a result whose name they hold gets an underscore in front).

    Words are runs of letters and digits, A-Z lower-cased; every other ASCII character
    separates.  An item of fewer than ``width`` words, but not none, is one window.  A word
    inside any occurrence of a window is hit; ``items`` are the ids of the items with
    occurring windows, ``starts`` and ``ends`` the ranges of hit words.

    Null or empty texts have no words and no hits, on either side.  An item whose id is null
    hits words but is not listed.  Repeated rows are judged alike; empty tables give no rows
    or no hits.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    source = tokens.carried(docs, carry, id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    found = tokens.schema_of(source, ["text"], _FOUND)
    grams = benchmark_windows(benchmark, item_id, item_text, width)
    rows = grams.limit(broadcast_windows + 1).collect()
    if len(rows) <= broadcast_windows:
        shared = spark.sparkContext.broadcast(tuple([r[c] for r in rows] for c in ("code", "width", "words", "items")))
        return tokens.restored(source.mapInArrow(_scan_all(shared), found), carry)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = 3 * shuffles
    dealt = source.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(shuffles, "g")
    widths = [r["width"] for r in grams.select("width").distinct().collect()]  # at most ``width`` values
    held = grams.mapInArrow(_bucket_of_rows(groups), f"bucket int, {_GRAM}")
    answers = (
        dealt.groupBy("g").applyInArrow(_send(widths, groups), "bucket int, g int, code binary")
        .groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_answer, f"g int, {_GRAM}")
    )
    return tokens.restored(dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_mark, found), carry)
