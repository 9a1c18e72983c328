"""Removal of long repeated passages, found by recompression.

Texts are compressed in rounds.  A round first names runs of one symbol, then names the
pairs of neighbours whose left symbol falls into the left half of the alphabet and whose
right one into the right half, both by a fixed hash.  Names are fingerprints of what they
stand for, so all tasks use the same name for the same content without a dictionary.  Each
named symbol carries the span of words that its making depended on; wherever the words of
that span occur again, the same symbol does.  A window of ``width`` words is represented by
the longest symbol whose span lies inside it, or by its own fingerprint if none does: in
both cases by something that depends on the words of the window alone.

Three steps follow, all on groups of documents dealt by a hash of the id:

1. each group sends its symbols, once each, to buckets; a bucket answers which ones occur
   in more than one document;
2. each group sends the windows under shared symbols, each with its smallest document; a
   bucket answers with the smallest document of all;
3. each group removes the words of windows that begin in a smaller document.

Groups send a symbol or window once however often they hold it, so a passage shared by a
third of all documents costs one entry per group and not one per document.  The texts are
shuffled once; the later steps reuse that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import packing, tokens

_LONG = np.int64(1 << 40)
_ID_NULL = np.iinfo(np.int64).max


class _Symbols:
    """Symbols of a batch of texts: name, words covered [s, e), words depended on [lo, hi)."""

    def __init__(self, code: np.ndarray, first: np.ndarray):
        self.name = code.copy()
        self.s = np.arange(len(code))
        self.e = self.s + 1
        self.lo, self.hi = self.s.copy(), self.e.copy()
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def together(self) -> np.ndarray:
        """Whether symbol i and i + 1 belong to one text."""
        text = self.text[self.s]
        return text[1:] == text[:-1]

    def keep(self, kept: np.ndarray) -> None:
        for f in ("name", "s", "e", "lo", "hi"):
            setattr(self, f, getattr(self, f)[kept])


def _name_runs(x: _Symbols) -> np.ndarray:
    """Replace runs of one symbol; returns which of the remaining symbols are runs.

    Every symbol now depends on both neighbours, which show that no run goes on there.
    """
    n = len(x.name)
    near = x.together()
    equal = np.zeros(n + 1, bool)
    equal[1:n] = (x.name[1:] == x.name[:-1]) & near
    head = np.flatnonzero(~equal[:n])
    tail = np.append(head[1:], n) - 1
    size = tail - head + 1
    before = np.full(n, -_LONG)
    before[1:][near] = x.lo[:-1][near]
    after = np.full(n, _LONG)
    after[:-1][near] = x.hi[1:][near]
    name = x.name[head]
    run = size > 1
    name[run] = tokens.mix(name[run] + size[run].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    x.name, x.s, x.e = name, x.s[head], x.e[tail]
    x.lo, x.hi = before[head], after[tail]
    return run


def _name_pairs(x: _Symbols, turn: int) -> np.ndarray:
    """Replace pairs (left half, right half); returns which of the remaining symbols are pairs."""
    n = len(x.name)
    left = (tokens.mix(x.name + np.uint64(turn * 0x51ED27)) >> np.uint64(17)) & np.uint64(1) == 0
    near = x.together()
    i = np.flatnonzero(left[:-1] & ~left[1:] & near)
    paired = np.zeros(n, bool)
    paired[i] = paired[i + 1] = True
    # A symbol left alone depends on the neighbour that it did not pair with.
    lo, hi = x.lo.copy(), x.hi.copy()
    alone = np.flatnonzero(left & ~paired)
    inner = alone[alone < n - 1]
    hi[alone] = _LONG
    inner = inner[near[inner]]
    hi[inner] = np.maximum(x.hi[inner], x.hi[inner + 1])
    alone = np.flatnonzero(~left & ~paired)
    inner = alone[alone > 0]
    lo[alone] = -_LONG
    inner = inner[near[inner - 1]]
    lo[inner] = np.minimum(x.lo[inner], x.lo[inner - 1])
    hi[i] = x.hi[i + 1]
    x.e[i] = x.e[i + 1]
    x.name[i] = tokens.mix(x.name[i] * np.uint64(0x9E3779B97F4A7C15) + tokens.mix(x.name[i + 1] + np.uint64(turn + 1)))
    x.lo, x.hi = lo, hi
    kept = np.ones(n, bool)
    kept[i + 1] = False
    new = np.zeros(n, bool)
    new[i] = True
    x.keep(kept)
    return new[kept]


def representatives(code: np.ndarray, first: np.ndarray, width: int, rounds: int = 5, shortest: int = 3) -> np.ndarray:
    """For each word position, the longest named symbol that the window there can rely on; 0 if none."""
    best = np.zeros(len(code), np.uint64)

    def offer(x: _Symbols, new: np.ndarray) -> None:
        ok = new & (x.hi - x.lo <= width) & (x.e - x.s >= shortest) & (x.lo >= 0)
        lo, hi = x.lo[ok], x.hi[ok]
        rank = (np.minimum(x.e[ok] - x.s[ok], 63).astype(np.uint64) << np.uint64(58)) | (x.name[ok] >> np.uint64(6))
        for back in range(width):
            at = lo - back
            fits = (hi - at <= width) & (at >= 0)
            if not fits.any():
                break
            np.maximum.at(best, at[fits], rank[fits])

    if not len(code):
        return best
    x = _Symbols(code, first)
    offer(x, _name_runs(x))
    for turn in range(rounds):
        offer(x, _name_pairs(x, turn))
    offer(x, _name_runs(x))
    return best


def _keys(w: tokens.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and the key of each: its representative symbol, or its own fingerprint."""
    at = tokens.inside(w.first, width)
    key = representatives(w.code, w.first, width)[at]
    bare = np.flatnonzero(key == 0)
    if len(bare):
        key[bare] = tokens.window_codes(w.code, width, salt=2)[at[bare]]
    return at, tokens.mix(key)


def _slices(table: pa.Table):
    """(ids, bytes, offsets) of a group's documents, about a megabyte of text at a time."""
    for batch in tokens.pieces(table.to_batches(), "text", 1 << 20):
        ids = batch.column("id").fill_null(_ID_NULL).to_numpy(zero_copy_only=False)
        yield ids, *tokens.text_buffers(batch.column("text"))


def _send_symbols(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for doc, data, offsets in _slices(table):
            w = tokens.find_words(data, offsets, tokens.PLAIN)
            at, key = _keys(w, width)
            own = doc[w.doc[at]]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            keys.append(key[new])
            ids.append(own[new])
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        # Of each key, the entry of its first document and that of another one stay.
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        other = own != own[start]
        second = other.copy()
        second[1:] &= ~(other[:-1] & ~head[1:])
        key = key[head | second]
        bucket, (low,) = packing.dealt(packing.bucket_of(key, buckets), [key.astype(np.uint32)])
        g = table.column("g")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "g": pa.array(np.full(len(bucket), g), pa.int32()), "low": low})

    return run


def _answer_symbols(table: pa.Table) -> pa.Table:
    low, cuts = packing.values_of(table.column("low"), np.uint32)
    value, count = np.unique(low, return_counts=True)
    shared, _ = packing.find(value[count > 1], low)
    # Within a group an entry may stand twice; once is enough in the answer.
    shared[1:] &= (low[1:] != low[:-1]) | np.isin(np.arange(1, len(low)), cuts)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[shared]
    rows, (cells,) = packing.dealt(row, [low[shared]])
    return pa.table({"g": table.column("g").combine_chunks().take(pa.array(rows)), "bucket": table.column("bucket").combine_chunks().take(pa.array(rows)), "low": cells})


def _send_windows(width: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        low, cuts = packing.values_of(answers.column("low"), np.uint32)
        bucket = np.repeat(answers.column("bucket").to_numpy(), np.diff(cuts)).astype(np.uint64)
        shared = np.sort((bucket << np.uint64(32)) | low)
        codes, checks, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for doc, data, offsets in _slices(docs) if len(shared) else ():
            w = tokens.find_words(data, offsets, tokens.PLAIN)
            at, key = _keys(w, width)
            place = (packing.bucket_of(key, buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
            at = at[packing.find(shared, place)[0]]
            codes.append(tokens.window_codes(w.code, width)[at])
            checks.append(_check(w.code, width)[at])
            ids.append(doc[w.doc[at]])
        code, check, own = np.concatenate(codes), np.concatenate(checks), np.concatenate(ids)
        order = np.lexsort((own, check, code))
        code, check, own = code[order], check[order], own[order]
        head = np.ones(len(code), bool)
        head[1:] = (code[1:] != code[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(code)) - 1
        several = (own[last[: len(at)]] != own[at]).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        code, check, own = code[at], check[at], own[at]
        dealt, packed = packing.dealt(packing.bucket_of(code, buckets), [code, check, own, several])
        g = docs.column("g")[0].as_py() if docs.num_rows else 0
        return pa.table(
            {"bucket": pa.array(dealt, pa.int32()), "g": pa.array(np.full(len(dealt), g), pa.int32())}
            | dict(zip(("code", "check", "own", "several"), packed))
        )

    return run


def _check(code: np.ndarray, width: int) -> np.ndarray:
    """A second fingerprint of windows, independent of the first."""
    return (tokens.window_codes(code, width, salt=1) >> np.uint64(32)).astype(np.uint32)


def _answer_windows(table: pa.Table) -> pa.Table:
    code, cuts = packing.values_of(table.column("code"), np.uint64)
    check, _ = packing.values_of(table.column("check"), np.uint32)
    own, _ = packing.values_of(table.column("own"), np.int64)
    several, _ = packing.values_of(table.column("several"), np.uint8)
    order = np.lexsort((own, check, code))
    head = np.ones(len(code), bool)
    head[1:] = (code[order][1:] != code[order][:-1]) | (check[order][1:] != check[order][:-1])
    least = np.empty(len(code), np.int64)
    least[order] = own[order][np.maximum.accumulate(np.where(head, np.arange(len(code)), 0))]
    useful = (least < own) | (several > 0)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[useful]
    rows, packed = packing.dealt(row, [code[useful], check[useful], least[useful]])
    return pa.table({"g": table.column("g").combine_chunks().take(pa.array(rows))} | dict(zip(("code", "check", "least"), packed)))


def _remove(width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        code, _ = packing.values_of(answers.column("code"), np.uint64)
        check, _ = packing.values_of(answers.column("check"), np.uint32)
        least, _ = packing.values_of(answers.column("least"), np.int64)
        order = np.argsort(code, kind="stable")
        code, check, least = code[order], check[order], least[order]
        twins = int(np.unique(code, return_counts=True)[1].max()) if len(code) else 0
        parts = []
        for doc, data, offsets in _slices(docs):
            w = tokens.find_words(data, offsets, tokens.PLAIN)
            n = len(w.code)
            at = tokens.inside(w.first, width)
            hit = np.zeros(len(at), bool)
            if len(code) and len(at):
                mine, ours = tokens.window_codes(w.code, width)[at], _check(w.code, width)[at]
                own = doc[w.doc[at]]
                found, place = packing.find(code, mine)
                found = np.flatnonzero(found)
                for step in range(twins):  # equal first fingerprints stand side by side
                    k = np.minimum(place[found] + step, len(code) - 1)
                    hit[found] |= (code[k] == mine[found]) & (check[k] == ours[found]) & (least[k] < own[found])
            gone = tokens.spread_marks(at[hit], width, n)
            parts.append(
                pa.table(
                    {
                        "id": pa.array(doc, mask=doc == _ID_NULL),
                        "n_words": pa.array(np.diff(w.first), pa.int64()),
                        "n_removed": pa.array(np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first]), pa.int64()),
                        "kept": _joined(data, w, ~gone),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    return run


def _joined(data: np.ndarray, w: tokens.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, size = w.start[kept], (w.end - w.start)[kept]
    first = np.concatenate([[0], np.cumsum(kept)])[w.first]
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.arange(ends[-1]) - np.repeat(ends[:-1] - start, size + 1)
    out = data[np.minimum(source, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[ends[1:] - 1] = 0x20
    # The last space of each text goes.
    full = np.diff(first) > 0
    stay = np.ones(len(out), bool)
    stay[ends[first[1:][full]] - 1] = False
    sizes = np.diff(ends[first]) - full
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[stay]))])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13, groups: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): each text without passages that begin in a smaller document.

    Words are what stands between ASCII white space, unchanged.  A word goes if it lies in a
    window of ``width`` words whose sequence also starts in a document with a smaller id;
    windows are those of the input.  ``kept`` joins the other words by one space.

    Null or empty text: no words, ``kept`` empty.  Texts under ``width`` words keep all.
    Rows that share an id never remove from one another.  A null id counts as the greatest
    and stays null.  An empty table gives no rows.  Other columns are not looked at.

    ``groups`` (by default two for each shuffle partition) sets how finely documents are
    dealt, buckets are as many as shuffle partitions; a task holds one group of texts, or one
    bucket, at a time.  A group sends one row to a bucket, so more of both mean more, smaller rows.
    """
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups or 2 * shuffles
    key = F.col(doc_id).cast("long")
    dealt = docs.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"), key.alias("id"), F.col(text).cast("string").alias("text")
    ).repartition(shuffles, "g")
    symbols = (
        dealt.groupBy("g").applyInArrow(_send_symbols(width, shuffles), "bucket int, g int, low binary")
        .groupBy("bucket").applyInArrow(_answer_symbols, "g int, bucket int, low binary")
    )
    windows = (
        dealt.groupBy("g").cogroup(symbols.repartition(shuffles, "g").groupBy("g"))
        .applyInArrow(_send_windows(width, shuffles), "bucket int, g int, code binary, check binary, own binary, several binary")
        .groupBy("bucket").applyInArrow(_answer_windows, "g int, code binary, check binary, least binary")
    )
    return (
        dealt.groupBy("g").cogroup(windows.repartition(shuffles, "g").groupBy("g"))
        .applyInArrow(_remove(width), "id long, n_words long, n_removed long, kept string")
    )
