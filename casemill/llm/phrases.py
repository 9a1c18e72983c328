"""Frequent word sequences and how strongly their words belong together.

Groups of texts, in which equal ones are counted once and weighted, hash n-grams by prefix polynomials
over the codes of their words and send (fingerprint, weight) to buckets of fingerprints.  A bucket adds
the weights up and tells each group which of its fingerprints reach the least count.  In the end the
groups find those again in their texts and cut the words out, so that phrases, not fingerprints, are
counted: phrases that share a fingerprint come apart, and only frequent ones are ever written out.

A phrase cannot be more frequent than its parts.  So words go first, then pairs of frequent words, then
longer n-grams all of whose pairs are frequent; the others are never sent.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm import packing, tokens
from casemill.session import durable

LONGEST = 4
LEAST = 30
DROP_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
#: Bytes of text of a group, which a task holds at a time, and of the share of a bucket.
GROUP_BYTES = 12 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of text that a task sorts by group before it sends them.
DEAL_BYTES = 32 << 20

_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_TABLE = tokens._table([0x20, 0x09, *_BREAKS], fold=True)
_TABLE[0] = 0x41  # NUL is part of a word; no folded byte has this value
_IS_BREAK = np.isin(np.arange(256), _BREAKS)
_BASE = 0xA0761D6478BD642F  # odd, so it has an inverse modulo 2^64
_ENTRY = "g int, codes binary, rest binary"
_SENT = f"bucket int, {_ENTRY}"
#: Bits of a fingerprint beyond those of the number of bytes of all texts.  Phrases are compared as texts in the
#: end, so a collision costs work, not results: a rare n-gram that meets a frequent one is written out and dropped.
#: Texts hold two n-grams a byte at most, one in ``LEAST`` of them frequent, so that is one n-gram in 15 at worst.
SPARE_BITS = 0


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: what is alike comes together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(c) for c in columns))


def _unpack(cell: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8), 0, []
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(k).ravel())
        at += n * width
    return out


def _pack_codes(code: np.ndarray) -> bytes:
    """Sorted codes as their steps."""
    return _pack(np.diff(code, prepend=np.uint64(0)))


def _codes_of(cells: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.cumsum(_unpack(c, np.uint64)[0], dtype=np.uint64) for c in cells.to_pylist()]


def _rest_of(cells: pa.ChunkedArray) -> list[list[np.ndarray]]:
    """(weight, place, width) of each cell; the place is 0 where a group is to find it again."""
    return [_unpack(c, np.int64, np.uint32, np.uint8) for c in cells.to_pylist()]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _cut_to(bits: int) -> np.uint64:
    """A mask of the leading bits."""
    return np.uint64((1 << 64) - (1 << 64 - bits))


def _order(code: np.ndarray) -> np.ndarray:
    """Positions in order of codes, ties by position; those of short codes ride in the bits left free."""
    free = np.uint64((1 << len(code).bit_length()) - 1)
    if (code & free).any():
        return np.argsort(code, kind="stable")
    key = code | np.arange(len(code), dtype=np.uint64)
    key.sort()
    return (key & free).astype(np.int64)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Which values of a sorted array are the first of their kind."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def _among(known: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which codes are among the sorted, distinct known ones: leading bits name the few to compare with."""
    lead = min(len(known).bit_length() + 1, 24)
    slot = np.uint64(64 - lead)
    starts = np.concatenate([[0], np.cumsum(np.bincount((known >> slot).astype(np.int64), minlength=1 << lead))])
    most = int(np.diff(starts).max())
    if most > 16:
        return packing.find(known, code)[0]
    held = (code >> slot).astype(np.int64)
    at, stop, hit = starts[held], starts[held + 1], np.zeros(len(code), bool)
    for j in range(most):
        hit |= (known[np.minimum(at + j, len(known) - 1)] == code) & (at + j < stop)
    return hit


def word_ids(data: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A number per word that is equal only for words of equal folded bytes.

    Words of one fingerprint are compared byte by byte with the first of them, ``step`` words at a time;
    one that differs, or is of another length, gets a number of its own.
    """
    code = code & _cut_to(64 - len(code).bit_length())
    order = _order(code)
    head, ids = _heads(code[order]), np.empty(len(code), np.int64)
    first, ids[order] = order[head], np.cumsum(head) - 1
    size, like = end - start, first[ids]
    same = size == size[like]
    for a in range(0, len(code), step):
        rows = np.flatnonzero(same[a : a + step] & (like[a : a + step] != np.arange(a, min(a + step, len(code))))) + a
        held = size[rows]
        ends = np.cumsum(held)
        if len(rows):
            along = np.arange(ends[-1]) - np.repeat(ends - held, held)
            mine, other = (_TABLE[data[np.repeat(at, held) + along]] for at in (start[rows], start[like[rows]]))
            wrong = np.concatenate([[0], np.cumsum(mine != other)])
            same[rows[wrong[ends] > wrong[ends - held]]] = False
    ids[~same] = len(first) + np.arange(int((~same).sum()))
    return ids


def _before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each position, and in all."""
    out = np.zeros(len(marks) + 1, np.uint32 if len(marks) < 1 << 32 else np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def room_of(data: np.ndarray, words: tokens.Words) -> np.ndarray:
    """How many words, itself included, follow each word within its piece and text."""
    n = len(words.code)
    broken = _before(_IS_BREAK[data])
    apart = np.ones(n, bool)  # the next word is in another piece or text
    apart[:-1] = broken[words.start[1:]] > broken[words.end[:-1]]
    inner = words.first[1:-1]
    apart[inner[(inner > 0) & (inner <= n)] - 1] = True
    last = np.flatnonzero(apart)
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


class _Group:
    """The words of a group's texts, and fingerprints of its n-grams by first word and width."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = tokens.text_buffers(table.column("text"))
        self.words = tokens.find_words(self.data, self.offsets, _TABLE)
        named, text = table.column("lang").combine_chunks().dictionary_encode(), self.words.doc
        self.language, self.weight = named.indices.to_numpy()[text], table.column("copies").to_numpy()[text]
        self.room, self._salts = room_of(self.data, self.words), _salts(named.dictionary)
        up, self._down = _powers(len(self.words.code) + 1)
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.code * up[:-1])])

    def codes(self, at: np.ndarray, width: int) -> np.ndarray:
        raw = (self._prefix[at + width] - self._prefix[at]) * self._down[at]
        return tokens.mix(raw ^ self._salts[self.language[at]] ^ tokens.mix(np.full(1, width + 1, np.uint64)))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each language and the number of its words."""
        total = np.zeros(len(self._salts), np.int64)
        np.add.at(total, self.language, self.weight)
        held, first = np.unique(self.language, return_index=True)
        return first, total[held]


def _grams(group: _Group, widths: Sequence[int], known: np.ndarray, bits: int = 64):
    """(code, weight, width) of the distinct fingerprints of a group's n-grams of the given widths.

    Width 0 stands for the empty phrase, once per word, so that all words of a language are counted;
    from width 2 on, an n-gram counts only if the codes of its words are ``known``, from 3 on its pairs.
    """
    n, cut = len(group.words.code), _cut_to(bits)
    if not n:
        return
    if 0 in widths:
        first, total = group.totals()
        yield group.codes(first, 0) & cut, total, 0
    base = min(max(widths) - 1, 2)  # the width of the parts that must be known
    good = group.room >= max(base, 1)
    if base:
        at = np.flatnonzero(good)
        good[at] = _among(known, group.codes(at, base) & cut)
    for width in widths:
        if not width:
            continue
        fits = group.room >= width
        for j in range(width - base + 1 if base else 0):
            fits[: n - j] &= good[j:]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        code = group.codes(at, width) & cut
        order = _order(code)
        code = code[order]
        head = np.flatnonzero(_heads(code))
        yield code[head], np.add.reduceat(group.weight[at[order]], head), width


def _located(group: _Group, asked: dict[int, np.ndarray], bits: int = 64):
    """(weight, place, width) of the distinct n-grams of a group whose codes are asked for, by their width.

    The parts of a frequent n-gram are frequent, so where they are asked for too, only their places are looked at.
    """
    words, n, cut, marks, used = group.words, len(group.words.code), _cut_to(bits), {}, np.zeros(len(group.words.code), bool)
    if not n:
        return
    if 0 in asked:
        first, total = group.totals()
        yield total, words.start[first], 0
    for width in sorted(set(asked) - {0}):
        marks[width] = group.room >= width
        if width - 1 in marks:
            marks[width][:-1] &= marks[width - 1][:-1] & marks[width - 1][1:]
        at = np.flatnonzero(marks[width])
        marks[width][at] = _among(asked[width], group.codes(at, width) & cut)
        for j in range(width):
            used[j:] |= marks[width][: n - j]
    used, ids = np.flatnonzero(used), np.full(n, -1, np.int64)
    ids[used] = word_ids(group.data, words.code[used], words.start[used], words.end[used])
    for width, mark in marks.items():
        at = np.flatnonzero(mark)
        if not len(at):
            continue
        code = group.codes(at, width) & _cut_to(64 - len(at).bit_length())
        order = _order(code)
        at, first = at[order], _heads(code[order])
        head = np.flatnonzero(first)
        rep = at[head][np.cumsum(first) - 1]
        # Equal fingerprints of unequal words or languages stay apart.
        differ = group.language[at] != group.language[rep]
        for j in range(width):
            differ |= ids[at + j] != ids[rep + j]
        mine = group.weight[at]
        total = np.add.reduceat(np.where(differ, 0, mine), head)
        yield np.concatenate([total, mine[differ]]), words.start[np.concatenate([at[head], at[differ]])], width


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of an input split, sorted by group and compressed together: (g, texts)."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [("g", "ascending")])).combine_chunks()
        g, texts, cells = table.column("g").to_numpy(), table.select(["lang", "text"]), []
        for a, b in _cut(g):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(texts.slice(a, b - a))
            cells.append((int(g[a]), sink.getvalue().to_pybytes()))
        return pa.record_batch([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary())], names=["g", "texts"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= DEAL_BYTES:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _distinct(dealt: pa.Table) -> pa.Table:
    """The texts of a group with the number of their copies, in one order whatever the shuffle delivers."""
    table = pa.concat_tables([pa.ipc.open_stream(cell).read_all() for cell in dealt.column("texts").to_pylist()])
    merged = table.group_by(["lang", "text"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["lang", "text", "copies"])
    return merged.take(pc.sort_indices(merged, [("lang", "ascending"), ("text", "ascending")]))


def _salts(names: pa.Array) -> np.ndarray:
    """A fingerprint per language."""
    numbers = [int.from_bytes(name.encode(), "little") % ((1 << 61) - 1) + 1 for name in names.to_pylist()]
    return tokens.mix(np.array(numbers, np.uint64))


def _cut(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    return list(zip(edges, edges[1:])) if len(key) else []


def _send(buckets: int, widths: Sequence[int], bits: int = 64):
    """Entries of a group's n-grams, dealt to buckets."""

    def run(table: pa.Table, known: np.ndarray) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and (len(known) or min(widths) < 2):
            name = table.column("g")[0].as_py()
            found = list(_grams(_Group(_distinct(table)), widths, known, bits))
            if found:
                code, weight = (np.concatenate([f[k] for f in found]) for k in range(2))
                width = np.concatenate([np.full(len(f[0]), f[2], np.uint8) for f in found])
                order = _order(code)
                code, weight, width = code[order], weight[order], width[order]
                bucket, place = packing.bucket_of(code, buckets), np.zeros(len(code), np.uint32)
                rows = [(int(bucket[a]), name, _pack_codes(code[a:b]), _pack(weight[a:b], place[a:b], width[a:b])) for a, b in _cut(bucket)]
        kinds = {"bucket": pa.int32(), "g": pa.int32(), "codes": pa.binary(), "rest": pa.binary()}
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})

    def words(table: pa.Table) -> pa.Table:
        return run(table, np.zeros(0, np.uint64))

    def longer(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The n-grams whose parts the answers name."""
        return run(table, np.unique(np.concatenate([np.zeros(0, np.uint64), *_codes_of(answers.column("codes"))])))

    return words if min(widths) < 2 else longer


def _answer(least: int):
    """Which entries of a bucket belong to fingerprints whose weights add up to the least count."""

    def run(sent: pa.Table) -> pa.Table:
        codes, rest = _codes_of(sent.column("codes")), _rest_of(sent.column("rest"))
        code, weight = np.concatenate(codes), np.concatenate([r[0] for r in rest])
        order = np.argsort(code, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
        often = np.zeros(len(code), bool)
        often[order] = np.repeat(np.add.reduceat(weight[order], head) >= least, np.diff([*head, len(code)]))
        at, rows = 0, []
        for g, c, r in zip(sent.column("g").to_pylist(), codes, rest):
            mine = often[at : at + len(c)]
            at += len(c)
            if mine.any():
                rows.append((g, _pack_codes(c[mine]), _pack(*[x[mine] for x in r])))
        kinds = {"g": pa.int32(), "codes": pa.binary(), "rest": pa.binary()}
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})

    return run


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of bytes, each with a line break behind it, as one binary column; no phrase holds one."""
    ends = np.cumsum(size + 1)
    along = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - 1, size + 1)
    out = data[np.minimum(np.repeat(start, size + 1) + along, len(data) - 1)]
    out[ends - 1] = 0x0A
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(out)])


def _phrases_at(
    data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: np.ndarray, words: tokens.Words | None = None
) -> tuple[pa.Array, np.ndarray]:
    """The folded words at each place, joined by single spaces, and a fingerprint of them."""
    words = words or tokens.find_words(data, offsets, _TABLE)
    at = np.searchsorted(words.start, place)
    letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
    tabs = _before(data == 0x09)
    stop = np.where(width > 0, words.end[at + np.maximum(width, 1) - 1], place)
    size = letters[at + width] - letters[at] + np.maximum(width, 1) - 1
    # Most stand in the text as they are written out; runs of spaces and tabs become one space first.
    loose = np.flatnonzero((stop - place != size) | (tabs[stop] > tabs[place]))
    folded = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    start = place.astype(np.int64)
    if len(loose):
        tidy = [b" ".join(folded[a:b].tobytes().split(None)) for a, b in zip(place[loose].tolist(), stop[loose].tolist())]
        start[loose] = len(folded) + np.concatenate([[0], np.cumsum([len(t) for t in tidy])[:-1]])
        folded = np.concatenate([folded, np.frombuffer(b"".join(tidy), np.uint8)])
    mark = np.zeros(len(place), np.uint64)
    for j in range(int(width.max(initial=0))):
        more = width > j
        mark[more] = mark[more] * np.uint64(_BASE) + words.code[at[more] + j]
    return _joined(folded, start, size), tokens.mix(mark)


def _pack_phrases(langs: list[str], lang: np.ndarray, count: np.ndarray, lines: bytes) -> bytes:
    head = json.dumps(langs).encode()
    body = _planes(lang.astype(np.uint32)) + _planes(count.astype(np.int64)) + lines
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<II", len(head), len(lang)) + head + body)


def _unpack_phrases(cell: bytes) -> pa.Table:
    """(lang, phrase with its line break, f)."""
    raw = zstandard.ZstdDecompressor().decompress(cell)
    size, n = struct.unpack_from("<II", raw)
    at = 8 + size
    lang = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel()
    count = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 4 * n).reshape(8, n).T).view(np.int64).ravel()
    lines = np.frombuffer(raw, np.uint8, offset=at + 12 * n)
    ends = np.concatenate([[0], np.flatnonzero(lines == 0x0A) + 1])
    names = pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(json.loads(raw[8:at]), pa.string())).cast(pa.string())
    texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(lines)])
    return pa.table({"lang": names, "phrase": texts, "f": pa.array(count)})


def _spell(buckets: int, bits: int = 64):
    """Find the fingerprints told in a group's texts, cut the phrases out and deal them to buckets by their words."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if answers.num_rows and table.num_rows:
            table = _distinct(table)
            named = table.column("lang").combine_chunks().dictionary_encode()
            code, width = np.concatenate(_codes_of(answers.column("codes"))), np.concatenate([r[2] for r in _rest_of(answers.column("rest"))])
            group = _Group(table)
            located = list(_located(group, {int(w): np.unique(code[width == w]) for w in np.unique(width)}, bits))
            data, offsets, words = group.data, group.offsets, group.words
            del group
            weight, place = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in located]]) for k in range(2))
            width = np.repeat([x[2] for x in located], [len(x[0]) for x in located]).astype(np.int64)
            text, mark = _phrases_at(data, offsets, place, width, words)
            lang = named.indices.to_numpy()[np.searchsorted(offsets, place, "right") - 1]
            found = pa.table({"b": packing.bucket_of(mark, buckets), "phrase": text, "lang": lang, "f": weight})
            found = found.take(pc.sort_indices(found, [("b", "ascending"), ("phrase", "ascending")])).combine_chunks()
            bucket, lang, f = (found.column(c).to_numpy() for c in ("b", "lang", "f"))
            ordered = found.column("phrase").combine_chunks()
            ends, lines = np.frombuffer(ordered.buffers()[1], np.int64), ordered.buffers()[2]
            langs = named.dictionary.to_pylist()
            rows = [(int(bucket[a]), _pack_phrases(langs, lang[a:b], f[a:b], lines[int(ends[a]) : int(ends[b])].to_pybytes())) for a, b in _cut(bucket)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "phrases": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _merge(least: int):
    """Add up the counts of a bucket's phrases; those that reach the least count are materialised."""

    def run(told: pa.Table) -> pa.Table:
        parts = pa.concat_tables([_unpack_phrases(cell) for cell in told.column("phrases").to_pylist()])
        total = parts.group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        often = total.filter(pc.greater_equal(total.column("f_sum"), least))
        texts = [p[:-1] for p in often.column("phrase").to_pylist()]
        return pa.table(
            {
                "lang": often.column("lang"), "width": pa.array([p.count(b" ") + 1 if p else 0 for p in texts], pa.int32()),
                "phrase": pa.array([p.decode() for p in texts], pa.string()), "f": often.column("f_sum"),
            }
        )

    return run


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(lang, width, phrase, f): every phrase of 1 to ``longest`` words that occurs ``least`` times or more in
    its language, with its exact count; width 0 is the empty phrase, whose count is that of all words.

    A-Z is lower-cased; punctuation ``.,;:!?`` and line breaks end a piece, spaces and tabs a word; phrases
    lie within a piece.  Null texts count as empty, a null language as ``und``.  Repeated rows count as
    often as they occur.  An empty table has no phrases.  Other columns are not looked at.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), body.alias("text")).filter(F.octet_length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, buckets, bits = size // group_bytes + 1, size // bucket_bytes + 1, min(64, size.bit_length() + SPARE_BITS)
    # Copies of a text in different splits of the input go to different groups, so many copies are no hot group.
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("lang", "text", F.spark_partition_id()), F.lit(groups)).cast("int"))
    texts = dealt.mapInArrow(_deal, "g int, texts binary").groupBy("g")

    def told(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_answer(least), _ENTRY)

    answers = [told(texts.applyInArrow(_send(buckets, (0, 1), bits), _SENT))]
    for widths in ((2,), tuple(range(3, longest + 1))):
        if widths and widths[0] <= longest:
            parts = answers[-1].select("g", "codes").groupBy("g")
            answers.append(told(texts.cogroup(parts).applyInArrow(_send(buckets, widths, bits), _SENT)))
    frequent = reduce(DataFrame.unionByName, answers)
    spelled = texts.cogroup(frequent.groupBy("g")).applyInArrow(_spell(buckets, bits), "bucket int, phrases binary")
    return spelled.groupBy("bucket").applyInArrow(_merge(least), "lang string, width int, phrase string, f long")


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored_candidates(phrases: DataFrame, drop_percent: int = DROP_PERCENT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more.

    A cut after k words gives l and r, the counts of both parts, and the score
    ``floor(SCALE * a / (l + r))``; the lowest counts, ties to the smallest k.  A phrase goes if a longer one
    that contains it is nearly as frequent: at least ``drop_percent`` percent.  Parts of a frequent phrase
    are frequent, so both joins find a partner.  Products are decimals, which cannot overflow here.
    """
    words = F.split("phrase", " ")
    some = phrases.filter("width >= 2").select("lang", "phrase", "width", F.col("f").alias("a"), words.alias("w"))
    cuts = some.select(
        "lang", "phrase", "a", "width",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("width") - 1), lambda k: F.struct(
            k.alias("k"), _part(F.col("w"), 1, k).alias("first"), _part(F.col("w"), k + 1, F.col("width") - k).alias("rest")))).alias("c"),
    ).select("lang", "phrase", "a", "width", "c.*")
    single = phrases.filter(F.col("width").between(1, longest - 1))
    firsts = single.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = single.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    up = F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)")
    down = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    priced = both.withColumn("_up", up).withColumn("_down", down).withColumn("score", F.expr("_up div _down"))
    lowest = priced.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = some.filter("width >= 3").select(
        "lang", "a",
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("width") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("width") - n + 1), lambda i: _part(F.col("w"), i, n))))).alias("phrase"),
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    hundred = F.lit(100).cast("decimal(3,0)") * F.col("_around").cast("decimal(20,0)")
    share = F.lit(drop_percent).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("_around").isNull() | (hundred < share))
    return kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    drop_percent: int = DROP_PERCENT, top: int = TOP, **sizes: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and text.

    Counts are those of ``frequent_phrases``, candidates and scores those of ``scored_candidates``; ``n`` is
    the number of all words of the language.  Ties end in the phrase, in byte order.  Null and empty
    texts, repeated rows and an empty table are treated as there.
    """
    phrases = durable(frequent_phrases(docs, text, lang, longest, least, **sizes))
    totals = phrases.filter("width = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored_candidates(phrases, drop_percent, longest).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
