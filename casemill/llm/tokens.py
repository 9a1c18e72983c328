"""Words of whole texts as 64-bit fingerprints, computed on the bytes of an Arrow column.

Texts are cut on UTF-8 bytes: every separator used here is ASCII, and no byte of a longer
code point is, so cutting bytes equals cutting characters.  A fingerprint is a polynomial in
a fixed odd base modulo 2^64; sums of ``byte x base^position`` make it a difference of two
prefix sums, so no loop runs over words.  Memory is bounded by ``PIECE`` bytes at a time,
and by eight bytes a word for what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Power tables, grown to the longest piece met so far and reused."""

    up = _powers(_BASE, 1 << 10)
    down = _powers(_INVERSE, 1 << 10)

    @classmethod
    def at_least(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _table(separators: list[int], fold: bool) -> np.ndarray:
    """Byte -> byte, 0 for separators; ``fold`` lower-cases A-Z first."""
    out = np.arange(256, dtype=np.uint8)
    if fold:
        out[0x41:0x5B] += 0x20
    out[np.isin(out, separators)] = 0
    return out


#: Words between ASCII white space, unchanged.  NUL is a word byte here and gets a value of its own.
PLAIN = _table([0x20, *range(0x09, 0x0E)], fold=False)
#: Runs of letters and digits: A-Z lower-cased, all other ASCII separates.
FOLDED = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], fold=True)


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


class Words:
    """All words of a batch of texts, in order.

    ``code`` fingerprint, ``start`` and ``end`` byte range, ``first`` the n + 1 word offsets of texts.
    """

    def __init__(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.code, self.start, self.end, self.first = code, start, end, first

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: Runs of letters and digits (1), runs of punctuation (2); white space and control separate (0).
KINDS = np.where(FOLDED > 0, 1, 2).astype(np.uint8)
KINDS[:0x21] = KINDS[0x7F] = 0


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, kinds: np.ndarray | None = None) -> Words:
    """Cut the texts ``data[offsets[i]:offsets[i + 1]]`` into words and fingerprint them.

    With ``kinds`` a word also ends where the kind of its bytes changes.
    """
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    codes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):  # never inside a word
            stop = np.flatnonzero(_is_sep(data[to : to + PIECE], table))
            if len(stop):
                to += int(stop[0])
                break
            to = min(to + PIECE, len(data))
        c, s, e = _piece(data[at:to], edge[(edge > at) & (edge < to)] - at, table, kinds)
        codes.append(c)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not codes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(codes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def _is_sep(part: np.ndarray, table: np.ndarray) -> np.ndarray:
    sep = table[part] == 0
    return sep & (part != 0) if table is PLAIN else sep


def _piece(part: np.ndarray, edge: np.ndarray, table: np.ndarray, kinds: np.ndarray | None):
    word = ~_is_sep(part, table)
    kind = word if kinds is None else kinds[part]
    n = len(part)
    left = np.zeros(n + 1, bool)  # a word may start here / end before here
    left[0] = left[n] = True
    left[1:n] = kind[1:] != kind[:-1]
    left[edge] = True
    start = np.flatnonzero(left[:n] & word)
    end = np.flatnonzero(left[1:] & word) + 1
    up, down = _Tables.at_least(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[table[part]] * up[:n], out=total[1:])
    code = (total[end] - total[start]) * down[start]
    return mix(code ^ (end - start).astype(np.uint64)), start, end


def window_codes(code: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Fingerprint of every run of ``width`` words, boundaries between texts ignored."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # Horner's rule over the width: plain multiply-adds on whole arrays.
    base = np.uint64((_BASE + 2 * salt) & (2**64 - 1))
    for j in range(width):
        out *= base
        out += code[j : j + n]
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Start positions of the windows that lie within one text."""
    last = first[1:] - width
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = np.zeros(int(first[-1]) + 1, np.int32)
    ok = last >= first[:-1]
    np.add.at(step, first[:-1][ok], 1)
    np.add.at(step, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(step)[:-1] > 0)


def spread_marks(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words covered by windows that start at the positions ``marks``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, marks, 1)
    np.add.at(step, np.minimum(marks + width, n), -1)
    return np.cumsum(step)[:-1] > 0


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffers(batch.column(batch.schema.get_field_index(text)))[1])
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def carried(docs: DataFrame, carry: Sequence[str], **columns: Column) -> DataFrame:
    """The named columns, and those to carry through under names that clash with nothing."""
    return docs.select(*[c.alias(n) for n, c in columns.items()], *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(carry)])


def schema_of(df: DataFrame, drop: Sequence[str], more: str) -> str:
    """Schema text of ``df`` without some columns, and with more."""
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop], more])


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, behind as many underscores as it takes to clash with none of ``taken``."""
    while name in taken:
        name = "_" + name
    return name


def restored(df: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Give carried columns their names back; a result of the same name gets an underscore."""
    names = {f"_k{i}": c for i, c in enumerate(carry)}
    return df.select(*[F.col(c).alias(names[c] if c in names else free_name(c, carry)) for c in df.columns])
