"""Quality rules: counts of a text, and bands that its compression ratios must lie in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import tokens

LEVEL = 3
CHUNK = 1024
#: (least bytes, least ratio, largest ratio) of whole documents.  A frame costs some bytes and a long
#: text finds more to refer to, so both limits fall with the length; the shortest texts say nothing.
WHOLE_BANDS = (
    (0, 0.0, 9e9), (128, 0.40, 1.00), (256, 0.36, 0.85), (512, 0.32, 0.78), (1024, 0.28, 0.72),
    (2048, 0.25, 0.66), (4096, 0.22, 0.62), (16384, 0.18, 0.58), (65536, 0.12, 0.56),
)
#: The same for chunks, by the length of the chunk: all but the last have ``CHUNK`` bytes.
CHUNK_BANDS = ((0, 0.0, 9e9), (256, 0.30, 0.88), (512, 0.28, 0.82), (1024, 0.25, 0.76))
#: Bytes in chunks outside their band, of all bytes, beyond which the document goes.
CHUNK_SHARE = 0.25
LEAST_WORDS = 50
#: Largest share of words in repeated windows of three, in percent.
REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
WINDOW = 3

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_RATIOS = "ratio double, n_chunks long, n_chunks_out long, out_bytes long, whole_out boolean"


def _within(bands: Sequence[tuple[int, float, float]], size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Does each ratio lie in the band of its size?"""
    least, low, high = (np.array(x, float) for x in zip(*bands))
    k = np.searchsorted(least, size, "right") - 1
    return (ratio >= low[k]) & (ratio <= high[k])


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked places of each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[offsets])


def _repeated_words(words: tokens.Words) -> np.ndarray:
    """Per text, the words inside windows that it holds twice or more."""
    at = tokens.inside(words.first, WINDOW)
    n = len(words.code)
    if not len(at):
        return np.zeros(len(words.first) - 1, np.int64)
    # The text's number is mixed into the code, so that only windows of one text can be equal.
    key = tokens.mix(tokens.window_codes(words.code, WINDOW)[at] ^ tokens.mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(at), bool)
    often[order[1:]] = same
    often[order[:-1]] |= same
    return _per_text(tokens.spread_marks(at[often], WINDOW, n), words.first)


def _duplicate_lines(body: bytes) -> int:
    lines = [x for x in body.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _judge(bands, chunk_bands, chunk: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

        def ratio(part) -> float:
            return len(packer.compress(part)) / len(part)

        for batch in tokens.pieces(batches, "text"):
            data, offsets = tokens.text_buffers(batch.column("text"))
            words = tokens.find_words(data, offsets, tokens.PLAIN)
            points = ((data & 0xC0) != 0x80) & ~_IS_SPACE[data]
            sizes, raw = np.diff(offsets), data.tobytes()
            lines, whole, chunks, outs, out_bytes = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                lines.append(_duplicate_lines(raw[a:b]))
                whole.append(ratio(raw[a:b]) if b > a else 1.0)
                cuts = np.arange(a, b, chunk)
                part = np.minimum(cuts + chunk, b) - cuts
                # One chunk is the whole text, whose band is checked already.
                ok = _within(chunk_bands, part, np.array([ratio(raw[i : i + n]) for i, n in zip(cuts.tolist(), part.tolist())])) if len(cuts) > 1 else np.ones(len(cuts), bool)
                chunks.append(len(cuts))
                outs.append(int((~ok).sum()))
                out_bytes.append(int(part[~ok].sum()))
            rest = [n for n in batch.schema.names if n != "text"]
            counts = [np.diff(words.first), _per_text(points, offsets), _per_text(_IS_SYMBOL[data], offsets), lines, _repeated_words(words)]
            whole_out = ~_within(bands, sizes, np.array(whole)) & (sizes > 0)
            yield pa.record_batch(
                [
                    *[batch.column(n) for n in rest], pa.array(sizes, pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(whole, pa.float64()), *[pa.array(c, pa.int64()) for c in (chunks, outs, out_bytes)], pa.array(whole_out),
                ],
                names=[*rest, "n_bytes", *[x.split()[0] for x in f"{_COUNTS}, {_RATIOS}".split(", ")]],
            )

    return run


def judge_quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_bands=WHOLE_BANDS, chunk_bands=CHUNK_BANDS,
    chunk: int = CHUNK, chunk_share: float = CHUNK_SHARE, level: int = LEVEL, carry: Sequence[str] = (),
) -> DataFrame:
    """(id, n_bytes, counts, ratios, base_failed, reason, kept) for each document, with the columns
    ``carry`` (a result whose name they hold gets an underscore in front).

    Words stand between ASCII white space.  Counts: ``n_words``; ``word_chars`` code points in words;
    ``n_symbols``; ``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words
    in windows of three that the text holds twice or more, the first included.  A document fails the base
    rules with fewer than ``LEAST_WORDS`` words or over ``REPEATED_PERCENT`` percent repeated words.

    ``ratio`` is the size after zstandard by the size before, of the whole text; fixed chunks of ``chunk``
    bytes are compressed by themselves.  A text goes if its ratio is outside the band of its length
    (``repetitive`` below, ``incompressible`` above), or if more than ``chunk_share`` of its bytes lie in
    chunks outside theirs (``chunks``).  ``reason`` is the first that applies, null for kept ones.

    Null text counts as empty: no words, ratio 1, base failed.  Repeated rows are judged alike, each row by
    itself, in one pass without a shuffle; an empty table gives no rows.  Other columns are not looked at.
    """
    source = tokens.carried(docs, carry, id=F.col(doc_id), text=F.col(text).cast("string"))
    out = source.mapInArrow(_judge(whole_bands, chunk_bands, chunk, level), tokens.schema_of(source, ["text"], f"n_bytes long, {_COUNTS}, {_RATIOS}"))
    few = F.col("n_words") < LEAST_WORDS
    often = F.lit(100) * F.col("n_repeat_words") > F.lit(REPEATED_PERCENT) * F.col("n_words")
    reason = (
        F.when(few, "words").when(often, "repeated words")
        .when(F.col("whole_out") & (F.col("ratio") < 0.5), "repetitive").when(F.col("whole_out"), "incompressible")
        .when(F.col("out_bytes") > chunk_share * F.col("n_bytes"), "chunks")
    )
    done = out.withColumn("base_failed", few | often).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    return tokens.restored(done.drop("whole_out", "out_bytes"), carry)
