"""Text quality from random-indexing word vectors and a small network.

Every token has a sparse index vector of +1 and -1 fixed by its fingerprint.  A word's vector
is the sum of the index vectors of its neighbours over the whole corpus; words share
``BUCKETS`` rows by hash, so that the table has a fixed size and leaves out no word.  A
document pools the vectors of its tokens and the products of adjacent ones, which tell
repetition and odd neighbours.  A two-layer network, trained on a bounded labelled sample,
turns that into a probability, calibrated by one temperature on rows it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm import tokens

BUCKETS = 1 << 14
WIDTH = 64
NEIGHBOURS = (-2, -1, 1, 2)
SPARSE = 4
TRAIN_ROWS = 20_000
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[tokens.KINDS == 0] = 0


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(50)).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], limit: int):
    for batch in tokens.pieces(batches, "text", limit):
        yield batch, tokens.find_words(*tokens.text_buffers(batch.column("text")), _TABLE, tokens.KINDS)


def _count_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * WIDTH)
    seen = np.zeros(BUCKETS, np.int64)
    for _, w in _cut(batches, 2 << 20):
        row, text = _bucket(w.code) * WIDTH, w.doc
        seen += np.bincount(row // WIDTH, minlength=BUCKETS)
        for k in range(SPARSE):
            place = ((w.code >> np.uint64(6 * k)) & np.uint64(WIDTH - 1)).astype(np.int64)
            sign = 1.0 - 2.0 * ((w.code >> np.uint64(40 + k)) & np.uint64(1)).astype(np.float64)
            for off in NEIGHBOURS:
                here, there = (slice(-off, None), slice(None, off)) if off < 0 else (slice(None, -off), slice(off, None))
                same = text[here] == text[there]
                total += np.bincount((row[here] + place[there])[same], weights=sign[there][same], minlength=BUCKETS * WIDTH)
    used = np.flatnonzero(seen)
    if len(used):
        table = total.reshape(BUCKETS, WIDTH)[used].astype(np.int64)
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(seen[used]), *[pa.array(table[:, j]) for j in range(WIDTH)]],
            names=["bucket", "n", *[f"d{j}" for j in range(WIDTH)]],
        )


def learn_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors (BUCKETS x WIDTH) of all texts; frequent words weigh less."""
    columns = [f"d{j}" for j in range(WIDTH)]
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        _count_neighbours, "bucket int, n long, " + ", ".join(f"{c} long" for c in columns)
    )
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, WIDTH), np.float32)
    if sums.num_rows:
        at, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy().astype(np.float64)
        raw = np.stack([sums.column(c).to_numpy() for c in columns], 1).astype(np.float64)
        size = np.sqrt((raw**2).sum(1))
        raw *= (1e-3 / (1e-3 + n / n.sum()) / np.where(size > 0, size, 1.0))[:, None]
        vectors[at] = raw
    return vectors


def _pool(shared):
    def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, WIDTH), np.float32)
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            out[full] = np.add.reduceat(values, first[full], axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch, w in _cut(batches, 1 << 19):
            x = vectors[_bucket(w.code)]
            n = np.diff(w.first)
            pairs = np.zeros_like(x)
            if len(x) > 1:
                text = w.doc
                pairs[1:] = x[1:] * x[:-1]
                pairs[1:][text[1:] != text[:-1]] = 0
            per = np.maximum(n, 1)[:, None]
            features = np.concatenate([sums(x, w.first) / per, sums(pairs, w.first) * 4 / per, np.log1p(n)[:, None]], 1).astype(np.float32)
            yield batch, features

    return run


class Network:
    """Two layers with a tanh between them; ``score`` divides the logit by the temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss; every fifth row is kept for the temperature.

    Without rows the network answers one half; with one class, that class's smoothed share.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    net = Network(x[~held].mean(0), x[~held].std(0) + 1e-6, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    train, target = (x[~held] - net.mean) / net.scale, y[~held]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for at in range(0, len(order), 256):
            a, t = train[order[at : at + 256]], target[order[at : at + 256]]
            h = np.tanh(a @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t) / len(t)
            back = np.outer(err, params[2]) * (1 - h**2)
            grads = [a.T @ back + decay * params[0], back.sum(0), h.T @ err + decay * params[2], err.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if held.any():
        z, t = net.logit(x[held]), y[held]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 200))
        loss = [np.mean(np.logaddexp(0, z / c) - t * z / c) for c in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def _features_of(shared):
    pool = _pool(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in pool(batches):
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), flat], names=["id", "label", "x"])

    return run


def _score(shared, net: Network):
    pool = _pool(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in pool(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(net.score(x.astype(np.float64)), pa.float64())], names=["id", "score"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, score): the probability that a text has label 1.

    ``learn`` says which rows of ``labels`` may be learned from; at most ``train_rows`` of
    them, the first in hash order of the id, train the network.  The word vectors use the
    texts of all documents, no labels.  Scores look at the text alone.

    Null and empty texts pool to zeros and get the score of that.  Null labels and ids teach
    nothing; of rows that repeat an id one teaches.  Without labels every score is one half.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn_vectors(docs, text))
    picked = (
        labels.filter(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    known = rows.join(F.broadcast(picked), "id").mapInArrow(_features_of(shared), f"id {kind}, label int, x array<float>")
    table = known.groupBy("id").agg(F.min(F.struct("label", "x")).alias("s")).select("id", "s.*").toArrow()  # train_rows at most
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    width = 2 * WIDTH + 1
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)[order] if table.num_rows else np.zeros((0, width))
    net = train_network(x, table.column("label").to_numpy()[order])
    return rows.mapInArrow(_score(shared, net), f"id {kind}, score double")
