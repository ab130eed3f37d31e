"""Quality classifier on supervised subword embeddings.

Each word and each of its character n-grams hashes to a learnt vector; a text is
the average of all its features' vectors, a softmax layer reads it. Vectors and
layer are trained together by stochastic gradient descent in numpy.

Scoring never builds the average: the layer is linear, so each feature adds a
fixed number to the log-odds and a word's share is the sum over its features,
worked out once for each different word of a chunk.

Training takes a bounded sample of the labelled rows (train_rows, by hash of the id), whole texts;
scoring takes every row.

Results. Null and empty texts have no features; their score is that of the layer's bias alone.
Repeated rows have equal scores. Labels that are null are not learnt from, several labels of one
document count as their mean, and without any labelled row every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
TRAIN_ROWS = 6000
EPOCHS = 4
RATE = 0.5
SEED = 7


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the given words' features, and n+1 offsets of each word's ones."""
    hashes = tb.SpanHash(data)
    n_words = len(starts)
    found = [hashes.of(starts, ends)]
    of = [np.arange(n_words)]
    for n in GRAMS:
        counts = np.maximum(ends - starts - n + 1, 0)
        own = np.repeat(np.arange(n_words), counts)
        first = np.zeros(n_words + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        at = np.arange(first[-1]) - first[own] + starts[own]
        # A gram at a word's edge is another feature than the same one inside.
        edge = (at == starts[own]).astype(np.uint64) + (at + n == ends[own]).astype(np.uint64) * np.uint64(2)
        found.append(tb.mix(hashes.of(at, at + n) + (edge + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        of.append(own)
    codes, owners = np.concatenate(found) >> np.uint64(47), np.concatenate(of)
    order = np.argsort(owners, kind="stable")
    offsets = np.zeros(n_words + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=n_words), out=offsets[1:])
    return codes[order].astype(np.int64), offsets


@dataclass
class Model:
    """What scoring needs: a number for each bucket and the bias, both in log-odds."""

    gains: np.ndarray
    bias: float


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit vectors and layer on whole texts; equal input gives an equal model."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    rows = []
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = tb.words(tb.Chunk(None, data, np.array([0, len(data)])))
        codes, counts = np.unique(features(data, starts, ends)[0], return_counts=True)
        rows.append((codes, (counts / max(counts.sum(), 1)).astype(np.float32)))
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
    weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)  # both classes count alike
    steps, done = max(epochs * len(rows), 1), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            codes, part = rows[k]
            own = vectors[codes]
            mean = part @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]] * rate * (1 - done / steps)
            back = layer @ p
            layer -= np.outer(mean, p)
            bias -= 0.1 * p
            # Each feature takes the text's gradient in proportion to its number, scaled to the largest.
            vectors[codes] = own - np.outer(part / part.max(), back) if len(part) else own
            done += 1
    difference = layer[:, 1] - layer[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def score(chunk: tb.Chunk, model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    starts, ends, own = tb.words(chunk)
    codes = tb.SpanHash(chunk.data).of(starts, ends)
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    buckets, offsets = features(chunk.data, starts[first], ends[first])
    sums = tb.per_text(model.gains[buckets].astype(np.float64), offsets)[which]
    total, count = tb.per_text(sums, own), tb.per_text(np.diff(offsets)[which], own)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Train on a sample of about train_rows labelled documents.

    The sample is chosen on the labels alone, so its size bounds what is broadcast and collected.
    """
    labelled = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    n = labelled.count()
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    bound = int(min(1.0, train_rows / n) * (1 << 31))
    sample = labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < bound)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(sample), key)
    got = sorted(((r[0], r[1].encode("utf-8"), r[2]) for r in rows.select(key, "__text", "__label").toLocalIterator()), key=lambda r: (r[0], r[1]))
    return train([r[1] for r in got], np.array([r[2] for r in got], np.int64))


def classify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str], threshold: float = 0.7) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (1 from the threshold on) to the kept columns."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = rows.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a MB, by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text", 2 << 20):
            p = score(chunk, shared.value)
            columns = [chunk.batch.column(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[f.name for f in fields] + ["score", "predicted"])

    return tb.through_python(rows, run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "score double, predicted int")


def remainder(key: str, by: int):
    """crc32 of the id as text modulo a number; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by
