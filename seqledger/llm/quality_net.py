"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token has a fixed sparse index vector. Its context vector is the sum of the index vectors of
its neighbours over the whole corpus, in a table of hashed tokens. A document is the mean of its
tokens' context and index vectors and its length; a two-layer network, fitted with numpy on a
bounded sample of labelled documents, turns it into a logit, and a temperature fitted on documents
kept aside turns the logit into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, chunks, mix, word_hashes

#: Hashed tokens, dimensions, non-zeros of an index vector, and neighbours to each side.
BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 2, 2
#: Labelled documents of the sample, and the network.
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 12_000, 24, 40, 128, 0.01, 1e-4
#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 others. A token is a run of one kind.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[ord("0") : ord("9") + 1] = 2
KIND[ord("a") : ord("z") + 1] = 1
KIND[0x80:] = 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, first token of each row)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    kind = KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[[0, -1]] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    buckets = (word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the non-zeros of every bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors per bucket, once for each task."""
    dims, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    times = np.zeros(BUCKETS)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            tokens, first = _tokens(data, offsets)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            times += np.bincount(tokens, minlength=BUCKETS)
            for far in range(1, REACH + 1):
                near = np.flatnonzero(row[far:] == row[:-far])
                for a, b in ((tokens[near], tokens[near + far]), (tokens[near + far], tokens[near])):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIM + dims[b, j], signs[b, j], BUCKETS * DIM)
    seen = np.flatnonzero(times)
    total = total.reshape(BUCKETS, DIM)[seen]
    arrays = [pa.array(seen), pa.array(times[seen]), *[pa.array(np.ascontiguousarray(total[:, d])) for d in range(DIM)]]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "times", *[f"d{i}" for i in range(DIM)]])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of unit word vectors, context and index part side by side; BUCKETS rows at any size."""
    dims = [f"d{i}" for i in range(DIM)]
    sums = texts.select("text").mapInArrow(_contexts, "bucket long, times double, " + ", ".join(f"{d} double" for d in dims))
    sums = sums.groupBy("bucket").agg(F.sum("times").alias("times"), F.array(*[F.sum(d) for d in dims]).alias("sums")).collect()
    context, times = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for r in sums:
        times[r["bucket"]] = r["times"]
        context[r["bucket"]] = r["sums"]
    # What all words share says nothing: it is taken off before the vectors get unit length.
    context -= np.outer(times, context.sum(axis=0) / max(times.sum(), 1))
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    index = np.zeros((BUCKETS, DIM))
    where, signs = index_vectors()
    for j in range(NONZERO):
        np.add.at(index, (np.arange(BUCKETS), where[:, j]), signs[:, j] / np.sqrt(NONZERO))
    return np.hstack([context, index]).astype(np.float32)


def pooled(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """A row of 2 * DIM + 1 numbers for each text; zeros without tokens."""
    out = np.zeros((len(column), vectors.shape[1] + 1))
    for low, high, data, offsets in chunks(column, 1 << 20):
        tokens, first = _tokens(data, offsets)
        n = np.diff(first)
        full = np.flatnonzero(n)
        if len(full):
            sums = np.add.reduceat(vectors[tokens], first[:-1][full], axis=0, dtype=np.float64)
            out[low + full, :-1] = sums / n[full, None]
        out[low:high, -1] = np.log1p(n)
    return out


class Network:
    """Two dense layers over standardised inputs, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0
        z = (x - self.mean) / self.scale
        fit = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
        parts = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(EPOCHS):
            order = rng.permutation(fit)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                h = np.tanh(z[rows] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))
                d = (p - y[rows]) / len(rows)
                back = np.outer(d, self.w2) * (1 - h * h)
                grads = [z[rows].T @ back + DECAY * self.w1, back.sum(axis=0), h.T @ d + DECAY * self.w2, np.array([d.sum()])]
                step += 1
                for i, (p_, g) in enumerate(zip(parts, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p_ -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        held = np.flatnonzero(aside) if aside.any() else fit
        logits = self.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    score is the probability that the quality label is 1; predicted is 1 from ``least`` on. held_out:
    crc32 of the doc_id as text is 2 modulo 4; the labels of those are not learned from. Learns from
    the SAMPLE labelled documents of the least hash of their id; a fifth of them sets the temperature.
    Word vectors come from all texts. Where the labels are of one kind, or there are none, the score is
    the share of 1 (0.5 without labels).

    A null or empty text is a document without tokens and gets the network's score for it. A row
    without doc_id is scored, neither learned from nor held out. Repeated rows give a row each; of
    several labels of a document the least counts. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").filter(fold != 2)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("order", F.xxhash64(F.lit(2), "doc_id"))
    # At most SAMPLE rows, so small enough to send to all tasks.
    marks = marks.orderBy("order", "doc_id").limit(SAMPLE)
    vectors = context.broadcast(word_vectors(rows))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(vectors.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["order", "quality", "x"])

    known = rows.join(F.broadcast(marks), "doc_id").select("order", "quality", "text").mapInArrow(pool, "order long, quality int, x array<double>")
    known = sorted(known.groupBy("order").agg(F.min("quality").alias("y"), F.min("x").alias("x")).collect(), key=lambda r: r["order"])
    y = np.array([r["y"] for r in known], np.float64)
    network, share = None, float(y.mean()) if len(y) else 0.5
    if len(y) and 0 < share < 1:
        network = Network(np.array([r["x"] for r in known]), y, np.array([r["order"] % 5 == 0 for r in known]))
    fitted = context.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = fitted.value
            s = net.scores(pooled(vectors.value, batch.column(2))) if net else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    out = rows.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
