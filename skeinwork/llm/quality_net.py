"""Quality classifier: a byte-level convolutional network in numpy.

Filters of eight bytes slide over the whole document, four bytes at a time, so
every byte is seen by two windows.  Rectified responses are averaged over chunks
of 64 windows that overlap by half, max-pooled over all chunks of the document,
and combined into one probability.  Because inputs are bytes, a filter is a sum of
table rows; scoring uses tables over byte pairs.  The fit is Adam on the log loss
over a bounded sample of labelled documents.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import fold_of, held_out, slices, string_buffers

FILTERS, WIDTH, STRIDE = 16, 8, 4
#: Windows in half a chunk.
HALF = 32
#: Labelled documents of each class that are learnt from, at most (the bound of the fit).
DOCUMENTS_PER_CLASS = 600
EPOCHS, BATCH, RATE, SEED = 16, 32, 0.01, 7
THRESHOLD = 0.5


@dataclasses.dataclass
class Windows:
    """Zero-padded bytes, and how windows, half chunks and documents lie in each other."""

    pairs: np.ndarray
    """(windows, WIDTH / 2): two bytes each"""
    half_at: np.ndarray
    """first window of each half chunk"""
    half_n: np.ndarray
    doc_at: np.ndarray
    """first half chunk of each document that has a byte"""
    docs: np.ndarray
    """those documents' rows"""

    @classmethod
    def of(cls, off: np.ndarray, data: np.ndarray) -> Windows:
        size = np.diff(off)
        docs = np.flatnonzero(size)
        size = size[docs]
        n = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
        first = np.concatenate([[0], np.cumsum(n)])
        # a document takes n * STRIDE bytes and WIDTH - STRIDE more at its end
        room = n * STRIDE + WIDTH - STRIDE
        at = np.concatenate([[0], np.cumsum(room)])
        padded = np.zeros(at[-1], np.uint8)
        padded[np.arange(size.sum()) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] = data
        start = np.arange(first[-1]) * STRIDE + np.repeat(at[:-1] - first[:-1] * STRIDE, n)
        two = padded[:-1].astype(np.int32) << 8 | padded[1:] if len(padded) else np.zeros(0, np.int32)
        pairs = np.stack([two[start + k] for k in range(0, WIDTH, 2)], axis=1) if len(start) else np.zeros((0, WIDTH // 2), np.int32)
        halves = -(-n // HALF)
        doc_at = np.concatenate([[0], np.cumsum(halves)])
        half_at = np.repeat(first[:-1], halves) + (np.arange(doc_at[-1]) - np.repeat(doc_at[:-1], halves)) * HALF
        half_n = np.diff(np.append(half_at, first[-1]))
        return cls(pairs, half_at, half_n, doc_at[:-1], docs)

    def chunk_last(self) -> np.ndarray:
        """Of each half chunk: whether a chunk begins there (all but a document's last one, unless it is the only one); whether another half follows."""
        last = np.zeros(len(self.half_at), bool)
        last[np.append(self.doc_at[1:], len(self.half_at)) - 1] = True
        return last


@dataclasses.dataclass
class Net:
    bytes_: np.ndarray
    """(WIDTH, 256, FILTERS)"""
    bias: np.ndarray
    out: np.ndarray
    """(FILTERS + 1): weights and intercept"""

    def tables(self) -> list[np.ndarray]:
        return [(self.bytes_[k][:, None, :] + self.bytes_[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def pooled(self, w: Windows, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled chunk means of the documents that have bytes; the half chunk that each maximum begins at; rectified responses."""
        if tables is None:
            a = sum(self.bytes_[k][w.pairs[:, k // 2] >> 8 if k % 2 == 0 else w.pairs[:, k // 2] & 255] for k in range(WIDTH)) + self.bias
        else:
            a = tables[0][w.pairs[:, 0]]
            for k in range(1, WIDTH // 2):
                a += tables[k][w.pairs[:, k]]
            a += self.bias
        np.maximum(a, 0, out=a)
        half = np.add.reduceat(a, w.half_at, axis=0)
        last = w.chunk_last()
        total, n = half.copy(), w.half_n.astype(np.float32)
        total[:-1][~last[:-1]] += half[1:][~last[:-1]]
        n = n + np.append(n[1:], 0) * ~last
        mean = total / n[:, None]
        only = np.zeros(len(last), bool)
        only[w.doc_at] = True
        mean[last & ~only] = -1.0
        z = np.maximum.reduceat(mean, w.doc_at, axis=0)
        return z, mean, a

    def scores(self, off: np.ndarray, data: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Probability of each row; a row without bytes has responses of 0."""
        logit = np.full(len(off) - 1, self.out[-1], np.float64)
        w = Windows.of(off, data)
        if len(w.docs):
            z, _, _ = self.pooled(w, tables)
            logit[w.docs] += z @ self.out[:-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradient(net: Net, w: Windows, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss; only the windows of the chunks that won the maxima take part."""
    z, mean, a = net.pooled(w)
    p = 1 / (1 + np.exp(-np.clip(z @ net.out[:-1] + net.out[-1], -30, 30)))
    g = (p - y) * weight
    g_out = np.append(z.T @ g, g.sum())
    ends = np.append(w.doc_at[1:], len(w.half_at))
    g_bytes, g_bias = np.zeros(net.bytes_.size), np.zeros(FILTERS)
    f = np.arange(FILTERS)
    at_all, f_all, v_all = [], [], []
    total = len(a)
    for d in range(len(w.docs)):
        lo, hi = w.doc_at[d], ends[d]
        k = lo + mean[lo:hi].argmax(axis=0)
        end = np.minimum(k + 2, hi)
        first, to = w.half_at[k], np.where(end < len(w.half_at), w.half_at[np.minimum(end, len(w.half_at) - 1)], total)
        n = to - first
        v = g[d] * net.out[:-1] / n
        at = np.arange(2 * HALF)[:, None] + first[None, :]
        ok = at < to[None, :]
        at = np.where(ok, at, 0)
        ok &= a[at, f[None, :]] > 0
        r, c = np.nonzero(ok)
        at_all.append(at[r, c]), f_all.append(c), v_all.append(v[c])
    at, c, v = np.concatenate(at_all), np.concatenate(f_all), np.concatenate(v_all)
    g_bias += np.bincount(c, v, minlength=FILTERS)
    for k in range(WIDTH):
        b = w.pairs[at, k // 2] >> 8 if k % 2 == 0 else w.pairs[at, k // 2] & 255
        g_bytes += np.bincount((k * 256 + b) * FILTERS + c, v, minlength=net.bytes_.size)
    return [g_bytes.reshape(net.bytes_.shape), g_bias, g_out]


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Net:
    """A net from texts and labels 0/1; classes weigh the same.  With one class only its net says that class everywhere; with none, 0.5."""
    rng = np.random.default_rng(SEED)
    net = Net(rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(rng.choice([-1.0, 1.0], FILTERS), 0).astype(np.float32))
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    keep = [k for k, r in enumerate(raw) if len(r)]
    y = np.array([labels[k] for k in keep])
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        net.out[-1] = 0 if not len(y) else 20 if y[0] else -20
        return net
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    params = [net.bytes_, net.bias, net.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(keep))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            parts = [raw[keep[k]] for k in rows]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            step += 1
            rate = RATE * min(1.0, step / 20)
            for p, (m, s), g in zip(params, moments, gradient(net, Windows.of(off, np.concatenate(parts)), y[rows], share[rows] / len(rows)), strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, most: int = DOCUMENTS_PER_CLASS) -> Net:
    """Learn from labelled documents outside the held-out fold, ``most`` of each class by a hash of the id, whole texts.

    Null texts, ids and labels are left out; of several labels of a document the least counts.
    """
    marks = labels.where(F.col("quality").isNotNull() & (fold_of(F.col("doc_id")) != 1)).groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("quality"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id").join(marks, "doc_id")
    chosen = {}
    for c in (0, 1):
        chosen |= {r["doc_id"]: c for r in rows.where(F.col("quality") == c).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    texts: dict[int, str] = {}
    if chosen:
        for r in docs.where(F.col("doc_id").isin(list(chosen)) & F.col("text").isNotNull()).select("doc_id", "text").toLocalIterator():
            texts.setdefault(r["doc_id"], r["text"])
    ids = sorted(texts)
    return learn([texts[k] for k in ids], [chosen[k] for k in ids])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.  A null or empty text gets the score of no response at all."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value.tables()
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                s = model.value.scores(*string_buffers(b.column("text")), tables)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, *, most: int = DOCUMENTS_PER_CLASS) -> DataFrame:
    return score(docs, fit(docs, labels, most=most))
