"""Quality scores from random-indexing word vectors and a small neural network.

Every word (hashed into a bounded number of buckets) has a sparse random index vector; its context
vector is the sum of the index vectors of the words around it in a training sample.  A document is
the mean of its words' vectors.  A two-layer network in NumPy, trained on labelled documents, gives
a logit, and a temperature fitted on documents it was not trained on calibrates the probability.

Defined results: null, empty and blank texts have the zero vector and its score; labels other than
0 and 1 and labels of absent documents are not learned from; if one of the classes has no example,
every score is the share of label 1 (0.5 without labels); repeated rows are rows of their own;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, small_batches, written
from .langid import bounded_sample, held_out
from .textscan import LOWER, U, class_table, parts, pieces, slices, text_bytes, word_hashes

#: Labelled documents of each class that the model is fitted on, about: the bound of the sample.
TRAIN_DOCS = 1500
BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 64, 6, 2
#: Buckets of words in capitals, of words that repeat the word before them, and of numbers.
CAPITALS, REPEATED, NUMBER, OTHERS = 0, 1, 2, 3
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-4

#: Bytes of text that are scored at once.
SLICE = 1 << 18

_UPPER = class_table(range(0x41, 0x5B))
_SMALL = class_table(range(0x61, 0x7B))
_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[_UPPER | _SMALL | class_table(range(0x80, 0x100))] = 1
_KIND[0x30:0x3A] = 2


def buckets(data: np.ndarray, bounds: np.ndarray, before: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words (runs of letters, digits or signs), and each text's first word.  For a
    text in pieces, `before` holds the hash of the last word of letters so far, and gets the new one."""
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(data))
    real = kind[heads] > 0
    starts, ends = heads[real], ends[real]
    own = kind[starts]
    h = word_hashes(LOWER[data], starts, ends)
    first = np.searchsorted(starts, bounds)
    out = (h % U(BUCKETS - OTHERS)).astype(np.int64) + OTHERS
    word = np.flatnonzero(own == 1)
    doc = np.searchsorted(bounds, starts[word], "right")
    same = np.zeros(len(word), bool)
    same[1:] = (h[word][1:] == h[word][:-1]) & (doc[1:] == doc[:-1])
    if before is not None and len(word):
        same[0] = before[:1] == [h[word[0]]]
        before[:] = [h[word[-1]]]
    out[word[same]] = REPEATED
    big, small = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _SMALL))
    out[(big[ends] - big[starts] > 1) & (small[ends] == small[starts]) & (own == 1)] = CAPITALS
    out[own == 2] = NUMBER
    return out, first


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    r = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    at = r.random((BUCKETS, DIMENSIONS)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, r.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def contexts(documents: Iterator[np.ndarray]) -> np.ndarray:
    """For each bucket the sum of the index vectors of the words around it; whole numbers."""
    index = index_vectors()
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for b in documents:
        near = np.zeros((len(b), DIMENSIONS), np.float32)
        for k in range(1, min(REACH, len(b) - 1) + 1):
            near[k:] += index[b[:-k]]
            near[:-k] += index[b[k:]]
        order = np.argsort(b, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(b[order]) > 0)) if len(b) else np.zeros(0, int)
        if len(heads):
            out[b[order][heads]] += np.add.reduceat(near[order], heads, dtype=np.float64).astype(np.int64)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Context vectors of unit length plus index vectors of unit length."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(norm, 1e-9) + index_vectors() / np.sqrt(NONZERO)).astype(np.float32)


def pooled(vectors: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean word vector of each text; zeros without words."""
    n = np.diff(first)
    out = np.zeros((len(n), DIMENSIONS))
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(vectors[b], first[:-1][full]) / n[full, None]
    return out


def long_mean(vectors: np.ndarray, data: np.ndarray, piece: int = SLICE) -> np.ndarray:
    """The mean word vector of one long text, by counting its buckets a piece at a time."""
    counts, before = np.zeros(BUCKETS, np.int64), []
    for part in pieces(data, _KIND > 0, piece):
        counts += np.bincount(buckets(part, np.array([0, len(part)]), before)[0], minlength=BUCKETS)
    return (counts / max(1, counts.sum())) @ vectors


class Network:
    """Two layers, trained by Adam on the whole sample with class weights, then calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float):
        r = np.random.Generator(np.random.PCG64(11))
        self.constant = None if 0 < y.mean() < 1 else float(prior)
        if self.constant is not None:
            return
        order = r.permutation(len(y))
        fit, rest = order[len(y) // 5 :], order[: len(y) // 5]
        if len(set(y[rest])) < 2 or len(set(y[fit])) < 2:
            fit = rest = order
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        # Rows count so that label 1 has the share `prior`, as among all labels.
        w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        z, t, wf = (x[fit] - self.mean) / self.scale, y[fit], w[fit] / w[fit].sum()
        for step in range(1, EPOCHS + 1):
            hidden = np.maximum(z @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - t) * wf
            back = np.outer(g, p[2]) * (hidden > 0)
            for k, grad in enumerate((z.T @ back + DECAY * p[0], back.sum(0), hidden.T @ g + DECAY * p[2], g.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = p
        logit, t, wr = self.logit(x[rest]), y[rest], w[rest]
        losses = {s: float((wr * (np.logaddexp(0, logit / s) - t * logit / s)).sum()) for s in np.geomspace(0.25, 8, 41)}
        self.temperature = min(losses, key=losses.get)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.layers[0] + self.layers[1], 0) @ self.layers[2] + self.layers[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -700, 700)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for i, j in slices(bounds, SLICE):
            b, first = buckets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays(
                [batch.slice(i, j - i).column("label"), pa.array([b[a:z].astype(np.int32) for a, z in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int32()))], names=["label", "buckets"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def documents() -> Iterator[np.ndarray]:
        for batch in batches:
            for b in batch.column("buckets"):
                yield np.array(b.as_py(), np.int64)

    yield pa.RecordBatch.from_arrays([pa.array([contexts(documents()).astype("<i8").tobytes()], pa.binary())], names=["sums"])


def _pool(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [(np.bincount(np.array(b.as_py(), np.int64), minlength=BUCKETS) / max(1, len(b))) @ shared.value.astype(float) for b in batch.column("buckets")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["label", "x"])


#: Partitions whose sums of contexts (8 MB each) come to the driver, one after another.
PARTS = 16


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAIN_DOCS) -> tuple[np.ndarray, Network]:
    """Word vectors and network of a bounded sample of the labelled documents that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    chosen = written(bounded_sample(known, "label", F.col("id"), bound), "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        sample = written(join_checked(rows, chosen, ["id"], "inner").select("id", "text", "label").mapInArrow(_buckets, "label int, buckets array<int>"), "sample")
        # No text comes to the driver: sums over the vocabulary, then one vector for each sampled document.
        total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for r in sample.coalesce(PARTS).mapInArrow(_contexts, "sums binary").toLocalIterator():
            total += np.frombuffer(r.sums, "<i8").reshape(BUCKETS, DIMENSIONS)
        vectors = word_vectors(total)
        shared = docs.sparkSession.sparkContext.broadcast(vectors)
        rows = sample.mapInArrow(partial(_pool, shared), "label int, x array<double>").collect()
    got = sorted(((r.label, tuple(r.x)) for r in rows))
    x = np.array([v for _, v in got]).reshape(-1, DIMENSIONS)
    return vectors, Network(x, np.array([y for y, _ in got] or [0.0]), prior)


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors, network = shared.value
    for batch in parts(batches):
        data, bounds = text_bytes(batch.column("text"))
        scores = [np.zeros(0)]
        for i, j in slices(bounds, SLICE):
            own = data[bounds[i] : bounds[j]]
            if j == i + 1 and len(own) > SLICE:
                scores.append(network.probability(long_mean(vectors, own)[None]))
                continue
            b, first = buckets(own, bounds[i : j + 1] - bounds[i])
            scores.append(network.probability(pooled(vectors, b, first)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(np.concatenate(scores))], names=["id", "held_out", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, shared), "id bigint, held_out boolean, score double")
