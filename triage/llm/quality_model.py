"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Random indexing: every word has an index vector with two entries of +1 or -1 at
places given by its hash; a word's vector is the sum of the index vectors of
the words next to it (two on either side), over all texts of the corpus.  Words
are hashed into 2^14 buckets, so the vectors are a table of fixed size, summed
by one aggregate.  A document is the mean and spread of its words' vectors with
some shares of its characters and words.

The network (one hidden layer) is fitted on the driver on at most
``sample_docs`` labelled documents (the first in the order of a hash of their
``doc_id``); it never sees rows whose crc32(doc_id) mod 4 is 2.  A fifth of the
sample is held back to choose the temperature by which the logits are divided,
so that scores are calibrated probabilities; with so few labels that the fifth or the
rest lacks one of them, all rows serve both ends and the temperature is 1 at least.
Weights decay the more, the fewer labels there are.  Scoring covers all whole texts.

Edge cases: null and empty texts are scored by a vector of zeros; of several
labels of a document the lowest counts, of several texts that of the lowest hash; if the labels are all equal, or none is
there, every score is their share of 1 with ten observations added of which nine
are 1; an empty table gives no rows.  Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, slices, words_of

BITS, DIMS, REACH = 14, 64, 2
BUCKETS = 1 << BITS
HIDDEN = 32
SAMPLE_DOCS = 20_000


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two entries of each bucket's index vector."""
    h = mix(np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64)).reshape(2, BUCKETS)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of index vectors, a row for each bucket met."""
    places, signs = _index_vectors()
    sums, met = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        words = words_of(batch["text"])
        bucket = _buckets(words.hashes)
        met += np.bincount(bucket, minlength=BUCKETS)
        text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        for reach in range(1, REACH + 1):
            same = text[reach:] == text[:-reach]
            left, right = bucket[:-reach][same], bucket[reach:][same]
            for one, other in ((left, right), (right, left)):
                for p, s in zip(places, signs):
                    sums += np.bincount(one * DIMS + p[other], s[other], BUCKETS * DIMS)
    rows = np.flatnonzero(met)
    table = sums.reshape(BUCKETS, DIMS)[rows].astype(np.int64)
    names = ["bucket", "met", *(f"v{k}" for k in range(DIMS))]
    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(met[rows]), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(DIMS))], names=names)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, centred, with their squares beside them (BUCKETS x 2 DIMS, a fixed size)."""
    columns = ["met", *(f"v{k}" for k in range(DIMS))]
    schema = ", ".join(f"{c} long" for c in ["bucket", *columns])
    found = docs.select("text").mapInArrow(_contexts, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    vectors = np.zeros((BUCKETS, DIMS))
    if found.num_rows:
        at = found["bucket"].to_numpy()
        met = found["met"].to_numpy()
        raw = np.stack([found[f"v{k}"].to_numpy() for k in range(DIMS)], axis=1) / met[:, None]
        raw -= (raw * met[:, None]).sum(axis=0) / met.sum()
        vectors[at] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return np.concatenate([vectors, vectors**2], axis=1).astype(np.float32)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values first[k] to first[k + 1]."""
    out, full = np.zeros(len(first) - 1, np.int64), np.diff(first) > 0
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], dtype=np.int64)
    return out


def document_features(words: Words, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its word vectors, and shares; ``vectors`` holds them and their squares."""
    first, texts = words.first, len(words.first) - 1
    n = np.maximum(np.diff(first), 1)
    bucket = _buckets(words.hashes)
    text = np.repeat(np.arange(texts), np.diff(first))
    key = np.sort(text * BUCKETS + bucket)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    count, key = np.diff(np.append(at, len(key))).astype(np.float32), key[at]
    bounds = np.searchsorted(key, np.arange(texts + 1) * BUCKETS)
    distinct = np.diff(bounds)
    pooled = np.zeros((texts, 2 * DIMS), np.float32)
    own = key % BUCKETS
    for k in np.flatnonzero(distinct):  # one product a text, in the processor's cache
        a, b = bounds[k], bounds[k + 1]
        pooled[k] = count[a:b] @ vectors[own[a:b]]
    pooled /= n[:, None]
    mean = pooled[:, :DIMS]
    spread = np.sqrt(np.maximum(pooled[:, DIMS:] - mean**2, 0))
    again = np.zeros(len(bucket), np.uint8)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    size = np.maximum(np.diff(words.text_starts), 1)
    shares = [_sums(kind[words.data].view(np.uint8), words.text_starts) / size for kind in (SYMBOL, UPPER, DIGIT, BREAK, MARK)]
    shape = np.stack([np.log1p(np.diff(first)), np.log1p(np.diff(words.text_starts)), size / n, distinct / n, _sums(again, first) / n, *shares], axis=1)
    return np.concatenate([mean, spread, shape], axis=1).astype(np.float32)


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOL, UPPER, DIGIT, BREAK, MARK = _bytes(b"#*$%&|<>"), _bytes(bytes(range(65, 91))), _bytes(b"0123456789"), _bytes(b"\n"), _bytes(b"!?.,;:")


class Network:
    """Two layers in numpy: standardised features, tanh units, a logit over a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = 40):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        x, y = self._standard(features), labels.astype(np.float64)
        held, decay = np.arange(len(y)) % 5 == 0, max(1e-4, 1 / len(y))
        few = len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2
        if few:
            held[:] = True
        a, b = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), rng.normal(0, 0.1, HIDDEN)
        params = [a, np.zeros(HIDDEN), b, np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        train, step = np.flatnonzero(~held | few), 0
        self.params, self.temperature = params, 1.0
        best, kept = np.inf, [p.copy() for p in params]
        for _ in range(epochs):
            rng.shuffle(train)
            for low in range(0, len(train), 256):
                rows = train[low : low + 256]
                xs, step = x[rows], step + 1
                units = np.tanh(xs @ params[0] + params[1])
                error = (1 / (1 + np.exp(-(units @ params[2] + params[3][0]))) - y[rows]) / len(rows)
                back = error[:, None] * params[2] * (1 - units**2)
                grads = [xs.T @ back + decay * params[0], back.sum(axis=0), units.T @ error + decay * params[2], np.array([error.sum()])]
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(self.logits(features[held]), y[held], 1.0)
            if loss < best:
                best, kept = loss, [p.copy() for p in params]
        self.params = kept
        logits = self.logits(features[held])
        self.temperature = min(np.exp(np.linspace(0 if few else -1.5, 2.5, 81)), key=lambda t: self._loss(logits, y[held], t))

    def _standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8).astype(np.float64)

    def logits(self, features: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.tanh(self._standard(features) @ a + b) @ c + d[0]

    @staticmethod
    def _loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
        z = logits / temperature
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(features) / self.temperature))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return np.full(len(features), self.share)


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def _train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_docs: int):
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = document_features(words_of(batch["text"]), vectors)
            yield pa.RecordBatch.from_arrays([batch["__quality"], pa.array(list(found), pa.list_(pa.float32()))], names=["quality", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    known = rows.join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    once = known.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("__quality").alias("__quality"))
    found = once.select("text", "__quality").mapInArrow(features, "quality int, features array<float>").toArrow()
    y = found["quality"].to_numpy() if found.num_rows else np.zeros(0, int)
    good = int((y == 1).sum())
    if min(good, len(y) - good) == 0:
        return Constant((good + 9) / (len(y) + 10))
    x = found["features"].combine_chunks()
    x = x.values.to_numpy().reshape(len(y), -1)
    order = np.lexsort((x[:, 0], x[:, 1]))  # the same model whatever the order of rows
    return Network(x[order], (y == 1)[order])


def score(docs: DataFrame, labels: DataFrame, columns: Sequence[str], sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``row`` (a struct of ``columns``) and ``score``, the calibrated probability of label 1, of every document."""
    vectors = word_vectors(docs)
    model = _train(docs, labels, vectors, sample_docs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model(document_features(words_of(batch["text"]), vectors))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    return rows.mapInArrow(scored, f"row {rows.schema['row'].dataType.simpleString()}, score double")
