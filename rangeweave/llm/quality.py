"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, their character n-grams and its word
pairs (all hashed to ``BUCKETS`` rows); a softmax over two classes follows. Numpy stochastic gradient
descent trains on a bounded labelled sample (``ROWS`` documents). Because the output is linear in the
average, a row's vector enters a score only through its product with the output weights; that product
(BUCKETS floats, 1 MB) is what is broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from .common import MEMO_BYTES, small_batches, text_of
from .learn import labelled_sample

BUCKETS = 1 << 18
DIM = 8
NGRAM = (3, 5)
EPOCHS = 4
RATE = 0.5
#: Documents of the training sample, at most.
ROWS = 4_000
#: Words a worker remembers before it starts anew.
MEMO = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 18)


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(31))) * _MIX >> _SHIFT).astype(np.int32)


def ngrams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram that begins at each byte of <w1><w2>..., and whether it ends
    within its word."""
    x = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(len(x))
    h = np.zeros(len(x), dtype=np.uint64)
    for n in range(1, NGRAM[1] + 1):
        with np.errstate(over="ignore"):
            h[: len(x) - n + 1] = h[: len(x) - n + 1] * _MIX + x[n - 1 :] + np.uint64(n)
        if n >= NGRAM[0]:
            yield _bucket(h), left >= n


def keys_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def pairs(keys: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, in order: hashed from both words' 64-bit keys like any other n-gram."""
    with np.errstate(over="ignore"):
        return _bucket((keys[:-1] * _MIX) ^ keys[1:])


class Scorer:
    """Scores batches of texts. What a word adds is computed once, for all new words of a batch together."""

    def __init__(self, model: Model):
        self.model, self.slot, self.held = model, {}, 0
        self.sums, self.counts, self.keys = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.uint64)

    def _learn(self, new: list[bytes]) -> None:
        weights, keys = self.model.weights, keys_of(new)
        size = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 2
        begin = np.cumsum(size) - size
        sums, counts = weights[_bucket(keys)], np.ones(len(new))
        for ids, ok in ngrams(new):
            sums = sums + np.add.reduceat(np.where(ok, weights[ids], 0.0), begin)
            counts += np.add.reduceat(ok, begin, dtype=np.float64)
        self.held += sum(map(len, new))
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
        self.sums, self.counts, self.keys = (np.concatenate(p) for p in ((self.sums, sums), (self.counts, counts), (self.keys, keys)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1, higher for class 1; a text without words has the prior's score."""
        split = [(t or "").encode().split() for t in texts]
        words = [w for s in split for w in s]
        z = np.full(len(texts), self.model.bias)
        if words:
            if len(self.slot) > MEMO or self.held > MEMO * MEMO_BYTES:
                self.__init__(self.model)
            if new := list(set(words).difference(self.slot)):
                self._learn(new)
            at = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
            n = np.array([len(s) for s in split])
            there = np.nonzero(n)[0]
            begin = (np.cumsum(n) - n)[there]
            both = self.model.weights[pairs(self.keys[at])]
            both = np.append(both, 0.0)
            both[(np.cumsum(n) - 1)[there]] = 0.0  # the pair of one text's last word with the next text's first
            total = np.add.reduceat(self.sums[at] + both, begin)
            z[there] += total / (np.add.reduceat(self.counts[at], begin) + n[there] - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, for class 1 against class 0
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of each."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    keys = keys_of(words)
    ids = np.concatenate([_bucket(keys), pairs(keys), *(i[ok] for i, ok in ngrams(words))])
    distinct, n = np.unique(ids, return_counts=True)
    return distinct.astype(np.int32), (n / len(ids)).astype(np.float32)


def train(sample: pd.DataFrame, seed: int = 5) -> Model:
    """SGD on log loss with a linearly falling rate. No rows, or one class only: the prior alone."""
    y = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, dtype=np.int64)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float(prior))
    x = [features(t) for t in sample["text"]]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), dtype=np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            ids, share = x[i]
            rate = RATE * (1 - done / steps)
            done += 1
            h = share @ vectors[ids]
            z = out @ h + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = g @ out
            out -= rate * np.outer(g, h)
            bias -= 0.1 * rate * g
            # as usual for averaged embeddings, each row takes the whole step
            vectors[ids] -= rate * np.minimum(share[:, None] * len(ids), 1.0) * back
    delta = out[1] - out[0]
    return Model((vectors @ delta).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    return train(labelled_sample(docs, labels, label, learn, ROWS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (double): one row per input row. Null and empty texts get the prior's score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value.scorer()
        for b in batches:
            s = f(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return text_of(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array(f(b.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
