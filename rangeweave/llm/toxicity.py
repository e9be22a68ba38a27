"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct word n-grams, hashed to ``BUCKETS``: single words (lower-cased and
bare of punctuation), pairs of neighbours, and skip-grams with one word between. FTRL-proximal keeps a
rate per coordinate; its L1 term leaves most weights at zero, so only the few others are broadcast
(indices and values, 12 bytes each, BUCKETS at most). Training takes a bounded labelled sample (``ROWS`` documents); scoring is one pass without a
shuffle.
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

BUCKETS = 1 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
EPOCHS = 4
#: Documents of the training sample, at most.
ROWS = 10_000
#: Words a worker remembers before it starts anew.
MEMO = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PUNCT = b".,;:!?\"'()[]{}*#$%&"


class Features:
    """Distinct feature indices of texts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        long = []
        for w in set(words).difference(memo):
            if len(w) > MEMO_BYTES:
                long.append(w)
            memo[w] = xxhash.xxh3_64_intdigest(w.strip(_PUNCT))
        k = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        for w in long:
            del memo[w]
        with np.errstate(over="ignore"):
            near = (k[:-1] * _MIX) ^ k[1:]
            skip = (k[:-2] * _MIX * _MIX) ^ k[2:]
        return np.unique((np.concatenate([k, near, skip]) * _MIX >> np.uint64(64 - 20)).astype(np.int32))


@dataclass
class Model:
    index: np.ndarray  # of the weights that aren't zero
    value: np.ndarray
    bias: float

    def scorer(self):
        features, w = Features(), np.zeros(BUCKETS, dtype=np.float32)
        w[self.index] = self.value

        def score(text: str) -> float:
            z = self.bias + float(w[features(text)].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def train(sample: pd.DataFrame, seed: int = 5) -> Model:
    """FTRL-proximal (McMahan et al. 2013) with features of value 1. No rows: weights and bias zero."""
    x = list(map(Features(), sample["text"]))
    y = sample["label"].to_numpy(dtype=np.float64)
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    squares = 1.0

    def weights(at: np.ndarray) -> np.ndarray:
        s = z[at]
        return np.where(np.abs(s) <= L1, 0.0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at = x[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            squares += g * g
            bias -= ALPHA * g / np.sqrt(squares) / 4
    w = weights(np.arange(BUCKETS))
    at = np.nonzero(w)[0]
    return Model(at.astype(np.int64), w[at].astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    return train(labelled_sample(docs, labels, label, learn, ROWS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (double): one row per input row. Null and empty texts get the prior's score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value.scorer()
        for b in batches:
            s = pa.array([f(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), s], ["doc_id", "score"])

    return text_of(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
