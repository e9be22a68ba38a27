"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A document is parsed
greedily against each automaton into phrases, every phrase the longest match at its place. A phrase
costs about log2 of its sample's length (where in the sample it is), so the phrases times that are the
document's cost; the language with the least cost a character wins. Text is reduced to lower-cased letters
and their marks with single spaces between.

Documents are cut every ``CHUNK`` characters (a phrase ends there at the latest, for every language alike)
and all chunks of a batch are parsed in step, one look per character and language into a hash table of
(state, character). An automaton of n characters has fewer than 3n transitions, whatever its
alphabet; the tables are what is broadcast, their size is checked against ``MAX_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Characters of labelled text a language is learned from, at most of one document, and the most languages.
SAMPLE, SHARE = 30_000, 1_500
MOST_LANGUAGES = 500
#: Of all languages' tables.
MAX_BYTES = 1 << 30
CHUNK = 512
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton's states; the first is the root."""
    go: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Transitions:
    """(state, character) -> state, in a hash table with open addressing; 0 where there is none."""

    def __init__(self, go: list[dict[str, int]]):
        """go: of each state; here states are counted from 1."""
        key = np.array([(s + 1) << 21 | ord(c) for s, edges in enumerate(go) for c in edges], dtype=np.int64)
        to = np.array([t + 1 for edges in go for t in edges.values()], dtype=np.int32)
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.keys, self.to = np.zeros(1 << self.bits, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = key[left[free]]  # of several for one slot, one gets it
            mine = self.keys[at[left]] == key[left]
            self.to[at[left[mine]]] = to[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state << 21 | char
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.to[at], 0)
        left = np.nonzero((seen != key) & (seen != 0))[0]
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left]]
            hit = left[seen == key[left]]
            out[hit] = self.to[at[hit]]
            left = left[(seen != key[left]) & (seen != 0)]
        return out


@dataclass
class Model:
    langs: list[str]
    cost: np.ndarray  # of a phrase, by language
    tables: list[Transitions]

    @classmethod
    def of(cls, samples: dict[str, str]) -> Model:
        samples = {k: plain(v)[:SAMPLE] for k, v in sorted(samples.items())}
        tables, held = [], 0
        for text in samples.values():
            tables.append(Transitions(automaton(text)))
            held += tables[-1].keys.nbytes + tables[-1].to.nbytes
            if held > MAX_BYTES:
                raise ValueError(f"the languages' tables exceed {MAX_BYTES} bytes")
        return cls(list(samples), np.log2([2 + len(t) for t in samples.values()]), tables)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language]: phrases that the text takes. texts: plain and not empty."""
        n = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        parts = -(-n // CHUNK)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(CHUNK, n[owner] - nth * CHUNK)
        begin = (np.cumsum(n) - n)[owner] + nth * CHUNK
        order = np.argsort(-size, kind="stable")  # chunks still running come first
        owner, size, begin = owner[order], size[order], begin[order]
        running = len(size) - np.searchsorted(size[::-1], np.arange(CHUNK), side="right")
        out = np.zeros((len(texts), len(self.langs)))
        for k, step in enumerate(self.tables):
            state, count = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for i in range(CHUNK):
                m = running[i]
                if not m:
                    break
                c = chars[begin[:m] + i]
                to = step(state[:m], c)
                ends = np.nonzero(to == 0)[0]
                count[ends] += 1
                to[ends] = step(np.ones(len(ends), dtype=np.int64), c[ends])
                state[:m] = to
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores: by how much less the winner's cost is than the next's, of the next's.

        Of equal costs, the language that comes first by name wins (with score 0).
        """
        there = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if there and self.langs:
            p = self.phrases([plain(texts[i]) for i in there]) * self.cost
            two = np.sort(p, axis=1)[:, :2]
            gap = 1 - two[:, 0] / two[:, -1] if p.shape[1] > 1 else np.ones(len(p))
            for i, k, s in zip(there, p.argmin(axis=1), gap, strict=True):
                lang[i], score[i] = self.langs[k], float(s)
        return lang, score


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A bounded sample of each language's text, in a fixed pseudo-random order of its documents.

    learn: condition on doc_id of the rows that may be learned from. Rows without a language or
    without text teach nothing, and no document teaches more than its first SHARE characters.
    """
    rows = docs.where(learn).select("doc_id", "lang", "text").where("lang IS NOT NULL AND length(text) > 0").withColumn("text", F.substring("text", 1, SHARE)).withColumn("o", F.xxhash64("doc_id", F.lit(13)))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min("o").alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model.of({})
    # Hashes up to a bound: three samples' worth of text is expected under it, and the first document always.
    bound = {r["lang"]: max(r["least"], min(2**63 - 1, int(min(1.0, 3 * sample / r["chars"]) * 2**64) - 2**63)) for r in sizes}
    limits = docs.sparkSession.createDataFrame(list(bound.items()), "lang string, bound bigint")
    near = rows.join(F.broadcast(limits), "lang").where("o <= bound")
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    got = near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * sample).select("lang", "before", "text").collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in got:
        texts.setdefault(r["lang"], []).append((r["before"], r["text"]))
    return Model.of({k: " ".join(t for _, t in sorted(v)) for k, v in texts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row; "und" and 0 where a text is null or has no letter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_of(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
