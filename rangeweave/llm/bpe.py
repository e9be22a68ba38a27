"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary answers for whole pre-tokens: one slot is
probed and its stored bytes are compared. Pre-tokens that are not in the vocabulary are merged with
a heap over a doubly linked list of byte spans, n log n in the pre-token's length.

The vocabulary (a bounded file, ``MAX_RANKS`` entries at most) is broadcast; texts never leave the
task that reads them, so the job has no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import MEMO_BYTES, small_batches, text_of

#: Vocabularies beyond this are refused: what is broadcast has a proven bound.
MAX_RANKS = 1_000_000
#: Pre-tokens a worker remembers before it starts anew.
MEMO = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"vocabulary has {len(ranks)} entries; the bound is {MAX_RANKS}")
    return ranks


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe.

    Keys fall into n/2 buckets; the largest buckets first, each bucket takes the first displacement
    that puts its keys on free slots. Buckets of one key name their slot outright.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // 2)  # of no key there is no index to ask for
        self.slots: list[int] = [0] * n
        self.shift: list[int] = [0] * m
        for self.seed in range(100):
            if self._place(keys):
                return
        raise ValueError("no displacement found; are the keys distinct?")

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        return h % self.m, h >> 32, h >> 7 & 0xFFFFFFF

    def _place(self, keys: list[bytes]) -> bool:
        buckets: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, x, y = self._parts(key)
            buckets.setdefault(b, []).append((x, y, i))
        free = bytearray(b"\1") * self.n
        spare = iter(range(self.n))
        for b, members in sorted(buckets.items(), key=lambda kv: -len(kv[1])):
            if len(members) == 1:
                slot = next(s for s in spare if free[s])
                self.shift[b], free[slot], self.slots[slot] = -1 - slot, 0, members[0][2]
                continue
            for d in range(20 * self.n):
                at = [(x + d * (y | 1)) % self.n for x, y, _ in members]
                if len(set(at)) == len(at) and all(free[s] for s in at):
                    break
            else:
                return False
            self.shift[b] = d
            for s, (_, _, i) in zip(at, members, strict=True):
                free[s], self.slots[s] = 0, i
        return True

    def index(self, key: bytes) -> int:
        """Of the only key that it could be."""
        b, x, y = self._parts(key)
        d = self.shift[b]
        return self.slots[-1 - d if d < 0 else (x + d * (y | 1)) % self.n]


class Coder:
    """Encodes and decodes with one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.bytes_of = dict(zip(self.ids, self.tokens, strict=True))
        self.ranks = ranks  # of the pairs that a merge looks at

    def ready(self) -> Coder:
        """In a worker: what can't or needn't be sent."""
        if not hasattr(self, "split"):
            self.split = regex.compile(self.pattern).findall
            self.memo: dict[str, bytes] = {}
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def rank(self, piece: bytes) -> int:
        """The id of a vocabulary entry, -1 for other bytes."""
        i = self.hash.index(piece) if self.tokens else 0
        return self.ids[i] if self.tokens and self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the span that starts at a byte; 0: merged into another
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if (mid := end[at]) < n and (r := rank(piece[at : end[mid]])) is not None:
                heapq.heappush(heap, (r, at, end[mid]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, to = heapq.heappop(heap)
            mid = end[at]
            if not mid or mid >= n or end[mid] != to:
                continue  # one of the two spans has changed since
            end[at], end[mid] = to, 0
            if to < n:
                before[to] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [self.ranks[piece[at : end[at]]] for at in range(n) if end[at]]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        pieces = self.split(text)
        if len(memo) > MEMO:
            memo.clear()
        long: list[str] = []
        for p in set(pieces).difference(memo):
            raw = p.encode()
            i = self.rank(raw)
            memo[p] = np.array([i] if i >= 0 else self.merge(raw), dtype="<u4").tobytes()
            if len(raw) > MEMO_BYTES:
                long.append(p)
        out = b"".join(map(memo.__getitem__, pieces))
        for p in long:
            del memo[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian uint32) and decoded (binary), one row per input row.

    Null and empty texts: empty ids and bytes. A vocabulary must have the single bytes that texts are
    made of; without any entry only empty texts can be encoded (KeyError for others). Texts are whole, whatever their length; special
    tokens in a text are ordinary characters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Coder(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.ready()
        for b in batches:
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_of(docs).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, decoded (binary) from doc_id, ids (binary; null: empty)."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Coder(ranks, ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for b in batches:
            out = [coder.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
