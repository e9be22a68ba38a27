"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document is tokenised once; only lengths travel afterwards. Pieces as long as a sequence are
sequences by themselves. All others are dealt at random to blocks of about `BLOCK` pieces. Several
islands evolve each block apart from one another; between epochs, each one's best solutions move on to
the next island, by a shuffle. A solution is a partition of the block's pieces into sequences; crossover
injects whole well-filled sequences of one parent into the other, drops the sequences that
hold their pieces too, and fits what is displaced again, longest first and each where least room is left.
A block whose solution is as short as its lower bound is done. Afterwards the sequences with
most room left, of all blocks, are dissolved and their pieces packed once more, in fewer blocks, until one block holds what is left.

Null texts count as empty; an empty document is a piece of one token, the end mark. Rows that share a doc_id,
or are equal, are packed each for itself. An empty table gives an empty result. Memory of a task follows `BLOCK`
and the longest text, not the table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, staged

CAPACITY = 2048
#: Pieces of a block, islands, their solutions, epochs and crossovers in each.
BLOCK, ISLANDS, SOLUTIONS, EPOCHS, CROSSOVERS, ELITE = 2000, 3, 6, 3, 12, 2
#: Of each block's sequences, the share that may be dissolved and packed again.
LOOSE = 0.15
ROUNDS = 6

# -- tokens ------------------------------------------------------------------------------------


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from the vocabulary of a byte-level `tokenizers` file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    read = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in read.get("added_tokens", ())}
    return {bytes(map(shown.__getitem__, k)): v for k, v in read["model"]["vocab"].items() if k not in special}


def _encoders(ranks: dict[bytes, int]):
    import tiktoken

    head = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++"
    make = lambda tail: tiktoken.Encoding("own", pat_str=head + tail, mergeable_ranks=ranks, special_tokens={})
    return make(r"|\s++").encode_ordinary, make(r"|\s++$|\s+(?!\S)|\s").encode_ordinary


PIECE = "rid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """rid, doc_id, piece, start, length, ids_crc32: a row a piece, the first piece of a document the shorter one.

    path: vocabulary file of `tokenizers`, read on the driver. rid numbers the rows of docs. The strings of special
    tokens in a text are ordinary text. Ids equal those of the `tokenizers` library.
    """
    small_batches(docs.sparkSession)
    ranks = byte_ranks(path)
    given = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], *T._parse_datatype_string(PIECE).fields[1:]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where white space comes one by one, the look-ahead of the splitting pattern decides nothing and is left out.
        single, several = _encoders(ranks)
        runs = re.compile(r"\s\s").search
        for b in batches:
            of, rest = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                ids = (several if runs(text) else single)(text)
                ids.append(end)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                at = 0
                for k, to in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    of.append(i)
                    rest.append((k, at, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                    at = to
            of, rest = pa.array(of, pa.int32()), np.array(rest, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b["rid"].take(of), b["doc_id"].take(of), pa.array(rest[:, 0].astype(np.int32)), *(pa.array(rest[:, k]) for k in (1, 2, 3))],
                names=schema.names,
            )

    return given.mapInArrow(cut, schema)


# -- one block ---------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: whole content, and pieces that cannot share a sequence (Martello and Toth)."""
    n = np.bincount(lengths, minlength=capacity + 1)
    total = np.arange(capacity + 1) * n
    count, content = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    half, t = capacity // 2, np.arange(1, capacity // 2 + 1)
    long, middle = count[-1] - count[capacity - t + 1], count[capacity - t + 1] - count[half + 1]
    room = middle * capacity - (content[capacity - t + 1] - content[half + 1])
    small = content[half + 1] - content[t]
    over = np.maximum(0, -((room - small) // capacity))
    return int(max(-(-content[-1] // capacity), (long + middle + over).max(initial=0)))


def best_fit(lengths: list[int], todo: list[int], bins: list[int], free: list[int], capacity: int) -> None:
    """Puts each piece of todo into the open sequence that has least room left for it, or into a new one.

    bins: piece to sequence, changed in place. free: room left by sequence, changed and extended in place.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(free):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in todo:
        n = lengths[i]
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            at = by_room[r]
            b = at.pop()
            if not at:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = r = r - n
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


def _settle(lengths, kept: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    """A whole solution from a part: kept holds a sequence for each piece, -1 for displaced ones; these are fitted in order."""
    held = kept >= 0
    used, kept_as = np.unique(kept[held], return_inverse=True)
    out = np.full(len(kept), -1)
    out[held] = kept_as
    free = (capacity - np.bincount(kept_as, weights=lengths[held], minlength=len(used))).astype(int).tolist()
    bins = out.tolist()
    best_fit(lengths.tolist(), order[~held[order]].tolist(), bins, free, capacity)
    return np.array(bins)


def crossover(into: np.ndarray, source: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, capacity: int = CAPACITY) -> np.ndarray:
    """into with about half of the well-filled sequences of source; those of into that share a piece with them are dissolved,
    as is a tenth of its loosest ones, and the displaced pieces are fitted, longest first."""
    fill = np.bincount(source, weights=lengths)
    worth = fill / capacity * rng.random(len(fill)) ** 0.5
    taken = worth >= np.quantile(worth, rng.uniform(0.3, 0.8))
    injected = taken[source]
    broken = np.zeros(into.max() + 1, dtype=bool)
    broken[into[injected]] = True
    own = np.bincount(into, weights=lengths)
    broken |= own <= np.quantile(own, 0.1)
    kept = np.where(injected, source, np.where(broken[into], -1, into + len(fill)))
    order = np.argsort(-lengths - rng.random(len(lengths)) * rng.choice([0.5, 40.0]), kind="stable")
    return _settle(lengths, kept, capacity, order)


def worth(bins: np.ndarray, lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[int, float]:
    """Greater is better: fewer sequences, then the more uneven fill, which leaves room in one place."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return -len(fill), float((fill * fill).sum())


def first_solution(lengths: np.ndarray, rng: np.random.Generator, spread: float, capacity: int = CAPACITY) -> np.ndarray:
    return _settle(lengths, np.full(len(lengths), -1), capacity, np.argsort(-lengths - rng.random(len(lengths)) * spread, kind="stable"))


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, crossovers: int, capacity: int = CAPACITY) -> list[np.ndarray]:
    """The population, best first, after so many crossovers; a child takes the place of the worst if it is better and new.
    Ends where the best has as few sequences as the lower bound."""
    least = -lower_bound(lengths, capacity)
    ranked = sorted(((worth(p, lengths, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for k in range(crossovers):
        if ranked[0][0][0] >= least or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[a][2], ranked[b][2], lengths, rng, capacity)
        mark = worth(child, lengths, capacity)
        if mark > ranked[-1][0] and all(mark != r[0] for r in ranked):
            ranked[-1] = (mark, len(population) + k, child)
            ranked.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [r[2] for r in ranked]


# -- islands as Spark jobs -----------------------------------------------------------------------

SOLUTION = "block bigint, island int, lengths binary, bins binary, sequences int, uneven double, done boolean"


def _emit(block: int, island: int, lengths: np.ndarray, found: list[np.ndarray], capacity: int, last: bool) -> pd.DataFrame:
    """An island's solutions after an epoch, and copies of its best ones for the next island. Only the best where the
    epoch is the last, or its sequences are as few as can be."""
    marks = [worth(p, lengths, capacity) for p in found]
    done = -marks[0][0] <= lower_bound(lengths, capacity)
    sent = [(island, k) for k in range(len(found))] + [((island + 1) % ISLANDS, k) for k in range(min(ELITE, len(found)))]
    sent = sent[:1] if done or last else sent
    raw = lengths.astype("<u2").tobytes()
    return pd.DataFrame(
        [(block, to, raw, found[k].astype("<u2").tobytes(), -marks[k][0], marks[k][1], done) for to, k in sent],
        columns=[c.split()[0] for c in SOLUTION.split(", ")],
    )


def _islands(blocks: DataFrame, seed: int, capacity: int) -> DataFrame:
    """Solutions of the first epoch. An island starts from best fits in various orders; one has the former sequences, if any."""

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, island, lengths, was in f.itertuples(index=False):
                lengths, rng = np.array(lengths, dtype=np.int64), np.random.default_rng([seed, 0, block, island])
                first = [first_solution(lengths, rng, spread=(island + k) * 8.0, capacity=capacity) for k in range(SOLUTIONS)]
                if all(w is not None for w in was) and not np.isnan(np.array(was, dtype=float)).any():
                    first[-1] = np.unique(np.array(was, dtype=np.int64), return_inverse=True)[1]
                yield _emit(block, island, lengths, evolve(lengths, first, rng, CROSSOVERS, capacity), capacity, EPOCHS == 1)

    given = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items.length", "items.was")
    return given.mapInPandas(start, SOLUTION)


def _epoch(found: DataFrame, seed: int, epoch: int, capacity: int) -> DataFrame:
    """One more epoch of every block that is not done."""

    def step(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        block, island = map(int, key)
        f = f.sort_values(["sequences", "uneven", "bins"], ascending=[True, False, True]).drop_duplicates("bins").head(SOLUTIONS)
        lengths = np.frombuffer(f["lengths"].iloc[0], "<u2").astype(np.int64)
        rng = np.random.default_rng([seed, epoch, block, island])
        population = [np.frombuffer(b, "<u2").astype(np.int64) for b in f["bins"]]
        return _emit(block, island, lengths, evolve(lengths, population, rng, CROSSOVERS, capacity), capacity, epoch == EPOCHS - 1)

    going = found.join(found.where("done").select("block").distinct(), "block", "left_anti")
    return going.groupBy("block", "island").applyInPandas(step, SOLUTION)


PLACED = "rid bigint, piece int, length bigint, sequence_id bigint, offset bigint, loose boolean"


def _placed(blocks: DataFrame, best: DataFrame, number: int, capacity: int) -> DataFrame:
    """Each piece's place in the best solution of its block; loose: its sequence is among those with most room."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, items, bins in f.itertuples(index=False):
                rid, piece, length = (np.array([x[c] for x in items], dtype=np.int64) for c in ("rid", "piece", "length"))
                bins = np.frombuffer(bins, "<u2").astype(np.int64)
                order = np.lexsort((piece, rid, bins))
                rid, piece, length, bins = rid[order], piece[order], length[order], bins[order]
                before = np.cumsum(length) - length
                fill = np.bincount(bins, weights=length)
                loose = (fill < capacity) & (np.argsort(np.argsort(fill, kind="stable")) < max(1, LOOSE * len(fill)))
                begin = np.flatnonzero(np.diff(bins, prepend=-1))
                offset = before - np.repeat(before[begin], np.diff(np.append(begin, len(bins))))
                yield pd.DataFrame({"rid": rid, "piece": piece, "length": length, "sequence_id": ((number << 40) + block << 16) + bins, "offset": offset, "loose": loose[bins]})

    return blocks.join(best, "block").select("block", "items", "bins").mapInPandas(place, PLACED)


def _round(pool: DataFrame, n_blocks: int, number: int, capacity: int) -> DataFrame:
    """pool (rid, piece, length, was) packed in so many blocks; pieces that were in one sequence stay in one block."""
    dealt = F.coalesce(F.xxhash64("was"), F.xxhash64("rid", "piece")) if number else F.xxhash64("rid", "piece")
    blocks = pool.withColumn("block", F.pmod(dealt, F.lit(n_blocks)))
    blocks = staged(blocks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rid", "piece", "length", "was"))).alias("items")), "blocks")
    found = every = staged(_islands(blocks, number, capacity), "islands")
    for epoch in range(1, EPOCHS):
        if found.where("NOT done").isEmpty():
            break
        found = staged(_epoch(found, number, epoch, capacity), "islands")
        every = every.unionByName(found)
    best = every.groupBy("block").agg(F.max_by("bins", F.struct(-F.col("sequences"), "uneven", "bins")).alias("bins"))
    return _placed(blocks, best, number, capacity)


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """cut (from `pieces`) with sequence_id and offset: sequences of at most `capacity` tokens, as few as can be found."""
    if not 1 < capacity < 65536 or not 1 < block < 30000:
        raise ValueError("capacity and block must fit 16 bits")
    small_batches(cut.sparkSession)
    cut = staged(cut, "pieces")
    full = cut.where(F.col("length") == capacity).select("rid", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = cut.where(F.col("length") < capacity).select("rid", "piece", "length", F.lit(None).cast("long").alias("was"))
    out = full
    for number in range(ROUNDS):
        blocks = -(-pool.count() // block)
        if not blocks:
            break
        placed = staged(_round(pool, blocks, number, capacity), "placed")
        last = blocks == 1 or number == ROUNDS - 1
        out = out.unionByName((placed if last else placed.where("NOT loose")).select("rid", "piece", "sequence_id", "offset"))
        if last:
            break
        pool = placed.where("loose").select("rid", "piece", "length", F.col("sequence_id").alias("was"))
    return cut.join(out, ["rid", "piece"])
