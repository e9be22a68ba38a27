"""SimHash near-duplicates: fingerprints within a Hamming radius, compared exactly tile by tile.

Copies collapse first: only distinct fingerprints are compared. Two fingerprints that differ in at
most ``RADIUS`` bits agree on one of RADIUS + 1 bit blocks, so each meets only those with which it
shares a block's value. What shares a value is dealt into tiles by population count (and a hash where
there are more than ``TILE``), whatever their number, and tile pairs are joined only where the counts
differ by no more than the radius. A task xors two tiles with numpy, counts bits and, within a tile
pair, again skips runs whose population counts are too far apart. It returns a spanning forest of the
links it found, never all pairs; components of the forest are a Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, staged, text_of, with_hash
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a tile.
TILE = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes. No words: 0."""
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter(map(_hash, shingles), dtype="<u8")
    byte = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """doc_id, fp (bigint, the 64 bits), one row per input row; hashed: _th, the hash of the text, before fp."""
    keys = ["doc_id", "_th"] if hashed else ["doc_id"]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{', _th bigint' if hashed else ''}, fp bigint"
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fp.view(np.int64))], [*keys, "fp"])

    texts = text_of(docs)
    return (with_hash(texts) if hashed else texts).mapInArrow(run, kinds)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of a spanning forest over a (and b): within a, or from a to b."""
    a = a[np.argsort(np.bitwise_count(a))]
    other = a if b is None else b[np.argsort(np.bitwise_count(b))]
    nodes = a if b is None else np.concatenate([a, other])
    shift = 0 if b is None else len(a)
    label = np.arange(len(nodes))
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(other).astype(int)
    for i in range(0, len(a), 256):
        rows, counts = a[i : i + 256], pa_[i : i + 256]
        lo, hi = np.searchsorted(pb, counts[0] - radius), np.searchsorted(pb, counts[-1] + radius, side="right")
        if lo >= hi:
            continue
        u, v = np.nonzero(np.bitwise_count(rows[:, None] ^ other[None, lo:hi]) <= radius)
        u, v = u + i, v + lo + shift
        while len(u):
            ru, rv = label[u], label[v]
            apart = ru != rv
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(label, np.maximum(ru, rv), np.minimum(ru, rv))
            while (label[label] != label).any():
                label = label[label]
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: a spanning forest of the links between the distinct fingerprints fp of nodes."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    block = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("value")) for i in range(n)]
    keyed = nodes.select("fp", F.explode(F.array(*block)).alias("k")).select("fp", "k.*")
    counts = staged(keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "tiles")
    salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (4 * tile)))
    dealt = keyed.join(counts, ["block", "value"]).select("block", "value", F.bit_count("fp").alias("pop"), salt.alias("salt"), "fp")
    tiles = staged(dealt.groupBy("block", "value", "pop", "salt").agg(F.collect_list("fp").alias("fps")), "tiles")
    alone = tiles.select(F.col("fps").alias("x"), F.lit(None).cast("array<bigint>").alias("y")).where(F.size("x") > 1)
    x = tiles.select("block", "value", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("_d"), "pop", F.col("salt").alias("_s"), F.col("fps").alias("x"))
    x = x.withColumn("pop", F.col("pop") + F.col("_d"))
    y = tiles.select("block", "value", "pop", "salt", F.col("fps").alias("y"))
    pairs = x.join(y, ["block", "value", "pop"]).where("_d > 0 OR _s < salt").select("x", "y")
    small_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p, q in zip(b.column("x"), b.column("y"), strict=True):
                p, q = (None if not z.is_valid else z.values.to_numpy().view(np.uint64) for z in (p, q))
                found.append(forest(p, q, radius))
            a, c = (np.concatenate(z).view(np.int64) for z in zip(*found, strict=True)) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return alone.unionByName(pairs).mapInArrow(run, "a bigint, b bigint")


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (distinct fp, first, n) with root, the same for all fingerprints of a component and no others."""
    found = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    return staged(rooted, "rooted")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links.

    One row per input row. Texts without words have fingerprint zero and are linked like others.
    Null ids never are the smallest; a component of null ids alone has a null component_id.
    """
    fps = staged(fingerprints(docs, size), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    rooted = _rooted(nodes, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(rooted.join(least, "root").select("fp", "component_id", "n"), "named")
    return join_hot(fps, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keepers(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, _th, n, kept: one row per document (doc_id and hash of the text), n its rows in docs.

    kept holds for one document of each component: the smallest doc_id, null last, then the least hash.
    A component_id would not do here: unrelated components share it where rows share an id, or have none.
    """
    fps = staged(fingerprints(docs, size, hashed=True), "fingerprints")
    document = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_th")
    rooted = _rooted(staged(fps.groupBy("fp").agg(F.min(document).alias("first"), F.count("*").alias("n")), "distinct"), radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = staged(rooted.join(least, "root").select("fp", "least", F.col("n").alias("_n")), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("_th") == F.col("least._th"))
    return join_hot(fps.groupBy("doc_id", "_th", "fp").agg(F.count("*").alias("n")), named, "fp", "_n").select("doc_id", "_th", "n", kept.alias("kept"))
