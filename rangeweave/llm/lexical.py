"""Ranked lexical search over an index whose strata are the documents of one length normaliser.

Every document is in the index, in the stratum of its normaliser m; a stratum is stored in blocks of about `BLOCK`
documents. Within a block the postings of a term are runs of equal tf, greatest tf first, so the impact
of a posting is worked out once for each (term, tf), and the first run bounds what the term can add. A block's bounds give, for each item,
the most that a document of it can score. The blocks of greatest bound are visited first; the scores
found there are thresholds, and afterwards only blocks whose bound reaches an item's threshold are visited for it. No document is lost:
a skipped block holds none that could be among the first k.

Items are taken in batches of at most `ITEM_BYTES` of text; a batch's terms and weights are all that is sent to tasks, and the index
holds the postings of these terms. Everything else grows with the documents and stays on executors; a task holds a few blocks.

A null text has no terms. Null doc_ids are documents too, and come last among equal scores; rows that share a doc_id are
ranked each for itself. Each row of items is an item, whatever its item_id; an item without terms, or whose terms occur nowhere, has no rows. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import small_batches, staged, within

#: Documents of a block at most, on average; blocks that are visited first for each item.
BLOCK, SEEDS = 1000, 3
#: Bytes of item texts in a batch.
ITEM_BYTES = 8 << 20
#: Postings that are scored at once.
AT_ONCE = 2_000_000

#: As bytes of UTF-8 in which A-Z are lower-cased: digits, a-z and whatever is not ASCII.
_term = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return _term.findall((text or "").encode().lower())


# -- items -------------------------------------------------------------------------------------


@dataclass
class Items:
    """A batch of items: for item k the terms term[begin[k]:begin[k + 1]] and how often each occurs in it."""

    ids: list
    terms: dict[bytes, int]
    term: np.ndarray
    times: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """rows: (item_id, text), of items that have terms."""
        terms: dict[bytes, int] = {}
        term, times, begin = [], [], [0]
        for _, text in rows:
            counts = Counter(terms_of(text))
            term += [terms.setdefault(t, len(terms)) for t in counts]
            times += counts.values()
            begin.append(len(term))
        return cls([i for i, _ in rows], terms, np.array(term, dtype=np.int64), np.array(times, dtype=np.int64), np.array(begin, dtype=np.int64))


def batches_of(items: DataFrame) -> Iterator[Items]:
    """The items in batches of about `ITEM_BYTES`; one batch at a time is on the driver."""
    own = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    own = own.withColumn("n", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    for k in range(n):
        rows = sorted(((r["item_id"], r["text"]) for r in own.where(F.col("n") == k).select("item_id", "text").toLocalIterator()), key=lambda r: (r[0] is None, r))
        rows = [r for r in rows if terms_of(r[1])]
        if rows:
            yield Items.of(rows)


# -- index -------------------------------------------------------------------------------------


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """rid, doc_id, n, term, tf: each document with terms, how many it has, and which of the given ones how often."""
    small_batches(docs.sparkSession)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("term", ints), T.StructField("tf", ints)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, term, tf, ends = [], [], [], [0]
            for text in b["text"].to_pylist():
                words = terms_of(text)
                n.append(len(words))
                which, times = np.unique(np.fromiter((k for k in map(terms.get, words) if k is not None), np.int32), return_counts=True)
                term.append(which)
                tf.append(times.astype(np.int32))
                ends.append(ends[-1] + len(which))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *x]))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b["rid"], b["doc_id"], pa.array(n, pa.int64()), *lists], names=schema.names)

    given = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return given.mapInArrow(count, schema).where("n > 0")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def build(rows: DataFrame, n_docs: int, n_terms: int, block: int = BLOCK) -> DataFrame:
    """m, shard, docs, run_term, run_tf, run_size, places: a row a block of a stratum. rows: from `counted`, staged.

    Runs are ordered by term, then tf, greatest first; places are positions in docs. Strata of more than `block` documents are
    dealt by row number, so a stratum that holds a third of all documents is many blocks.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = rows.withColumn("m", F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L"))
    shards = own.groupBy("m").agg(F.ceil(F.count("*") / block).alias("shards"))
    own = within(own, shards, "m").withColumn("shard", F.pmod(F.xxhash64("rid"), "shards"))

    def lay_out(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("rid")
        lists = [t[c].combine_chunks() for c in ("term", "tf")]
        term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        place = np.repeat(np.arange(len(t)), lists[0].value_lengths().to_numpy())
        order = np.lexsort((place, -tf, term))
        term, tf, place = term[order], tf[order], place[order]
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
        size = np.diff(np.append(new, len(term)))
        docs = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["doc_id"].combine_chunks())
        raw = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (term[new], tf[new], size, place)]
        return pa.Table.from_arrays([*(pa.array([k.as_py()], pa.int64()) for k in key), docs, *raw], names=["m", "shard", "docs", *RUNS, "places"])

    return own.groupBy("m", "shard").applyInArrow(lay_out, f"m bigint, shard bigint, docs array<{kind}>, run_term binary, run_tf binary, run_size binary, places binary")


RUNS = ["run_term", "run_tf", "run_size"]


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64)


# -- search ------------------------------------------------------------------------------------


class Block:
    """One block as arrays: the impacts of its runs, and what each item can score in it at most."""

    def __init__(self, m: int, run_term: bytes, run_tf: bytes):
        self.run_term = _ints(run_term)
        self.run_impact = impact(_ints(run_tf), m)
        self.first = np.flatnonzero(np.diff(self.run_term, prepend=-1) != 0)

    def bounds(self, items: Items, weight: np.ndarray) -> np.ndarray:
        most = np.zeros(len(items.terms), dtype=np.int64)
        most[self.run_term[self.first]] = self.run_impact[self.first]
        return np.add.reduceat(items.times * weight[items.term] * most[items.term], items.begin[:-1])

    def scores(self, items: Items, weight: np.ndarray, which: np.ndarray, run_size: np.ndarray, place: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, their scores of every document of the block), so many items at once as memory allows."""
        gain = np.repeat(self.run_impact, run_size)
        per_term = np.add.reduceat(run_size, self.first) if len(self.first) else np.empty(0, dtype=np.int64)
        size, begin = np.zeros(len(items.terms), dtype=np.int64), np.zeros(len(items.terms), dtype=np.int64)
        size[self.run_term[self.first]] = per_term
        begin[self.run_term[self.first]] = np.cumsum(per_term) - per_term
        work = np.add.reduceat(size[items.term], items.begin[:-1])[which] + n_docs
        for part in np.split(which, np.flatnonzero(np.diff(np.cumsum(work) // AT_ONCE)) + 1):
            n_terms = items.begin[part + 1] - items.begin[part]
            at = np.repeat(items.begin[part] - np.cumsum(n_terms) + n_terms, n_terms) + np.arange(n_terms.sum())
            term, slot = items.term[at], np.repeat(np.arange(len(part)), n_terms)
            n = size[term]
            posting = np.repeat(begin[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out = np.zeros(len(part) * n_docs, dtype=np.int64)
            cell = np.repeat(slot, n) * n_docs + place[posting]
            value = np.repeat(items.times[at] * weight[term], n) * gain[posting]
            if value.sum(dtype=float) < 2**53:  # sums of doubles are exact then
                out = np.bincount(cell, value, minlength=len(out)).astype(np.int64)
            else:
                np.add.at(out, cell, value)
            yield part, out.reshape(len(part), n_docs)


def _order(x: tuple) -> tuple:
    return -x[0], x[1] is None, x[1]


def seeds(index: DataFrame, items: Items, weight: np.ndarray, n: int = SEEDS) -> list[tuple[int, int, int]]:
    """(item, m, shard): each item's n blocks of greatest bound."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list = []
        for f in frames:
            for m, shard, run_term, run_tf in f.itertuples(index=False):
                bound = Block(m, run_term, run_tf).bounds(items, weight)
                k = np.flatnonzero(bound > 0)
                found.append(pd.DataFrame({"item": k, "m": m, "shard": shard, "bound": bound[k]}))
            if found:
                every = pd.concat(found).sort_values(["bound", "m", "shard"], ascending=[False, True, True])
                found = [every.groupby("item").head(n)]
        yield from found

    every = index.select("m", "shard", "run_term", "run_tf").mapInPandas(best, "item int, m bigint, shard bigint, bound bigint")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "shard")
    return [(r["item"], r["m"], r["shard"]) for r in every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).collect()]


def visit(index: DataFrame, items: Items, weight: np.ndarray, k: int, least: np.ndarray, only: dict[tuple[int, int], list[int]] | None = None) -> DataFrame:
    """item, doc_id, score: of each item at least the k first documents among the blocks visited.

    least: score by item that a block's bound must reach. only: block to the items that visit it. A task raises its thresholds
    as it goes, and takes the blocks at hand in the order of their bounds.
    """
    doc_id = index.schema["docs"].dataType.elementType.simpleString()

    schema = T._parse_datatype_string(f"item int, doc_id {doc_id}, score bigint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, found = least.copy(), {}
        for b in batches:
            m, shard, run_term, run_tf = (b[c].to_pylist() for c in ("m", "shard", "run_term", "run_tf"))
            blocks = [Block(*x) for x in zip(m, run_term, run_tf)]
            bounds = [x.bounds(items, weight) for x in blocks]
            for at in sorted(range(len(blocks)), key=lambda i: (-int(bounds[i].max(initial=0)), i)):
                which = np.flatnonzero((bounds[at] > 0) & (bounds[at] >= floor))
                if only is not None:
                    which = np.intersect1d(which, only.get((m[at], shard[at]), []))
                if not len(which):
                    continue
                docs, run_size, place = b["docs"][at].as_py(), _ints(b["run_size"][at].as_py()), _ints(b["places"][at].as_py())
                for part, scores in blocks[at].scores(items, weight, which, run_size, place, len(docs)):
                    for i, row in zip(part.tolist(), scores):
                        over = np.flatnonzero(row >= max(1, floor[i]))
                        if len(over) > k:
                            over = over[row[over] >= np.partition(row[over], -k)[-k]]
                        if len(over):
                            found[i] = sorted(found.get(i, []) + [(int(row[d]), docs[d]) for d in over], key=_order)[:k]
                            if len(found[i]) == k:
                                floor[i] = max(floor[i], found[i][-1][0])
        rows = [(i, d, s) for i, own in found.items() for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), ids, pa.int64()))], names=["item", "doc_id", "score"])

    ids = to_arrow_type(schema["doc_id"].dataType)
    return index.mapInArrow(search, schema)


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score, rank: the k first documents of each item. index: from `build`, staged."""
    spark = index.sparkSession
    only: dict = {}
    for item, m, shard in seeds(index, items, weight):
        only.setdefault((m, shard), []).append(item)
    least = np.zeros(len(items.ids), dtype=np.int64)
    if only:
        named = F.broadcast(spark.createDataFrame(list(only), "m bigint, shard bigint"))
        early = first_k(visit(index.join(named, ["m", "shard"], "left_semi"), items, weight, k, least, only), k)
        for r in early.where(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
    return first_k(visit(index, items, weight, k, least), k)


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of greatest score above 0 of each item, over all documents."""
    spark = docs.sparkSession
    id_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id {doc_type}, score bigint")
    for batch in batches_of(items):
        rows = staged(counted(docs, batch.terms), "terms")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(batch.terms), dtype=np.int64)
        for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        index = staged(build(rows, n_docs, n_terms, block), "index")
        found = search(index, batch, weights(n_docs, df), k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(batch.ids)), f"item int, item_id {id_type}"))
        out = out.unionByName(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
