"""Substring dedup: windows of ``WINDOW`` words that also start in a document with a smaller id.

Windows meet where they could be equal, and a compressed FM-index decides:

1. Every window has an anchor, the least hash among its runs of ``GRAM`` words (a minimizer); equal
   windows have equal anchors at equal places. Neighbouring windows with one anchor form a context.
   A scan stores, per document, digests only: of its words, and of each context. Later copies of a
   whole word sequence are settled by the digest; contexts that are equal as a whole by theirs.
2. What is left are anchors with different contexts around them. One context each goes to the shard of
   its anchor, where an FM-index of the shard's contexts is searched backward with every context;
   matching statistics cut at WINDOW give each window's least document.
3. An anchor's different contexts are dealt to one shard for each ``HOT`` of them: a passage that very many
   documents share is searched in several shards, each context in one. The windows that are a shard's least
   meet those of the anchor's other shards: digests name the windows that several shards kept, which go
   to shards of their own, where they are searched in the same way.

Texts are shuffled only where a document has contexts to be searched or words to be removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_BYTES, small_batches, staged, text_of, with_hash
from .fmindex import FMIndex

WINDOW = 50
GRAM = 10
#: Contexts of a shard, about; different contexts of one anchor in a shard, about.
SHARD, HOT = 12_000, 4_000
#: Documents that may be named in a broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Words a worker remembers before it starts anew.
MEMO = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ANCHOR = pa.struct([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("s0", pa.int32()), ("s1", pa.int32())])


def digest(data: bytes) -> tuple[int, int]:
    """128 bits as two signed integers."""
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Words:
    """64-bit codes of words."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        long = []
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
            if len(w) > MEMO_BYTES:
                long.append(w)
        codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        for w in long:
            del memo[w]
        return codes


def contexts(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each context."""
    n = len(codes) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    with np.errstate(over="ignore"):
        g = np.zeros(len(codes) - gram + 1, dtype=np.uint64)
        for k in range(gram):
            g = g * _MIX + codes[k : len(codes) - gram + 1 + k]
        g = (g ^ (g >> np.uint64(31))) * _MIX
        g ^= g >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(n)
    s0 = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    s1 = np.concatenate([s0[1:] - 1, [n - 1]])
    return g[at[s0]].view(np.int64), s0, s1


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, q1, q2 (digest of the words), n_words, whole_sha256 (of the words joined by one space), anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Words()
        for b in batches:
            q, n, sha, offsets, parts = [], [], [], [0], []
            for t in b.column("text").to_pylist():
                w = _words_of(t)
                plain = b" ".join(w)
                q.append(digest(plain))
                n.append(len(w))
                sha.append(hashlib.sha256(plain).hexdigest())
                if len(w) >= window:
                    codes = coded(w)
                    h, s0, s1 = contexts(codes, window, gram)
                    raw = codes.tobytes()
                    c = [digest(raw[8 * i : 8 * (j + window)]) for i, j in zip(s0.tolist(), s1.tolist(), strict=True)]
                    parts.append((h, np.array(c, dtype=np.int64), s0, s1))
                offsets.append(offsets[-1] + (len(h) if len(w) >= window else 0))
            if parts:
                h, c, s0, s1 = (np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                h = s0 = s1 = np.zeros(0, dtype=np.int64)
                c = np.zeros((0, 2), dtype=np.int64)
            fields = [pa.array(h), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32))]
            anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ANCHOR)))
            q1, q2 = (pa.array([x[k] for x in q], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_th"), q1, q2, pa.array(n, pa.int64()), pa.array(sha, pa.string()), anchors], ["doc_id", "_th", "q1", "q2", "n_words", "whole_sha256", "anchors"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _th bigint, q1 bigint, q2 bigint, n_words bigint, whole_sha256 string, anchors array<struct<h: bigint, c1: bigint, c2: bigint, s0: int, s1: int>>"
    return with_hash(text_of(docs)).mapInArrow(run, schema)


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lists (doc_id, _th, and more) with the text that has this id and hash; texts of other documents are not
    shuffled where the ids fit a broadcast. However many texts share an id, each meets its own list."""
    docs = with_hash(text_of(docs))
    ids = lists.select("doc_id", "_th").distinct()
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), ["doc_id", "_th"], "left_semi")
    return docs.join(lists, ["doc_id", "_th"])


def _context_words(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """h, c1, c2, m, kinds, codes (binary, uint64 each) of representative contexts."""
    lists = staged(reps.groupBy("doc_id", "q1", "q2").agg(F.min("_th").alias("_th"), F.collect_list(F.struct("h", "c1", "c2", "s0", "s1", "kinds")).alias("spots")), "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Words()
        for b in batches:
            out: list[tuple] = []
            for doc, t, a, c, spots in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "q1", "q2", "spots")), strict=True):
                w = _words_of(t)
                if digest(b" ".join(w)) != (a, c):
                    continue  # another text with this id
                raw = coded(w).tobytes()
                out += [(s["h"], s["c1"], s["c2"], doc, s["kinds"], raw[8 * s["s0"] : 8 * (s["s1"] + window)]) for s in spots]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["h", "c1", "c2", "m", "kinds", "codes"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_text(docs, lists).select("doc_id", "text", "q1", "q2", "spots").mapInArrow(run, f"h bigint, c1 bigint, c2 bigint, m {kind}, kinds bigint, codes binary")


def search_shard(shard: pa.Table, window: int) -> pa.Table:
    """h, c1, c2, lo, hi, open: runs of windows that also are in a context of a smaller document. Of contexts
    that are `split` over shards, the runs of all other windows as well, as open ones.

    off: what is added to the places in a context's codes.
    """
    codes = [np.frombuffer(x, dtype=np.uint64) for x in shard.column("codes").to_pylist()]
    m = shard.column("m").combine_chunks()
    m = pa.compute.rank(m, tiebreaker="dense").to_numpy().astype(np.int64)  # ids of any type, by their order
    length = np.array([len(c) for c in codes])
    symbols = np.unique(np.concatenate(codes), return_inverse=True)[1] + 1
    place = np.arange(len(symbols)) + np.repeat(np.arange(len(codes)), length)  # a 0 closes each text
    text = np.zeros(len(symbols) + len(codes), dtype=np.int64)
    text[place] = symbols
    owner = np.repeat(m, length + 1)
    begin = np.cumsum(length + 1) - length - 1
    least = FMIndex(text, owner, window).windows(text, begin, length)
    split = np.repeat(shard.column("split").to_numpy(), length + 1)
    kind = np.where(least < 0, 0, np.where(least < owner, 1, np.where(split, 2, 0)))
    cut = np.nonzero(np.diff(kind))[0] + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(kind)]]) - 1
    some = kind[first] > 0
    first, last = first[some], last[some]
    row = np.searchsorted(begin, first, side="right") - 1
    to = shard.column("off").to_numpy()[row] - begin[row]
    out = shard.select(["h", "c1", "c2"]).take(pa.array(row))
    for name, x in ("lo", (first + to).astype(np.int32)), ("hi", (last + to).astype(np.int32)), ("open", kind[first] == 2):
        out = out.append_column(name, pa.array(x))
    return out


def _search(texts: DataFrame, by: list[str], window: int, shard: int) -> DataFrame:
    """Rows h, c1, c2, m, off, split, codes are dealt to shards by the columns `by`, and each shard is searched."""
    texts = staged(texts, "words")
    parts = max(1, -(-texts.count() // shard))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(parts)))
    return staged(dealt.groupBy("shard").applyInArrow(lambda t: search_shard(t, window), "h bigint, c1 bigint, c2 bigint, lo int, hi int, open boolean"), "found")


def _windows(ctx: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """h, c1, c2, m, off, d1, d2, codes: a row for each window of the runs lo to hi of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, off, raws = [], [], []
            for i, (raw, lo, hi) in enumerate(zip(*(b.column(c).to_pylist() for c in ("codes", "lo", "hi")), strict=True)):
                row += [i] * (hi - lo + 1)
                off += range(lo, hi + 1)
                raws += [raw[8 * k : 8 * (k + window)] for k in range(lo, hi + 1)]
            d = list(map(digest, raws))
            keys = [b.column(c).take(pa.array(row, pa.int64())) for c in ("h", "c1", "c2", "m")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(off, pa.int32()), *(pa.array([x[k] for x in d], pa.int64()) for k in (0, 1)), pa.array(raws, pa.binary())], ["h", "c1", "c2", "m", "off", "d1", "d2", "codes"])

    kind = ctx.schema["m"].dataType.simpleString()
    return ctx.join(runs, ["h", "c1", "c2"]).select("h", "c1", "c2", "m", "codes", "lo", "hi").mapInArrow(run, f"h bigint, c1 bigint, c2 bigint, m {kind}, off int, d1 bigint, d2 bigint, codes binary")


def search(ctx: DataFrame, window: int, hot: int, shard: int) -> DataFrame:
    """h, c1, c2, lo, hi: the repeated windows of contexts (h, c1, c2, m, kinds, codes); kinds: contexts of h.

    A window is repeated if a context of a smaller document has it. Each context is searched once among at
    most about `hot` of its anchor's; what is kept as the least of a shard is searched once more among
    the equal windows that other shards kept, of which there are at most kinds / hot, about.
    """
    shards = F.ceil(F.col("kinds") / hot)
    dealt = ctx.select("h", "c1", "c2", "m", "codes", F.lit(0).alias("off"), (shards > 1).alias("split"), F.pmod(F.xxhash64("c1", "c2"), shards).alias("part"))
    first = _search(dealt, ["h", "part"], window, shard)

    # A table of digests alone: the windows' words are cut out again for those that meet others.
    kept = staged(_windows(ctx, first.where("open").select("h", "c1", "c2", "lo", "hi"), window).drop("codes"), "windows")
    several = staged(kept.groupBy("d1", "d2").agg(F.min("m").alias("a"), F.max("m").alias("z")).where("a < z").select("d1", "d2"), "several")
    meet = kept.join(several, ["d1", "d2"]).select("h", "c1", "c2", F.col("off").alias("lo"), F.col("off").alias("hi"))
    second = _search(_windows(ctx, meet, window).withColumn("split", F.lit(False)), ["d1", "d2"], window, shard)
    return first.where("NOT open").unionByName(second).drop("open")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, q1, q2, _th, n_words, whole_sha256, copy, spans: one row per input row.

    copy: the whole word sequence (of at least `window` words) is that of a document with a smaller id,
    so every word is repeated. Otherwise spans: array of (start, end) in words, end exclusive, that
    repeated windows cover (null: none; spans may overlap). Rows with a null doc_id neither repeat nor
    are repeated, equal ids are not smaller ones. Ids may be of any type that has an order.
    """
    base = staged(scan(docs, window, gram), "scan")
    firsts = base.where(F.col("n_words") >= window).groupBy("q1", "q2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = base.join(staged(firsts, "firsts"), ["q1", "q2"], "left").withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    seen = staged(seen.select("doc_id", "_th", "q1", "q2", "n_words", "whole_sha256", "later", F.when(~F.col("later") & F.col("doc_id").isNotNull(), F.col("anchors")).alias("anchors")), "seen")

    key = ["doc_id", "q1", "q2"]
    every = seen.select(*key, "_th", F.explode("anchors").alias("a")).select(*key, "_th", "a.*")
    groups = staged(every.groupBy("h", "c1", "c2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("mx")), "contexts")
    shared = groups.groupBy("h").agg(F.min("m").alias("hm"), F.max("mx").alias("hx"), F.count("*").alias("kinds")).where("hm < hx").drop("hx")
    known = staged(groups.drop("mx").join(staged(shared, "anchors"), "h"), "shared")
    spots = staged(every.join(known, ["h", "c1", "c2"]), "spots")

    settled = spots.where("doc_id > m").select(*key, F.col("s0").alias("start"), (F.col("s1") + window).alias("end"))
    # The smallest document of an anchor must be in the index, but has nothing to find.
    mine = spots.where("doc_id = m AND kinds > 1")
    ctx = staged(_context_words(docs, mine.dropDuplicates(["h", "c1", "c2"]), window), "words")
    found = search(ctx, window, hot, shard)
    searched = mine.join(found, ["h", "c1", "c2"]).select(*key, (F.col("s0") + F.col("lo")).alias("start"), (F.col("s0") + F.col("hi") + window).alias("end"))

    spans = settled.unionByName(searched).distinct().groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    out = seen.drop("anchors").join(staged(spans, "spans"), key, "left")
    return out.select(*key, "_th", "n_words", "whole_sha256", (F.col("later") & (F.col("n_words") >= window)).alias("copy"), "spans")


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, q1, q2, n_removed, kept (text) of the documents that have spans."""
    lists = found.where("spans IS NOT NULL").select("doc_id", "_th", "q1", "q2", "spans").dropDuplicates(["doc_id", "q1", "q2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, removed, texts = [], [], []
            for i, (t, a, c, spans) in enumerate(zip(*(b.column(k).to_pylist() for k in ("text", "q1", "q2", "spans")), strict=True)):
                w = _words_of(t)
                if digest(b" ".join(w)) != (a, c):
                    continue
                out, at = [], 0
                for s in spans:
                    out += w[at : s["start"]] if s["start"] > at else []
                    at = max(at, s["end"])
                out += w[at:]
                ok.append(i)
                removed.append(len(w) - len(out))
                texts.append(b" ".join(out).decode())
            keys = [b.column(k).take(pa.array(ok, pa.int64())) for k in ("doc_id", "q1", "q2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "q1", "q2", "n_removed", "kept"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_text(docs, lists).select("doc_id", "text", "q1", "q2", "spans").mapInArrow(run, f"doc_id {kind}, q1 bigint, q2 bigint, n_removed bigint, kept string")


def summary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row. No text: no words, nothing removed."""
    found = staged(repeats(docs, window), "repeats")
    cut = kept(docs, found).select("doc_id", "q1", "q2", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha")).dropDuplicates(["doc_id", "q1", "q2"])
    empty = hashlib.sha256(b"").hexdigest()
    out = found.join(staged(cut, "kept"), ["doc_id", "q1", "q2"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
    )
