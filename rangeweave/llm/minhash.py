"""Document fingerprints: one-permutation MinHash; DataFrame functions only.

Every five-word shingle is hashed once. The top bits of a hash name its bin. One sentinel per bin,
larger than any hash that the bin can hold, is sorted in with the hashes; the first entry of each bin
is then its minimum or, where the bin is empty, its sentinel. Empty bins are filled by optimal
densification: each bin has its own fixed order of bins to probe and takes the first that is not
empty. The low-order bits of the values are packed as hex digits (one digit a bin), and the share of
equal digits is corrected for the chance that different values agree in those bits.

All of it happens within a row: no shuffle, no explode, memory in proportion to one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, within

SHINGLE = 5
#: Bins of a fingerprint (a power of two) and bits kept of each bin's minimum.
BINS, BITS = 256, 4
#: Probes of the first densification pass; the second covers whatever order is left.
PROBES = 8
#: Documents of one ordered run, in following(), about; and the most runs, since their first keys (under
#: 50 bytes each) go to every executor. More documents make longer runs.
RUN, RUNS = 2_000, 1_000_000
_SHIFT = 64 - BINS.bit_length() + 1
_LOW = (1 << _SHIFT) - 1
_rng = np.random.Generator(np.random.PCG64(7))
_PROBE = _rng.integers(0, BINS, (PROBES, BINS)).tolist()


def _longs(values: list[int], kind: str = "bigint") -> Column:
    return F.expr(f"array({', '.join(map(str, values))})").cast(f"array<{kind}>")


def with_shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name: sorted hashes of the text's shingles and the sentinels (null: no words)."""
    w, h = f"_w_{name}", f"_h_{name}"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda x: F.xxhash64(x)))
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    df = df.withColumn(h, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))))
    marks = [((b - BINS // 2) << _SHIFT) | _LOW for b in range(BINS)]
    full = F.when(F.size(w) > 0, F.sort_array(F.concat(h, _longs(marks))))
    return df.withColumn(name, full).drop(w, h)


def with_bins(df: DataFrame, name: str) -> DataFrame:
    """Replaces with_shingles' name by its BINS low-order values, empty bins filled (null: no words)."""
    s, d, e, g = name, f"_d_{name}", f"_e_{name}", f"_g_{name}"
    first = lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))
    df = df.withColumn(d, F.filter(s, first))
    df = df.withColumn(e, F.transform(d, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x)))
    probes = [_longs(p, "int") for p in _PROBE]
    df = df.withColumn(g, F.transform(e, lambda x, b: F.coalesce(x, *(F.get(e, F.get(p, b)) for p in probes))))
    # What no probe met: the filled bin that comes first in the bin's own order of all bins.
    known = F.filter(F.transform(e, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda y: y["x"].isNotNull())
    df = df.withColumn(f"_k_{name}", F.when(F.exists(g, lambda x: x.isNull()), known))
    rest = lambda b: F.array_min(F.transform(f"_k_{name}", lambda y: F.struct(F.xxhash64(b, y["j"]).alias("r"), y["x"].alias("x"))))["x"]
    df = df.withColumn(g, F.when(F.col(f"_k_{name}").isNull(), F.col(g)).otherwise(F.transform(g, lambda x, b: F.coalesce(x, rest(b)))))
    # A value that fills several bins is hashed with the bin, or else its few bits would agree by chance in all of them.
    own = lambda x, b: F.when(F.get(e, b).isNull(), F.xxhash64(x, b)).otherwise(x)
    full = F.transform(g, lambda x, b: own(x, b).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return df.withColumn(name, full).drop(d, e, g, f"_k_{name}")


def packed(bins: str) -> Column:
    """The fingerprint as text: a hex digit for each bin; empty where there are no words."""
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.substring(F.lit("0123456789abcdef"), x + 1, F.lit(1))), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated share of shingles in common, corrected for chance agreement of BITS bits.

    Two documents without words are alike (1), one without and one with words are not (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / BINS
    chance = 2.0**-BITS
    fair = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).otherwise(F.coalesce(fair, F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bins (array of BINS ints; null: no words), fingerprint: one row per input row."""
    df = with_bins(with_shingles(text_of(docs), "text", "bins"), "bins")
    return df.select("doc_id", "bins", packed("bins").alias("fingerprint"))


def _firsts(docs: DataFrame) -> DataFrame:
    """One row, keys: the first key (doc_id, _th) of every run, ascending.

    Runs are ranges of the keys, so they are about even whatever the ids look like, of any type that
    has an order, and rows that share an id (or have none) are dealt by their text.
    """
    keys = docs.select("doc_id", "_th")
    n = docs.count()
    parts = max(1, -(-n // max(RUN, -(-n // RUNS))))
    first = keys.repartitionByRange(parts, "doc_id", "_th").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "_th")).alias("k"))
    return staged(first.select("k"), "runs").agg(F.sort_array(F.collect_list("k")).alias("keys"))


def _run(keys: Column, coarse: Column, step: int) -> Column:
    """The run of a row with doc_id and _th: the last key that is not after it.

    coarse: every step-th key. It names the stretch of keys to look through, so a row compares with some 2 * sqrt(runs) keys.
    """
    mine = F.struct("doc_id", "_th")
    c = F.size(F.filter(coarse, lambda x: x <= mine))
    return (c - 1) * step + F.size(F.filter(F.slice(keys, (c - 1) * step + 1, F.lit(step)), lambda x: x <= mine)) - 1


def following(docs: DataFrame) -> tuple[DataFrame, object, Column]:
    """docs (doc_id, text) in ordered runs, the window in which a row is followed by its next
    document, and the condition for a row to be one of docs.

    Each run ends with a copy of the first row of the next run (after the last run: of the first),
    so that every document's next one is in its own run; text is shuffled once.
    """
    d = text_of(docs).withColumn("_th", F.xxhash64("text"))
    one = _firsts(d)
    n = one.select(F.size("keys")).first()[0]
    step = max(1, round(n**0.5))
    coarse = one.select(F.filter("keys", lambda x, i: i % step == 0)).scalar()
    d = d.withColumn("_keys", one.scalar()).withColumn("_coarse", coarse)
    d = d.withColumn("_b", _run(F.col("_keys"), F.col("_coarse"), step) if n else F.lit(0)).drop("_keys", "_coarse")
    first = one.select(F.posexplode("keys").alias("_k", "_f")).select(F.col("_f.doc_id").alias("_f"), F.col("_f._th").alias("_h"), F.when(F.col("_k") == 0, n - 1).otherwise(F.col("_k") - 1).alias("_to"))
    edge = within(d, first, F.col("doc_id").eqNullSafe(F.col("_f")) & (F.col("_th") == F.col("_h"))).select("doc_id", "text", F.col("_to").alias("_b"), "_th", F.lit(True).alias("_edge"))
    rows = d.select("doc_id", "text", "_b", "_th", F.lit(False).alias("_edge")).unionByName(edge)
    return rows, Window.partitionBy("_b").orderBy("_edge", "doc_id", "_th"), ~F.col("_edge")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, bins, edited_bins, next_bins: one row per input row.

    A document's edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document by ascending doc_id; the last is followed by the first, and a single
    document by itself. Rows with one doc_id follow each other by their texts' hash; null ids come
    first. Ids may be of any type that has an order.
    """
    rows, w, real = following(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_next", F.lead("text").over(w)).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.coalesce(F.substring("_next", F.lit(1), half), F.lit("")))).drop("_next")
    rows = with_bins(with_shingles(rows, "text", "bins"), "bins")
    rows = rows.withColumn("next_bins", F.lead("bins").over(w)).where(real)
    rows = with_bins(with_shingles(rows, "edited", "edited_bins"), "edited_bins")
    return rows.select("doc_id", "n_chars", "edited", "bins", "edited_bins", "next_bins")
