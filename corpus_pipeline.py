"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, secret scan, BPE.

Each stage takes all rows that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm import bpe, decontaminate, quality, secrets, simhash
from rangeweave.llm.common import crc_mod, new_path, passing, remove, staged, table

#: Documents that may be named in a broadcast (16 bytes each). More are joined by a shuffle, of the rows that a filter can't rule out.
BROADCAST_IDS = 1_000_000
#: Bits of that filter: 32 MB, however many documents are named.
FILTER_BITS = 1 << 28
#: Rows that share a doc_id are told apart by the hash of their text.
DOCUMENT = ["doc_id", "_th"]


def _bit(*document: str) -> Column:
    return F.pmod(F.xxhash64(*document), F.lit(FILTER_BITS)) + 1


def _named(packed: DataFrame, found: DataFrame) -> DataFrame:
    """packed with _maybe: false where the document surely is not in found. No row moves; the bitmap has FILTER_BITS bits at most."""
    bits = found.select(_bit("_d", "_h").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    at = packed.withColumn("_bit", _bit("_row.doc_id", "_th"))
    met = at.join(F.broadcast(bits), F.bitmap_bucket_number("_bit") == F.col("_slot"), "left")
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.select("_row", "_th", (F.coalesce(F.getbit(byte, (place % 8).cast("int")), F.lit(0)) == 1).alias("_maybe"))


def _meeting(docs: DataFrame, documents: DataFrame, how: str) -> DataFrame:
    """_row (all columns of docs, whatever their names) and _th of docs, joined by document ("left_anti" or "left_semi"); a null id is an id like others."""
    found = documents.select(*DOCUMENT).distinct().toDF("_d", "_h")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_th"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h"))
    if found.count() <= BROADCAST_IDS:
        return packed.join(F.broadcast(found), same, how)
    marked = _named(packed, found)
    met = marked.where("_maybe").drop("_maybe").join(found, same, how)
    return met if how == "left_semi" else met.unionByName(marked.where("NOT _maybe").drop("_maybe"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def without(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """docs but those whose doc_id and text are in documents (doc_id, _th)."""
    return _unpacked(_meeting(docs, documents, "left_anti"), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows that op8 learns from."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(3) != 1))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: of the smallest doc_id (null last), then the least text hash.

    Of rows equal in both, the one that comes first by its other columns (but maps, which have no order).
    """
    found = staged(simhash.keepers(docs), "keepers")
    out = without(docs, found.where("NOT kept"))
    often = staged(found.where("kept AND n > 1"), "repeated")
    if often.isEmpty():
        return out
    ordered = [F.col("_row")[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    met = _meeting(out, often, "left_semi").groupBy(F.col("_row.doc_id").alias("_d"), "_th")
    once = met.agg(F.min_by("_row", F.struct(F.lit(0), *ordered)).alias("_row"))
    return without(out, often).unionByName(_unpacked(once, docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, with an id or without."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), hashed=True)
    return without(docs, staged(found.where("contaminated").select(*DOCUMENT), "contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", bpe_stage),
]
#: A learned classifier and a hash over merges are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another, each written and read again: a row a kept document, as `bpe_stage` returns them.

    A null text counts as empty; empty texts are judged like others (they are near-duplicates of one another, so one stays). Very long
    texts are taken whole. Rows that share a doc_id are told apart by their text; null ids are ids. Extra columns are carried up to the
    last stage, whatever their names. An empty table gives an empty result. Of the tables that the stages write only the last is left.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with passing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
