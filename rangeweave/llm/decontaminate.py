"""Benchmark decontamination on a positional inverted index; DataFrame functions only.

1. Corpus frequencies of the test terms: one scan, map-side counts. A test phrase lists its
   (term, offset) pairs from the rarest to the commonest; one with a term that no document has cannot
   occur and goes.
2. The index: a second scan stores the postings (term, document, position) of the ``LEAD`` rarest terms
   of the phrases, sorted by term in each file.
3. Intersection, rarest first: each posting of a phrase's rarest term proposes a start; the starts
   that have no posting of the next term at their offset go, list by list, by joins on (document,
   position, term). The commoner terms of what is left are met in the postings of the documents that
   are left, the only ones to be indexed for them.
4. Proximity: a posting of the rarest term, with the other leading terms at most ``SPAN`` words away.

Two scans read the whole corpus, however many phrases there are, and none shuffles text. A phrase side is
broadcast only where its size, counted first, is within ``common.within``'s bound; beyond it, it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms of a phrase whose postings are kept for the whole corpus.
LEAD = 3
#: Words between the leading terms of a proximity match, at most.
SPAN = 26
KEY = ["doc_id", "_th"]


def fold(c: Column) -> Column:
    """A-Z lower-cased, nothing else; all-ASCII words take the quick way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    """Not yet lower-cased."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash: together they are the key of a document."""
    return text_of(docs).withColumn("_th", F.xxhash64("text"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, terms (array): every run of `size` words; an item of fewer words is one run."""
    t = items.select("item_id", F.transform(words(F.coalesce("text", F.lit(""))), fold).alias("_w"))
    n = F.size("_w")
    starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    return t.where(n > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("terms")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in docs of the given distinct terms."""
    # explode_outer: explode would add a filter that tokenises every text once more.
    tokens = text_of(docs).select(F.explode_outer(words(F.col("text"))).alias("_raw")).select(F.coalesce(fold(F.col("_raw")), F.lit("")).alias("term"))
    return within(tokens, terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def ranked(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """phrase, size, lists (array of (at, term), rarest first), lead (its first LEAD) of the phrases that can occur.

    phrases: phrase (key), terms (array). Equally rare terms come by their offset.
    """
    each = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    counts = staged(term_counts(docs, staged(each.select("term").distinct(), "terms")), "term-counts")
    lists = each.join(counts, "term").groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("_l"))
    lists = lists.where(F.size("_l") == F.col("size"))  # at most as long as a phrase
    pairs = F.transform("_l", lambda x: F.struct(x["at"].alias("at"), x["term"].alias("term")))
    return lists.select("phrase", "size", pairs.alias("lists"), F.slice(pairs, 1, LEAD).alias("lead"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, _th, position (from 0): the stored postings of the given distinct terms.

    Each row of docs also has a posting of "", which is no term; its position is the number of its words.
    """
    tokens = _documents(docs).select(*KEY, F.concat(words(F.col("text")), F.array(F.lit(""))).alias("_w"))
    each = tokens.select(*KEY, F.posexplode_outer("_w").alias("position", "_raw"))
    each = each.select(F.coalesce(fold(F.col("_raw")), F.lit("")).alias("term"), *KEY, "position")
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    return staged(within(each, wanted, "term", "left_semi").sortWithinPartitions("term"), "index")


def lead_index(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """The index of the leading terms of ranked phrases."""
    return index(docs, staged(phrases.select(F.explode("lead.term").alias("term")).distinct(), "lead-terms"))


def _posted(need: DataFrame, postings: DataFrame, near: Column) -> DataFrame:
    """The rows of need (doc_id, _th, term, ...) that have a posting in their document for which near holds (of _p)."""
    p = postings.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("_th").alias("_h"), F.col("position").alias("_p"), F.expr(f"position div {SPAN}").alias("_b"))
    return need.join(p, (F.col("term") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")) & near, "left_semi")


def _seeds(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, doc_id, _th, position, at: each posting of a phrase's rarest term, and the term's offset."""
    first = phrases.select("phrase", F.col("lead")[0]["term"].alias("term"), F.col("lead")[0]["at"].alias("at"))
    return within(postings, first, "term").select("phrase", *KEY, "position", "at").distinct()


def _each_lead(found: DataFrame, phrases: DataFrame, keep) -> DataFrame:
    """found (phrase, ...) after keep(rows with term and at) for the second and later leading terms in turn."""
    for d in range(1, LEAD):
        term = F.get("lead", F.lit(d))
        need = within(found, phrases.select("phrase", term["term"].alias("term"), term["at"].alias("at")), "phrase")
        found = need.where("term IS NULL").unionByName(keep(need.where("term IS NOT NULL"))).drop("term", "at")
    return found


def phrase_matches(docs: DataFrame, phrases: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """doc_id, _th, phrase, start (from 0), size: every occurrence of the ranked phrases, once a document."""
    postings = lead_index(docs, phrases) if postings is None else postings
    at_start = F.col("start") + F.col("at") == F.col("_p")
    found = _seeds(postings, phrases).select("phrase", *KEY, (F.col("position") - F.col("at")).alias("start")).where("start >= 0")
    found = staged(_each_lead(found, phrases, lambda need: _posted(need, postings, at_start)), "survivors")
    met = within(found, phrases.select("phrase", "size", F.slice("lists", LEAD + 1, 1 << 30).alias("rest")), "phrase")
    named = staged(found.select(*KEY).distinct().toDF("_d", "_h"), "surviving-documents")
    terms = phrases.join(found.select("phrase").distinct(), "phrase", "left_semi").select(F.explode("lists.term").alias("term")).distinct()
    left = within(_documents(docs), named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left_semi")
    # A document that is repeated is indexed as often; a semi join doesn't mind.
    rest = index(left, staged(terms, "surviving-terms"))
    need = met.select("phrase", *KEY, "start", "size", F.explode("rest").alias("r")).select("phrase", *KEY, "start", "size", "r.term", "r.at")
    whole = _posted(need, rest, at_start).groupBy("phrase", *KEY, "start", "size").agg(F.count("*").alias("n")).where(F.col("n") == F.col("size") - LEAD)
    return met.where(F.size("rest") == 0).select(*KEY, "phrase", "start", "size").unionByName(whole.select(*KEY, "phrase", "start", "size"))


def proximity_matches(docs: DataFrame, phrases: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """doc_id, _th, phrase, position: postings of a ranked phrase's rarest term with the other leading terms within SPAN words."""
    postings = lead_index(docs, phrases) if postings is None else postings

    def keep(need: DataFrame) -> DataFrame:
        around = need.withColumn("_x", F.explode(F.array(*(F.expr(f"position div {SPAN} + {d}") for d in (-1, 0, 1)))))
        near = (F.col("_x") == F.col("_b")) & (F.abs(F.col("position") - F.col("_p")) <= SPAN)
        return _posted(around, postings, near).drop("_x").distinct()

    return _each_lead(_seeds(postings, phrases).drop("at"), phrases, keep).select(*KEY, "phrase", "position")


def _items(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, _th, item (distinct) of matches (doc_id, _th, phrase); ids: phrase, item."""
    return matches.select(*KEY, "phrase").distinct().join(ids, "phrase").select(*KEY, "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, hashed: bool = False, near: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array of item ids as strings, sorted), contaminated.

    hashed: _th, the hash of the text, after doc_id. near: n_near, the items with a window that has a
    proximity match, at the end.

    One row per input row. No text or no words: all zero, not contaminated. Items without words never
    occur; rows of one item_id belong to one item; a null item_id counts as the item "". No items:
    nothing is contaminated. A document word is hit once, however many windows cover it. Equal rows
    are one document to the index.
    """
    docs = docs.select("doc_id", "text")
    wins = staged(windows(items, size).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "terms"), "windows")
    ids = staged(wins.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    named_by = ids.join(wins, "terms").select("phrase", "item")
    phrases = staged(ranked(ids, docs), "ranked")
    postings = lead_index(docs, phrases)
    matches = staged(phrase_matches(docs, phrases, postings), "occurrences")

    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*KEY).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    found = matches.select(*KEY, "start", "size").distinct().withColumn("_n", fresh).groupBy(*KEY).agg(F.sum("_n").alias("n_hit"))
    found = found.select(*KEY, "n_hit", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("long").alias("n_near"))
    listed = _items(matches, named_by).groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.unionByName(listed, allowMissingColumns=True)
    if near:
        close = _items(proximity_matches(docs, phrases, postings), named_by).groupBy(*KEY).agg(F.count("*").alias("n_near"))
        found = found.unionByName(close, allowMissingColumns=True)
    found = found.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("n_hit", "items", "n_near"))).withColumnsRenamed({"doc_id": "_d", "_th": "_h"})

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    d = postings.where("term = ''").select(*KEY, F.col("position").cast("long").alias("n_words"))
    out = d.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left").select(
        *(KEY if hashed else KEY[:1]), "n_words", zero("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), zero("n_near")
    )
    return out.select(
        *(KEY if hashed else KEY[:1]), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *(["n_near"] if near else []),
    )
