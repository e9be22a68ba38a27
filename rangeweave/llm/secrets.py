"""Secret scans with corpus-wide ownership; DataFrame functions only.

Candidates come from one scan: a pattern's matches and the text between them give every match its
place without a UDF. Each candidate value's hash is then counted over the corpus, first per owner
(map-side), then over owners: a value that many owners have is a copied example, one that few have is
owner-specific. Base kinds are always reported; the generic kind ``live`` only where its value is
owner-specific. Text is never shuffled, only matches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, staged, text_of

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Generic tokens: long runs; those with a digit, a capital and a small letter are candidates.
LIVE = r"[A-Za-z0-9+/_-]{20,}"
MIN_ASSIGN = 8
KINDS = ("assign", "access", "hex", "live")
#: A value is owner-specific when at most this many owners have it ...
MAX_OWNERS = 1
#: ... in at most this many repositories.
MAX_REPOSITORIES = 20


def _pieces(pattern: str, hint: str) -> Column:
    """(text before, match) pairs; the last has no match. Null where the hint is not in the text."""
    cut = F.arrays_zip(F.split("text", pattern, -1).alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(F.col("text").rlike(hint), cut)


def candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """doc_id, _th, repository, owner, kind (index), start, end, value: matches in every whole text.

    Positions count code points, the end is exclusive. Rows equal in id and text are one document.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    d = d.withColumn("_th", F.xxhash64("text"))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), _pieces(*p).alias("z")) for i, p in enumerate([(ASSIGN, ASSIGN_HINT), (ACCESS, ACCESS), (HEX, HEX), (LIVE, LIVE)])))
    key = ["doc_id", "_th"]
    rows = d.select(*key, "repository", "owner", F.explode(kinds).alias("k")).where("k.z IS NOT NULL")
    rows = rows.select(*key, "repository", "owner", "k.kind", F.posexplode("k.z").alias("at", "x")).where("x.m IS NOT NULL")
    rows = rows.select(*key, "repository", "owner", "kind", "at", F.length("x.p").alias("gap"), F.col("x.m").alias("match"))
    rows = rows.repartition(*key).dropDuplicates([*key, "kind", "at"])
    w = Window.partitionBy(*key, "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    out = rows.withColumn("end", end).withColumn("value", value).withColumn("start", F.col("end") - F.length("match"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    good = F.when(F.col("kind") == 0, F.length("value") >= MIN_ASSIGN).when(F.col("kind") == 3, mixed).otherwise(True)
    return out.where(good).select(*key, "repository", "owner", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners, n (candidates) of every candidate value. A null owner or repository is one of its own."""
    each = found.select(F.sha2("value", 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("c"))
    per_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("c").alias("c"))
    return per_owner.groupBy("hash").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("c").alias("n"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, _th, spans: array of (start, kind index, end, kind, n_repositories, n_owners, specific), sorted.

    Only documents with spans have a row. ``live`` spans that overlap a base span or whose value is
    not owner-specific are left out.
    """
    found = staged(candidates(docs, repository, owner), "candidates")
    seen = staged(ownership(found), "ownership")
    key = ["doc_id", "_th"]
    base = F.col("kind") < 3
    w = Window.partitionBy(*key).orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    free = base | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end")))
    clear = found.withColumn("_free", free).where("_free").withColumn("hash", F.sha2("value", 256))
    specific = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    known = join_hot(clear, seen, "hash", "n").withColumn("specific", specific).where(base | F.col("specific"))
    span = F.struct("start", "kind", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("name"), "n_repositories", "n_owners", "specific")
    return known.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, spans (see scan; empty where there are none): one row per input row."""
    d = text_of(docs).select("doc_id", F.xxhash64("text").alias("_h"))
    s = scan(docs, **how).withColumnRenamed("doc_id", "_d")
    out = d.join(s, d["doc_id"].eqNullSafe(s["_d"]) & (d["_h"] == s["_th"]), "left")
    kind = s.schema["spans"].dataType
    return out.select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


#: Spans that may be in a broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 500_000


def redact(docs: DataFrame, mark: str = "[secret]", **how) -> DataFrame:
    """docs with every span replaced by the mark (overlapping spans by one); all columns, all rows."""
    s = staged(scan(docs, **how).select(F.col("doc_id").alias("_d"), "_th", "spans"), "spans")
    if (s.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        s = F.broadcast(s)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")  # names in docs can't meet ours
    d = docs.select(row, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).withColumn("text", F.col("_row.text"))
    out = d.join(s, d["_row.doc_id"].eqNullSafe(s["_d"]) & (d["_h"] == s["_th"]), "left")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        new = F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"].cast("int")).alias("at"), new.alias("parts"))

    def text(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.length("text")))

    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", state, step, text))
    return out.select(*(clean.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
