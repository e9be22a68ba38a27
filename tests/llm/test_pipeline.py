"""Every stage of the pipeline, and its whole, against brute force."""

import hashlib
from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rangeweave.llm import bpe, quality, simhash
from rangeweave.llm.common import crc_mod, new_path
from tests.llm import brute


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, None
    score = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), crc_mod(3) != 1).scorer()
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            want = {d: t for d, t in rows.items() if score([t])[0] >= 0.5}
        elif k == 1:
            least = {d: c for d, _, c in brute.simhash(list(rows.items()))}
            want = {d: t for d, t in rows.items() if least[d] == d}
        elif k == 2:
            bad = {d for (d, _), v in brute.decontaminate(list(rows.items()), items).items() if v[4]}
            want = {d: t for d, t in rows.items() if d not in bad}
        elif k == 3:
            assert kept.keys() == rows.keys()
            for d, t in rows.items():
                spans = brute.base_spans(t)
                assert (kept[d] == t) or "[secret]" in kept[d]
                for s, _, e, _ in spans:
                    assert t[s:e] not in kept[d]
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
            want = kept
        else:
            got = {r["doc_id"]: r for r in docs.collect()}
            assert got.keys() == rows.keys()
            for d, t in rows.items():
                ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes()
                assert bytes(got[d]["ids"]) == ids and got[d]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
            continue
        assert kept == want
        assert len(kept) > 0.5 * len(rows)
        rows = kept
    tables = Path(new_path(spark, "x")).parent
    before = set(tables.iterdir()) if tables.exists() else set()
    whole = cp.run(spark, data)
    assert [p.name.rsplit("-", 1)[0] for p in set(tables.iterdir()) - before] == ["secret-scans"]
    assert {r["doc_id"]: bytes(r["ids"]) for r in whole.collect()} == {d: bytes(r["ids"]) for d, r in got.items()}


def test_repeated_and_null_rows(spark, data, docs):
    out = cp.near_duplicate_stage(spark, docs, data)
    kept = Counter((r["doc_id"], r["text"] or "") for r in out.collect())
    assert max(kept.values()) == 1 and sum(d == 7 for d, _ in kept) == 2 and out.columns == docs.columns
    assert cp.decontamination_stage(spark, docs, data).columns == docs.columns
    assert cp.secrets_stage(spark, docs, data).count() == docs.count()
    assert cp.bpe_stage(spark, docs.limit(0), data).count() == 0


def _told_apart(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def _rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_go_by_row(spark, data):
    a, b, c, d, e, f = (" ".join(f"{name}{k}" for k in range(60)) for name in "abcdef")
    texts = [(7, a), (7, b), (3, b), (8, c), (8, d), (8, d), (9, d), (None, a), (None, e), (None, e), (None, f), (10, a)]
    want = Counter([(7, a), (3, b), (8, c), (8, d), (None, e), (None, f)])
    assert _rows(cp.near_duplicate_stage(spark, _told_apart(spark, texts), data)) == want
    hot = [(1, " ".join(f"{name}x{k}" for k in range(30))) for name in range(50)]
    assert _rows(cp.near_duplicate_stage(spark, _told_apart(spark, hot), data)) == Counter(hot)


def test_near_duplicates_against_brute_force(spark, data, docs, rows):
    fps = {t or "": simhash.fingerprint(t or "") for _, t in rows}
    groups = []
    for fp in set(fps.values()):
        near = [g for g in groups if any((fp ^ x).bit_count() <= simhash.RADIUS for x in g)]
        groups = [g for g in groups if g not in near] + [{fp}.union(*near)]
    got = cp.near_duplicate_stage(spark, docs, data).collect()
    kept = {}
    for r in got:
        (g,) = (k for k, x in enumerate(groups) if fps[r["text"] or ""] in x)
        assert g not in kept
        kept[g] = r["doc_id"]
    for k, g in enumerate(groups):
        ids = [i for i, t in rows if fps[t or ""] in g and i is not None]
        assert kept[k] == min(ids, default=None)


def test_contaminated_rows_go_by_row(spark, tmp_path):
    leak, clean = " ".join(f"t{k}" for k in range(20)), " ".join(f"c{k}" for k in range(20))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, leak), (1, clean), (None, leak), (None, clean), (None, None), (2, leak), (2, leak), (3, clean)]
    got = cp.decontamination_stage(spark, _told_apart(spark, texts), str(tmp_path))
    assert _rows(got) == Counter([(1, clean), (None, clean), (None, None), (3, clean)])


#: Names that the stages and operators use inside.
INSIDE = "_th _d _h _row _n _p _b _k _f _t fp n kept least words key spans item items phrase term position start end kind value doc h g _left".split()


def test_extra_columns_with_inside_names_stay_as_they_are(spark, data):
    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in "abc")
    texts = [(1, a, 0), (2, a, 1), (3, b, 2), (3, b, 3), (4, c, 4), (None, c, 5), (5, "password=abcdefgh12 " + c[:90], 6), (6, None, 7)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *(f"{n}{k}" for n in INSIDE)) for d, t, k in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in INSIDE)).repartition(3)
    rows = {n: {f"{n}{k}" for _, _, k in texts} for n in INSIDE}
    found = []
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        got = out.collect()
        found.append(len(got))
        for r in got:
            (k,) = {r[n].removeprefix(n) for n in INSIDE}
            assert all(r[n] in rows[n] for n in INSIDE)
            assert (r["doc_id"], name == cp.STAGES[3][0] or r["text"]) in [(d, name == cp.STAGES[3][0] or t) for d, t, at in texts if at == int(k)]
    assert found == [5, 8, 8]
    near = {r["doc_id"]: r["h"] for r in cp.near_duplicate_stage(spark, docs, data).collect()}
    assert near == {1: "h0", 3: "h2", 4: "h4", 5: "h6", 6: "h7"}  # of equal documents the first by the other columns


@pytest.mark.parametrize("bits", [1 << 28, 1 << 7])
def test_many_named_documents(spark, data, docs, monkeypatch, bits):
    """Beyond the bound of a broadcast the same rows come out, whatever the filter lets through."""
    stages = (cp.near_duplicate_stage, cp.decontamination_stage)
    want = [Counter(map(str, s(spark, docs, data).collect())) for s in stages]
    monkeypatch.setattr(cp, "BROADCAST_IDS", -1)
    monkeypatch.setattr(cp, "FILTER_BITS", bits)
    assert [Counter(map(str, s(spark, docs, data).collect())) for s in stages] == want
    packed = docs.select(F.struct("doc_id", "text").alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    found = packed.where("_row.doc_id % 3 = 0 OR _row.doc_id IS NULL").select(F.col("_row.doc_id").alias("_d"), F.col("_th").alias("_h"))
    named = cp._named(packed, found)
    inside = F.coalesce(F.col("_row.doc_id") % 3 == 0, F.lit(True))
    assert named.count() == docs.count() and named.where(inside & ~F.col("_maybe")).isEmpty()
    assert bits == 1 << 7 or named.where(~inside & F.col("_maybe")).isEmpty()
    assert named.where("_maybe").count() >= found.count()
