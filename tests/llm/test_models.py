"""BPE against tiktoken, classifiers on held-out rows, language ID, and the odd inputs of each."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rangeweave.llm import bpe, langid, learn, quality, toxicity
from rangeweave.llm import queries as q


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(q.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(ranks):
    keys = list(ranks)[:5000]
    h = bpe.PerfectHash(keys)
    assert sorted(h.index(k) for k in keys) == list(range(5000)) and len(h.slots) == 5000
    assert bpe.PerfectHash([b"a"]).index(b"a") == 0
    assert bpe.Coder({}, public_tokenizers.PATTERN).ready().encode("") == b""


def test_encode_like_tiktoken(ranks, reference):
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN).ready()
    rng = random.Random(5)
    texts = ["", " ", "\n\n  x", "don't we'll I'M", "<|endoftext|>", "ab" * 20000, "日本語🎉é" * 50, "\x00\x01", " " * 5000 + "a"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), 0x3000, 10, 39, 32])) for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_round_trip(docs, rows, nothing, ranks, reference):
    got = {(r["doc_id"], bytes(r["decoded"])): bytes(r["ids"]) for r in bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()}
    for d, t in rows:
        assert np.frombuffer(got[d, (t or "").encode()], "<u4").tolist() == reference.encode_ordinary(t or "")
    assert bpe.round_trip(nothing, ranks, public_tokenizers.PATTERN).count() == 0
    enc = docs.sparkSession.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id bigint, ids binary")
    assert [bytes(r["decoded"]) for r in bpe.decode(enc, ranks).collect()] == [b"", b""]


def test_op1(spark, data, reference):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect())
    for r in q.op1_bpe(spark, data).collect():
        ids = np.array(reference.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def accuracy(spark, scored, label):
    d = "/root/testdata/sf0.01"
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    return {v: np.mean([r["predicted"] == v for r in rows if r[label] == v]) for v in (0, 1)}


def test_quality_held_out(spark):
    got = accuracy(spark, q.op8_quality(spark, "/root/testdata/sf0.01"), "quality")
    assert got[1] >= 0.98 and got[0] >= 0.75


def test_toxicity_held_out(spark):
    got = accuracy(spark, q.op10_toxicity(spark, "/root/testdata/sf0.01"), "toxic")
    assert got[0] >= 0.98  # some 30 examples teach little of the words that make a text toxic
    rng = random.Random(8)
    insults = ["moron", "morons", "stupid", "stupidly", "trash", "clowns", "clown"]

    def text(bad):
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        for _ in range(2 * bad):
            w.insert(rng.randrange(40), rng.choice(insults) + rng.choice(["", ",", "!"]))
        return " ".join(w)

    many = pd.DataFrame([(text(k % 4 == 0), int(k % 4 == 0)) for k in range(1500)], columns=["text", "label"])
    scored = toxicity.train(many[:1000]).scorer()
    caught = [scored(t) >= 0.5 for t, y in many[1000:].itertuples(index=False) if y]
    assert np.mean(caught) >= 0.9 and not any(scored(t) >= 0.5 for t, y in many[1000:].itertuples(index=False) if not y)
    x = pd.DataFrame({"text": ["you are a moron today", "a nice day it is", "such scum here", "all is well there"] * 60, "label": [1, 0, 1, 0] * 60})
    score = toxicity.train(x).scorer()
    assert score("what a moron") > 0.5 > score("what a day")


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = q.op9_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_phrases_are_longest_matches():
    model = langid.Model.of({"x": "abcabcabd", "y": "zzz"})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdz ") for _ in range(rng.randrange(1, 700))) for _ in range(20)]
    for k, sample in enumerate(("abcabcabd", "zzz")):
        for t, got in zip(texts, model.phrases(texts)[:, k], strict=True):
            n = 0
            for part in (t[i : i + langid.CHUNK] for i in range(0, len(t), langid.CHUNK)):
                i = 0
                while i < len(part):
                    m = 1
                    while i + m < len(part) and part[i : i + m + 1] in sample and part[i : i + m] in sample:
                        m += 1
                    i, n = i + m, n + 1
            assert got == n


def test_letters_alone_tell_a_language(spark):
    rng = random.Random(4)
    script = [chr(0x4E00 + k) for k in range(6000)]
    zh = ["".join(rng.choice(script) for _ in range(rng.randrange(20, 300))) for _ in range(60)]
    en = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "zh") for i, t in enumerate(zh)] + [(100 + i, t, "en") for i, t in enumerate(en)] + [(300, "long " * 100_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 10 > 0)
    assert model.langs == ["en", "zh"]
    asked = spark.createDataFrame([(1, "½ ² ③"), (2, "Ⅻ 12 _"), (3, zh[10]), (4, "the mat"), (5, None), (6, "12 é")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, model).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("und", "und", "zh", "en", "und") and got[6] != "und"
    assert langid.Model.of({"b": "xyz", "a": "xyz"}).predict(["xyz"]) == (["a"], [0.0])  # a tie


def test_language_is_of_the_least_cost():
    rng = random.Random(6)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(4000)), "y": "".join(rng.choice("bcd ") for _ in range(900))}
    model = langid.Model.of(samples)
    texts = [langid.plain("".join(rng.choice(("abc ", "bcd ", "abcd ")[k % 3]) for _ in range(rng.randrange(40, 1500)))) for k in range(30)]
    plain = {k: langid.plain(v) for k, v in samples.items()}

    def cost(text, sample):
        n = 0
        for part in (text[i : i + langid.CHUNK] for i in range(0, len(text), langid.CHUNK)):
            i = 0
            while i < len(part):
                m = 1
                while i + m < len(part) and part[i : i + m + 1] in sample:
                    m += 1
                i, n = i + m, n + 1
        return n * np.log2(2 + len(sample))

    want = [min(plain, key=lambda k: (cost(t, plain[k]), k)) for t in texts]
    assert model.predict(texts)[0] == want and len(set(want)) == 2


def test_quality_scorer_is_a_plain_forward_pass():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "bbb", "ccé", "dd|", "x" * 90, "$$$"]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    model = quality.train(pd.DataFrame({"text": texts, "label": [int("|" not in t) for t in texts]}))
    got = model.scorer()(texts + [None])
    for t, s in zip([*texts, ""], got, strict=True):
        ids, share = quality.features(t)
        z = model.bias + float(np.dot(model.weights[ids], share))
        assert s == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    a, b, c = (quality.pairs(quality.keys_of(w)).tolist() for w in ([b"a", b"a", b"a"], [b"zz", b"zz"], [b"a", b"zz", b"a"]))
    assert a[0] == a[1] and len({a[0], *b, *c}) == 4  # a pair is its two words in order


def test_ftrl_is_the_dense_recursion(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(60)]
    y = [int("aaa" in t) for t in texts]
    got = toxicity.train(pd.DataFrame({"text": texts, "label": y}))
    x = np.zeros((len(texts), toxicity.BUCKETS), dtype=np.float32)
    f = toxicity.Features()
    for i, t in enumerate(texts):
        x[i, f(t)] = 1
    used = np.nonzero(x.any(axis=0))[0]
    x = x[:, used].astype(float)
    z, n = np.zeros(len(used)), np.zeros(len(used))
    bias, squares = np.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5)), 1.0
    w = lambda: np.where(np.abs(z) <= toxicity.L1, 0, -(z - np.sign(z) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n)) / toxicity.ALPHA + toxicity.L2))
    order = np.random.default_rng(5)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(y)):
            g = 1 / (1 + np.exp(-(bias + x[i] @ w()))) - y[i]
            step = g * x[i]
            sigma = (np.sqrt(n + step**2) - np.sqrt(n)) / toxicity.ALPHA
            z, n = z + step - sigma * w(), n + step**2
            squares += g * g
            bias -= toxicity.ALPHA * g / np.sqrt(squares) / 4
    assert got.bias == pytest.approx(bias)
    assert dict(zip(got.index.tolist(), got.value.tolist(), strict=True)) == pytest.approx({int(k): v for k, v in zip(used, w(), strict=True) if v}, rel=1e-4)


def test_an_oversized_text_is_left_out_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (500 if i % 7 == 3 else 10)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = learn.labelled_sample(docs, labels, "quality", F.lit(True), 100, 450)
    assert len(got) == 34 and got["text"].str.len().max() == 10


def test_models_on_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 0, 0), (None, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    for m in (quality, toxicity):
        model = m.fit(docs, labels, F.lit(True))
        got = m.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert m.score(nothing, m.fit(nothing, labels.limit(0), F.lit(True))).count() == 0
    assert quality.keep_good(docs, quality.fit(docs, labels, F.lit(True)), 0.0).count() == docs.count()
    model = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[133]["lang_pred"] == got[134]["lang_pred"] == got[132]["lang_pred"] == "und"
    assert langid.identify(docs, langid.fit(nothing, F.lit(True))).where("lang_pred <> 'und'").count() == 0
