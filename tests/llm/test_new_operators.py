"""Packing, search and repair against plain versions: nulls, empties, ties, repetitions, clashing columns, long texts."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from rangeweave.llm import lexical, packing, repair
from tests.llm import brute_new

PATH = public_tokenizers.path("byte_bpe_50k.json")
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# -- packing -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [(d, [*x.ids, 0]) for (d, _), x in zip(rows, t.encode_batch([t or "" for _, t in rows], add_special_tokens=False))]


def test_pieces_are_the_tokenizers_ids(docs, tokens):
    import zlib

    want = Counter()
    for d, ids in tokens:
        at = 0
        for k, to in enumerate(range((len(ids) - 1) % 100 + 1, len(ids) + 1, 100)):
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at = to
    assert counted(packing.pieces(docs, PATH, 100).drop("rid")) == want


@pytest.mark.parametrize("text", ["a  b\n\n c \t", "  lead", "trail  ", "　　x", "it's we'll 'S <|endoftext|> ½²③", "\x1c\x1d a", "é ​​ ok", "\r\n\r\n1 234"])
def test_odd_white_space(spark, text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    import zlib

    ids = [*t.encode(text, add_special_tokens=False).ids, 0]
    got = packing.pieces(spark.createDataFrame([(1, text)], "doc_id int, text string"), PATH).first()
    assert (got["length"], got["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def packed(df, capacity):
    bins = {}
    for r in df.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["rid"], r["piece"]))
    for b in bins.values():
        at = 0
        for offset, length, *_ in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("block", [2000, 20])
def test_packing(docs, tokens, block):
    cut = packing.pieces(docs, PATH, 512)
    bins = packed(packing.pack(cut, 512, block), 512)
    lengths = [r["length"] for r in cut.select("length").collect()]
    assert Counter(x[1] for b in bins.values() for x in b) == Counter(lengths)
    assert len({x[2:] for b in bins.values() for x in b}) == len(lengths)
    assert len(bins) <= packing.lower_bound(np.array(lengths), 512) * 1.03 + 1


def test_packing_edges(spark, nothing):
    assert packing.pack(packing.pieces(nothing, PATH)).count() == 0
    one = packing.pack(packing.pieces(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), PATH)).first()
    assert (one["length"], one["offset"], one["doc_id"]) == (1, 0, None)
    same = spark.createDataFrame([(7, "word " * 30)] * 50, "doc_id bigint, text string")
    assert len(packed(packing.pack(packing.pieces(same, PATH, 64), 64), 64)) == 25


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, 20, rng.integers(1, 9))
        least = len(lengths)
        best = [least]

        def place(i, free, best=best, lengths=lengths):
            if len(free) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(free)
                return
            for b in range(len(free)):
                if free[b] >= lengths[i]:
                    place(i + 1, [*free[:b], free[b] - lengths[i], *free[b + 1 :]])
            place(i + 1, [*free, 20 - lengths[i]])

        place(0, [])
        found = packing.evolve(lengths, [packing.first_solution(lengths, rng, 5.0 * k, 20) for k in range(4)], rng, 30, 20)[0]
        assert packing.lower_bound(lengths, 20) <= best[0] <= found.max() + 1
        assert (np.bincount(found, weights=lengths) <= 20).all()


def test_crossover_keeps_every_piece_and_helps():
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(300, 1100, 400), rng.integers(20, 300, 60)])
    start = [packing.first_solution(lengths, rng, 800.0) for _ in range(6)]
    found = packing.evolve(lengths, start, rng, 120)
    assert all(len(p) == len(lengths) and np.bincount(p, weights=lengths).max() <= 2048 and len(np.unique(p)) == p.max() + 1 for p in found)
    assert packing.worth(found[0], lengths) > max(packing.worth(p, lengths) for p in start)


# -- search --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def asked(rows):
    passage = rows[60][1]
    return [(1, passage[:200]), (2, "w1 w2 w2 W3"), (3, None), (4, ""), (None, passage[100:300]), (2, "w1 w2 w2 W3"), (6, "日本語 テキスト"), (7, "nowhere at all"), (8, "same same words"), (9, "X" * 9000)]


@pytest.mark.parametrize(("block", "seeds", "k"), [(1000, 3, 20), (4, 1, 5), (2, 50, 500)])
def test_search(spark, docs, rows, asked, block, seeds, k, monkeypatch):
    monkeypatch.setattr(lexical.seeds, "__defaults__", (seeds,))
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert counted(lexical.rank(docs, items, k, block)) == Counter(brute_new.search(rows, asked, k))


def test_search_in_batches_and_small_steps(spark, docs, rows, asked, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    monkeypatch.setattr(lexical, "AT_ONCE", 10)
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert counted(lexical.rank(docs, items)) == Counter(brute_new.search(rows, asked))


def test_search_of_nothing(spark, docs, nothing, asked):
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert lexical.rank(nothing, items).count() == lexical.rank(docs, items.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x y"), (None, "y y z"), ("b", None)], "doc_id string, text string")
    got = lexical.rank(named, spark.createDataFrame([("q", "y")], "item_id string, text string")).collect()
    assert [tuple(r) for r in got] == brute_new.search([tuple(r) for r in named.collect()], [("q", "y")])


# -- repair --------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, times int, code string, salt string"


def conversations(rng):
    out = []
    for c in range(60):
        turns = rng.sample(range(12), rng.randrange(0, 9))
        out += [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", "ok!", "", None, " \n", "Fine? \t", "a.b", f"t{t}."])) for t in turns]
        if c % 9 == 0:
            out.append((c, None, "user", "first of all."))
    out += [(99, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else "again.") for t in range(700)]
    out += [(98, t, "tool", "cut") for t in range(90)] + [(None, t, "user", "x.") for t in range(5)] + [(97, 3, "user", "long " * 30_000), (97, 4, "assistant", "Done.")]
    return out


@pytest.mark.parametrize(("piece", "broadcast", "partitions"), [(512, 10**6, 4), (3, 0, 16)])
def test_repair(spark, piece, broadcast, partitions, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    monkeypatch.setattr(repair, "BROADCAST", broadcast)
    rows = conversations(random.Random(5))
    given = spark.createDataFrame([(*r, 9, "clash", "clash") for r in rows], CONVERSATIONS).repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 9)
    try:
        found = repair.repair(repair.damage(given)).select("conv_id", *RESULT).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    got = {r[0]: tuple(r)[1:] for r in found}
    want = brute_new.conversations(rows)
    assert len(found) == len(got) and got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "hm.", 400, "", ""), (1, None, "user", "hm.", 3, "", ""), (1, 1, "assistant", "x.", 1, "", ""), (2, None, "", "", 0, "", ""), (3, 5, "user", "y", 1, "", "")]
    got = {r[0]: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows * 3, CONVERSATIONS)).select("conv_id", *RESULT).collect()}
    want = {1: [(None, "user", "hm.")] * 9 + [(0, "user", "hm.")] * 1200 + [(1, "assistant", "x.")] * 3, 2: [], 3: [(5, "user", "y")] * 3}
    assert got == {c: brute_new.repaired(r) for c, r in want.items()}
    nothing = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repair(nothing).count() == 0 and repair.repair(repair.damage(nothing)).count() == 0


def test_fix_up_passes_stop_where_vectors_run_parallel():
    rng = np.random.default_rng(6)
    codes = bytes(rng.choice([4, 4, 8, 8, 0, 7, 11, 12], 500).tolist())
    times = np.ones(500, dtype=np.int64)
    old = repair.backwards(codes, times, repair.END)[0]
    for new in [(0, 0, 0, 0), (9, 1, 5, 4), tuple(x + 11 for x in repair.END)]:
        new = repair.closed(list(new))
        left, ran = repair.fixed_up(codes, times, repair.END, new, old)
        assert repair.parallel(left, repair.backwards(codes, times, new)[0]) and left == repair.backwards(codes, times, new)[0]
        assert ran < 60
