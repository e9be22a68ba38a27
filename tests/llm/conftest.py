import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, key int, spans string"


def _words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', 'é', 'X', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, near copies, passages shared in many places, empties, nulls, ties, a long text."""
    rng = random.Random(3)
    passage = _words(rng, 70, 500)
    long = _words(rng, 6000, 3000)
    out = [(i, _words(rng, rng.randrange(0, 140))) for i in range(60)]
    out += [(60 + i, f"{_words(rng, rng.randrange(0, 40))} {passage} {_words(rng, rng.randrange(0, 40))}") for i in range(30)]
    out += [(100 + i, passage) for i in range(5)]
    near = _words(rng, 200, 900).split()
    for i in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = "other"
        out.append((110 + i, "\t".join(w)))
    out += [(130, long), (131, long + " tail"), (132, ""), (133, None), (134, "   \n "), (135, "x" * 9000), (136, "日本語 テキスト 🎉 ok"), (137, "a b"), (138, passage.upper())]
    out += [(None, passage), (None, None), (5, out[5][1]), (7, "another text with the same id"), (140, "same words " * 200)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None if k % 11 == 0 else f"s{k % 3}", len(t or ""), "clash", k, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
