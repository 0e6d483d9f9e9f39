import random

import pytest

from punctum.llm.encoding import Joiner, chunk_ends, default_vocabulary, encode_corpus

PARTS = ["a", "'", "'ll", "'re", "s", " ", "  ", "\n", "\r\n", "1", "!", "é", "é", "你", "\t", "\xa0", " ", "word ", "<|endoftext|>", "🧠"]


@pytest.fixture(scope="module")
def joiner():
    return Joiner(default_vocabulary())


def joined(joiner, text):
    data, start, parts = text.encode(), 0, []
    for end in chunk_ends(data):
        t = data[start:end].decode()
        ids = joiner.encode(t)
        parts.append((ids, *joiner.last_start(t, ids)))
        start = end
    assert b"".join(joiner.bytes_of(p[0]) for p in parts) == data
    return joiner.join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_join_of_random_texts(joiner, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS[: rng.randint(2, len(PARTS))]) for _ in range(rng.randint(1, 4000)))
    assert joined(joiner, text) == joiner.encode(text)


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 9_000 + "x", "'" * 5_000, "\n" * 7_000, "it's we'll 'd " * 900, "你好" * 9_000, "1" * 3_000 + " " + "2" * 5_000, "don't\n\n\n  x" * 800], ids=range(8))
def test_join_of_long_runs(joiner, text):
    assert joined(joiner, text) == joiner.encode(text)


def test_equal_passages_share_chunks():
    rng = random.Random(0)
    passage = " ".join(str(rng.randint(0, 10**6)) for _ in range(600)).encode()
    cuts = lambda d: {bytes(d[a:b]) for e in [chunk_ends(d)] for a, b in zip([0, *e], e)}
    assert len(cuts(passage) & cuts(b"something else before it " * 3 + passage)) > 0.8 * len(cuts(passage))


def test_corpus(spark, joiner):
    rng = random.Random(4)
    shared = " ".join(rng.choice(["tile", "Sund13", "don't", "größer"]) for _ in range(900))
    rows = [(1, None), (2, ""), (3, " "), (4, shared), (4, shared), (5, "before " + shared), (6, shared + shared), (7, "\x00￿"), (None, "text"), (8, "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, uid int, chunk string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, joiner.encode(t or "")) for i, t in rows), key=str)


def test_no_documents(spark):
    df = encode_corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == [] and dict(df.dtypes)["ids"] == "array<int>"
