import os
import random

import pytest


@pytest.fixture(scope="session")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from graphloom.llm.queries import tokenizer

    return tokenizer()


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=6))
    return words


@pytest.fixture(scope="session")
def texts():
    """Odd, empty, repeated, near and long texts: (doc_id, text), with ids that repeat and are null."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(1, 9))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 300))] for _ in range(25)]
    out = [None, "", " \n\t", "one", "One two three", "ONE two three", "a b c d", "A B C D e", "Ünïcode ẞ 中文 text’s", "x" * 3000, "the " * 500, "\x00\x0b\x1c odd \x85 bytes"]
    for b in base:
        out += [" ".join(b), " ".join(b), " ".join(near(rng, b, 1)).title(), " ".join(near(rng, b, 3)), " ".join(b[:20] + near(rng, b, 2)), "\n".join(" ".join(b[k : k + 9]) for k in range(0, len(b), 9))]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    ids = list(range(len(out)))
    rng.shuffle(ids)
    rows = list(zip(ids, out, strict=True))
    return [*rows, rows[20], (ids[30], "another text under an id that repeats " * 3), (None, out[12]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with what operators use."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, batch int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


TABLES = os.environ.get("GRAPHLOOM_SF_DIR", "/root/testdata/sf0.001")
