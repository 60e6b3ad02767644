import random

import pytest

VOCABULARY = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "straße", "naïve", "x1", "42"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def make_documents(seed=1):
    """(doc_id, text) with copies, near copies, shared passages, null, empty, short, repeated and very long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 25)
    texts = [*base, *rng.sample(base, 8)]
    for t in base[:10]:
        texts += [near(rng, t, 1), near(rng, t, max(1, len(t.split()) // 20))]
    texts += [f"{prose(rng, 10)} {passage} {prose(rng, 10)}" for _ in range(8)]
    hub = prose(rng, 60)
    texts += [near(rng, hub, rng.randint(1, 4)) for _ in range(25)]
    texts += [None, "", " \n\t ", "one", "one two", "one two three four", "one two three four", "ONE two THREE four", "é", "\x00\x01", "a" * 60, "a" * 300, "😀 " * 40, prose(rng, 20_000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def frame(spark, documents):
    """documents with further columns, some of them named as the operators name theirs."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), i, "x", 0.5, None) for i, t in documents]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, score double, pieces string")


@pytest.fixture(scope="session")
def empty(spark, frame):
    return spark.createDataFrame([], frame.schema)
