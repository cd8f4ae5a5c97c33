import random

import pytest

SYLLABLES = "an the re tion ou ß é in er la 漢".split()


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): exact and near copies, a shared passage, nulls, empty, blank, short and long texts, ties."""
    rng = random.Random(11)
    base, passage = prose(rng, 150), prose(rng, 90)
    texts = [None, "", "  \n\t ", "one", "One", "two words", base, base, base.upper(), prose(rng, 9000)]
    for _ in range(25):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + ".\n" + passage + ".\n" + prose(rng, 30) for _ in range(15)]
    texts += [prose(rng, rng.randrange(3, 200)) for _ in range(40)]
    return list(enumerate(texts, start=1))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")
