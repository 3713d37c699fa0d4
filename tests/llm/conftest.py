import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empties, ties, repeated rows, near copies, shared passages and a very long text."""
    rng = random.Random(11)
    texts = [_text(rng, rng.randint(20, 160)) for _ in range(30)]
    passage = _text(rng, 70)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(6)]  # equal texts
    for i in range(6, 18):  # near copies, some around the threshold
        words = texts[i].split()
        for _ in range(rng.randint(0, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, texts[i][:90] + " " + passage + " " + texts[i][-120:]) for i in range(18, 28)]
    long = _text(rng, 30_000, 9000)
    rows += [(400, long), (401, long.replace("w17x", "W17X")), (402, long[5:])]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE Two"), (505, "a b c d e"), (506, "é ñ ü ß 漢字 🙂")]
    rows += [rows[3], rows[3], (507, "the the the " * 80), (508, "the the the " * 60)]
    return rows


#: other columns, with names that the operators use themselves
EXTRA = "lang string, source string, row string, size int, n int, doc array<int>, component_id string, copies int, `odd.name` int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    langs, sources = ("en", "fr", None), ("b", "a", "B", None)
    rows = [(i, t, langs[k % 3], sources[k % 4], "x", 1, 2, [3], "y", 4, 5) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")
