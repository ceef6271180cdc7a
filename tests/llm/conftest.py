import random

import pytest

WORDS = "the of and to in that by for was on are with this be at from or an lorem ipsum dolor sit amet ad minim veniam quis nostrud".split()
#: Rows that every operator must take: null, empty, blank, repeated, tied, with clashing further columns.
ODD = [(90_001, None), (90_002, ""), (90_003, " \t\n\x0b "), (90_004, "one"), (90_005, "one"), (90_005, "one"), (None, "a null id " * 20), (90_006, "x" * 30_000), (90_007, "éñ日本語🙂 " * 40)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared lines and shared passages."""
    rng = random.Random(5)
    rows, shared = [], "this line is common to many documents and long enough to count"
    passage = sentence(rng, 60)
    for i in range(120):
        text = sentence(rng, rng.randrange(1, 120))
        if i % 3 == 0:
            text += "\n  " + shared.upper() + " \n" + sentence(rng, 8)
        if i % 7 == 0:
            text = sentence(rng, 5) + " " + passage + " " + text
        rows.append((i, text))
    base = sentence(rng, 150).split()
    for i in range(120, 150):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = "w" + str(rng.randrange(10**6))
        rows.append((i, " ".join(copy)))
    rows += [(150 + k, rows[k][1]) for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        full = [(i, t, "key", "row", 1.0, "s", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, key string, rep string, score double, source string, n_chars long")

    return make
