import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _own string, keep int, shard string, target double"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with helpers'."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, "y", 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


def prose(seed: int, words: int, pool: int = 60) -> str:
    random_ = random.Random(seed)
    made = []
    for i in range(words):
        made.append("".join(random_.choice(["an", "er", "Th", "é", "on", "ti"]) for _ in range(1 + random_.randrange(pool) % 4)))
        if i % 9 == 8:
            made[-1] += random_.choice([".\n", ".", ","])
    return " ".join(made)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeats, ties, a very long text, no id."""
    text = prose(1, 120)
    return [
        (1, text), (1, text), (2, None), (3, ""), (4, " \t\n\x0b "), (5, prose(2, 120), None), (6, text + " more", None),
        (None, prose(3, 80)), (None, None), (7, "one two three", "t"), (8, "ONE two\nthree", "t"), (9, prose(4, 9000), "u"), (10, text, "u"),
    ]
