import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, tid bigint, hid bigint, words string, verdict string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text, source) rows, with further columns whose names the operators use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, 8, 9, "w", "v") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """A function that gives n pseudo-random words, the same for the same seed."""

    def words(n, seed, vocabulary=400):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return words


@pytest.fixture(scope="session")
def mixed_rows(prose):
    """Copies, near copies, shared passages, nulls, empty and long texts, odd white space, repeated rows."""
    base = prose(120, 1, 10**6)
    passage = prose(60, 2, 10**6)
    rows = [(0, " ".join(base), "a"), (1, " ".join(base), "b"), (2, "\n".join(base), "a")]
    rows += [(3, " ".join([*base[:100], "x", *base[101:]]), "b"), (4, " ".join(base[:110]), None)]
    rows += [(5 + k, " ".join([*prose(80, 50 + k, 10**6), *passage, *prose(40, 70 + k, 10**6)]), "abc"[k % 3]) for k in range(5)]
    rows += [(20, None, "a"), (21, "", None), (22, " \t\n\x0b\x0c\r ", "c"), (23, "one", "a"), (24, "one", "b"), (25, "one two three four", "a")]
    rows += [(30, " ".join(prose(30000, 9, 10**6)), "c"), (31, " ".join(passage * 3), "a"), (32, " ".join(["rep eat"] * 50), "b")]
    rows += [(40, "\u00a0nbsp é 漢字 " + " ".join(prose(50, 10)), "é"), (41, " ".join(prose(200, 11, 30)), "a"), (None, "no id " + " ".join(prose(40, 12)), "a"), (None, None, None)]
    rows += [(33, " ".join(passage[:34]), "a"), (34, " ".join(passage[:35]), "a"), (5, rows[5][1], "a")]
    return rows
