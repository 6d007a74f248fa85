import pytest

#: id, text: null, empty, blank, repeated rows, ties, null id, a long text, control characters.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "word " * 60_000),
    (7, "é漢字😀 \x1c\x85 tail"),
    (None, "no id here at all"),
    (8, "x" * 200_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows beside extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
