import pytest

LONG = "word " * 3000 + "Ende\n" * 50
TEXTS = [
    None, "", " \t\n", "one", LONG, LONG, "a b c d e f g h " * 6, "für élan #1 #2\nline\nline\nline\n",
    " no break space", "x" * 5000, "the cat sat on the mat and " * 9, "é" * 40,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, kept int"


def rows():
    out = []
    for k, t in enumerate(TEXTS * 3):
        out.append((k, t, "en", ["b", None, "", "é", "a"][k % 5], len(t or ""), 1, "s", 0))
    out += [(5, TEXTS[5], "en", "a", 1, 1, "s", 0)] * 2  # repeated rows
    out += [(None, "null id " * 5, None, "a", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
