import pytest

from probeframe.llm.common import components

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rank long, run int, size string, k string, component string, copies int"


def rows(texts):
    return [(i, t, None if i == 2 else "en", s, None, 1, 2, 3, "x", "y", "z", 7) for i, t, s in texts]


#: Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns whose names clash with working columns.
EDGE = rows([(1, None, "a"), (2, "", None), (3, "word", "b"), (3, "word", "b"), (4, "  \n\t ", "a"), (5, LONG, "a"), (6, LONG, "b"), (None, "no id here at all", "a"), (None, None, None), (7, "größe 漢字 \x00 end", "ü"), (8, "a b c d e", "a"), (9, "A b C d e", "")])


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def components_of():
    return components
