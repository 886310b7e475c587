import pytest

#: Rows that every operator must bear: nulls, empty and very long texts, ties and repeated rows.
LONG = "lorem ipsum " * 60_000
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "one two three four five six seven eight nine ten", "en", "b", 48),
    (3, "", "en", "a", 0),
    (4, None, "fr", "b", None),
    (None, "a text that has no number but has some words of its own", None, None, 5),
    (None, None, None, None, None),
    (5, LONG, "de", "a", len(LONG)),
    (6, "x" * 300_000, "xx", "c", 300_000),
    (7, " \n\t ", "es", "c", 4),
    (8, "ünïcödé ﷽ 日本語 \U0001f600 ퟿", "ja", "c", 20),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names inside the operators.
CLASHES = ("digest", "rank", "toxicity", "toxicity_threshold", "dropped_id", "code", "node", "gram", "bucket", "shard", "piece", "n", "mix_source", "mix_epochs", "mix_copies", "key", "s", "scope", "score", "group_id")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
