import pytest
from pyspark.sql import functions as F

#: Texts of every awkward kind: null, empty, blank, repeated, long, other scripts, control strings, marks.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs into the deep dark forest again", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs into the deep dark forest again", "b"),
    (3, "THE  quick brown fox jumps over the lazy dog and runs into the deep dark forest again!", "a"),
    (4, None, None),
    (5, "", "a"),
    (6, " \t\n ", None),
    (7, "one two", "c"),
    (8, "Ein kühler Weg führt über die grüne Wiese bis zum See; 日本語 テスト 🎉 and back\x00 again", "c"),
    (9, "rep eat it " * 2000, "a"),
    (10, "rep eat it " * 2000 + "end", "b"),
    (11, "token = abcdef123456 </s>[INST] x [/INST] <|endoftext|> don't I'll 12345 ...!!", "b/r1"),
    (11, "token = abcdef123456 </s>[INST] x [/INST] <|endoftext|> don't I'll 12345 ...!!", "b/r1"),
    (None, "a row without an id, whose text is of fair length so that windows of fifty bytes fit", "d"),
    (None, "a row without an id, whose text is of fair length so that windows of fifty bytes fit", "d"),
    (12, "x" * 300, "d"),
    (13, "line\nline\nother\nline\n" * 5, "e"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(docs):
    """The same rows with columns whose names an operator might use itself."""
    for c in ("size", "fp", "rid", "root", "chunk", "score", "position", "hash", "address", "n_tokens", "target", "row", "host"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs
