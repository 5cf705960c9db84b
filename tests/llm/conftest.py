import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of documents tables from (doc_id, text[, source[, lang]])."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        schema = T.StructType(DOCS.fields + [T.StructField(name, T.StringType()) for name in extra])
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)

    return make


#: Names that operators use inside; as extra columns they must do no harm.
CLASHING = ["n", "h", "t", "r", "c0", "rate", "copy", "copies", "score", "tokens", "source_", "prefix", "bin_id", "a.b", "mix_source", "n_tokens", "root", "id", "words", "lines"]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"),
    (None, "one two three four five six"), (None, None), (3, None), (4, ""), (5, ""), (6, "   \n\t "), (None, "solo"),
    (7, words(1, 60_000)), (8, "word"), (9, "word", None), (10, "word", None, None), (11, "a b c d e f", "other"),
]
