import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Eta", "theta", "iota", "kappa", "übel", "ñandú", "x#y", "1,2"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n))
    shared = text(60)
    rows = [(i, text(rng.randint(0, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None]), 5) for i in range(60)]
    rows += [(60 + i, shared, "en", "a", None) for i in range(30)]
    rows += [(90 + i, shared + " extra%d" % i, "en", "a", 1) for i in range(10)]
    rows += [(200, None, None, None, None), (201, "", "en", "b", 0), (202, " \n\t ", "en", "b", 3), (203, text(9000), "en", "a", 9)]
    rows += [(204, "one two", "en", "b", 7), (205, "one two", "en", "b", 7), (None, shared, "en", "a", 2), (None, None, None, None, None)]
    rows += [rows[3], rows[3]]
    names = ["n_words", "h1", "size", "score", "gone", "__row", "node", "kept"]
    schema = T.StructType([T.StructField(*f) for f in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))] + [T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def plain_rows(odd_docs):
    return [tuple(r)[:5] for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 7 != 0), int(i % 5 == 1)) for i in range(100)] + [(3, 1, 0), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
