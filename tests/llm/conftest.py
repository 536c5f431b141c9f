import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, class long, size long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 60)
    texts = [
        None, "", "   \n ", "one two", "one two", "The MIT License applies here", base, base, base.upper(), base + " extra", "x@y.com " * 400,
        words(rng, 9000), "12345 67890", "é中😀 \t ß", "Licensed under the Apache License, Version 2.0", "a" * 5000, "1 " * 3000, "mit license " * 300,
    ]
    rows = [(k, t, "en" if k % 2 else "fr", f"s{k % 3}", len(t or ""), 7, 8, 9) for k, t in enumerate(texts)]
    rows += [rows[6], (None, "some words without an id here", None, None, None, None, None, None), (40, words(rng, 30), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def folder(tmp_path):
    """Writes tables as the driver has them; gives their folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
