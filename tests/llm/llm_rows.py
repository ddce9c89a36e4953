"""Odd rows that every operator must take: nulls, empty, white, very long and repeated texts, null and repeated ids."""

import pytest

FOLDER = "/root/testdata/sf0.001"
WORDS = "the red fox ran over a hill and saw nine old boats near the grey shore while rain fell on every roof in town that night".split()


def odd_texts():
    base = " ".join(WORDS * 3)
    return [(1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (5, base), (5, "other words here"), (None, base), (None, None), (6, "x" * 200_000),
            (7, " ".join(f"w{i}" for i in range(40_000))), (8, "Été À 東京 résumé.\nÉté À 東京 résumé."), (9, "... !!! 123"), (10, base.replace("boats", "ships", 1)), (11, "one"), (12, "ONE")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en" if n % 2 else "fr", "s", 0, 9, "extra") for n, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
