import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, words, "en", "a"),
            (5, "one two three four five", "en", "b"), (5, "one two three four five", "en", "b"),
            (6, "x" * 200_000, None, None), (None, "text without an id", "de", "b"), (7, None, None, None),
            (8, "a \U0001f600 b c é́", "fr", "b"), (-9, "negative id", "en", "a")]
    names = "doc_id long, text string, lang string, source string"
    extra = "size int, copies string, target string, perplexity string, threshold string, keep string, n long, " \
            "token string, _c string, base_spans string, all_spans string, score string, n_tokens string"
    return spark.createDataFrame([(*r, *[None] * 13) for r in rows], f"{names}, {extra}")


@pytest.fixture(scope="session")
def empty_documents(odd_documents):
    return odd_documents.filter("false")
