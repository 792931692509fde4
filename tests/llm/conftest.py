import os
import sys

import pytest

TOKENIZERS = {}


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return lambda name: public_tokenizers.path(name)


#: Texts that every operator must take: nulls, empties, white space, ties, repeats, a long one.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "no id at all here"), (7, "ÀÉ 漢字 😀 ß"),
    (8, "word " * 20000), (9, "x" * 5000), (10, "a\x1cb\x85c\xa0d <|endoftext|> </s>[INST]"),
]


@pytest.fixture
def odd(spark):
    """Odd texts, with columns that operators use themselves."""
    rows = [(i, t, None if k % 4 == 0 else "en", "s", len(t or ""), "clash", 1.5) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double")


@pytest.fixture
def none(odd):
    return odd.limit(0)
