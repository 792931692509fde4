import pytest
from pyspark.sql import functions as F

from lakelore.functions import claims as C


@pytest.mark.parametrize(
    ("quote", "source", "want"),
    [
        ("a b", "x a b", ("exact", "a b")), ("a  b", "x a\n b y", ("whitespace", "a\n b")), ('"a" - b…', "x “a” — b... y", ("unicode", "“a” — b...")),
        ("a b c", "x **a** `b` c", ("markdown", "a** `b` c")), ("a c", "a b c", ("none", "")), ("", "a", ("none", "")), ("😀 b", "a 😀  b", ("whitespace", "😀  b")),
    ],
)
def test_spans(quote, source, want):
    rung, start, end = C.quote_span(quote, source)
    assert (rung, source[start:end] if start >= 0 else "") == want


def test_claims(spark):
    text = 'Here:\n```json\n{"claims": [{"claim": "a", "quote": "q", "distractor_note": "n"}, {"claim": "b", "quote": "q"}]}\n```'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "id long, answer string")
    assert [(r.id, r.claim, r.distractor_note) for r in C.claims(df).collect()] == [(1, "a", "n")]


def test_limits(spark):
    assert C.bounded("search", "x", 100) == ("x", 100)
    for args in (("search", "x" * 1001), ("ask", "x", 31), ("ask", " "), ("ask", "x", 0)):
        with pytest.raises(ValueError):
            C.bounded(*args)
    h = lambda n, k: F.array_repeat(F.struct(F.lit("user").alias("role"), F.lit("x" * k).alias("text")), n)
    row = spark.range(1).select(C.history_problem(h(12, 4000)).alias("a"), C.history_problem(h(13, 1)).alias("b"), C.history_problem(h(1, 4001)).alias("c")).first()
    assert row.a is None and "turns" in row.b and "characters" in row.c


def test_preflight(spark):
    p = lambda text, url, policy="warn": spark.range(1).select(C.preflight(F.lit(text), F.lit(url), ("ok.com",), policy).alias("x")).first().x
    assert p("fine", "https://ok.com/v1") is None and p("fine", "https://no.com") == "host"
    assert p("123-45-6789", "https://ok.com") == "labels: SSN" and p("123-45-6789", "https://ok.com", "off") is None
    assert p("Form 1040 $5", "https://ok.com") is None and p("Form 1040 $5", "https://ok.com", "block").startswith("labels")


def test_failure_causes(spark):
    df = spark.createDataFrame([("read timed out",), ("connection refused",), ("a pack without rules",), ("boom",), (None,)], "e string")
    assert [r.x for r in df.select(C.failure_cause(F.col("e")).alias("x")).collect()] == ["timeout", "unavailable", "empty_pack", "unknown", None]
