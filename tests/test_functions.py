import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelore.functions import answers as A, embedding as E, identifiers as I, sheets as S, text as T


def one(spark, expr, **values):
    row = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("answer", "want"),
    [("a [1] b [2, 3]", [1, 2, 3]), ("[1-3]", [1, 2, 3]), ("[1–3] [2]", [1, 2, 3]), ("[2019-2024]", [2019, 2020, 2021, 2022, 2023, 2024]), ("[1-99999]", []), ("[x] [] none", []), ("[3-1]", [])],
)
def test_cited(spark, answer, want):
    assert one(spark, A.cited(F.col("a")), a=answer) == want


def test_invalid_citations_are_plausible_numbers(spark):
    assert one(spark, A.invalid(F.col("a"), F.array(F.lit(1).cast("long"))), a="x [1] [7] [1040]") == [7]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (A.EMPTY_ANSWER, True),
        (A.EMPTY_ANSWER[:-1], True),
        (A.EMPTY_ANSWER + "\nClosest related material: Travel SOP [1].", True),
        ("The documents do not bear on the question.", True),
        (A.EMPTY_ANSWER + "\nHowever, the rate is 5 [1].", False),
        (A.EMPTY_ANSWER + "\nClosest related material: A [1].\nMore", False),
        ("", False),
    ],
)
def test_refusal(spark, answer, want):
    assert one(spark, A.is_refusal(F.col("a")), a=answer) is want


def test_warnings(spark):
    valid = F.array(F.lit(1).cast("long"))
    assert one(spark, A.warnings(F.col("a"), valid), a="fact [2]") == ["invalid_citation", "uncited_answer"]
    assert one(spark, A.warnings(F.col("a"), valid), a="fact [1]") == []
    assert one(spark, A.warnings(F.col("a"), valid), a=A.EMPTY_ANSWER) == []


@pytest.mark.parametrize(
    ("quote", "source", "rung"),
    [("a b", "x a b y", "exact"), ("a  b", "x a\nb", "whitespace"), ("“a”", 'he said "a"', "unicode"), ("a b", "x **a** b", "markdown"), ("a c", "a b c", "none"), ("", "a", "none")],
)
def test_quote_rungs(spark, quote, source, rung):
    assert one(spark, A.quote_rung(F.col("q"), F.col("s")), q=quote, s=source) == rung


def test_checksums(spark):
    assert one(spark, I.luhn(F.col("a")), a="4111 1111-1111 1111")
    assert not one(spark, I.luhn(F.col("a")), a="4111111111111112")
    assert not one(spark, I.luhn(F.col("a")), a="0")
    assert one(spark, I.aba(F.col("a")), a="021000021")
    assert not one(spark, I.aba(F.col("a")), a="000000000")
    assert [one(spark, I.mask(F.col("a")), a=x) for x in ("12345", "ab", "")] == ["1XXX5", "XX", ""]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("id 123-45-6789", ["SSN"]), ("SSN on file:\n123456789", ["SSN-unformatted"]), ("12-3456789", ["EIN"]), ("Form 1040 shows $1,200", ["tax-form+amount"]),
        ("1099 – NEC paid $5", ["1099+amount"]), ("W - 2 box $7", ["W2+amount"]), ("Sch. SE $9", ["schedule+amount"]), ("taxpayer\n$3", ["taxpayer+amount"]), ("plain 123456789", []),
    ],
)
def test_taxpayer_labels(spark, text, want):
    assert one(spark, I.taxpayer_labels(F.col("a")), a=text) == want


def test_density_sweep_needs_three_and_words(spark):
    sweep = I.density_sweep(F.col("a"), F.col("a"))
    assert "REDACTED" not in one(spark, sweep, a="SSN 123456789 123456788")
    assert one(spark, sweep, a="SSN 123456789 123456788 123456787").count("[REDACTED-SSN]") == 3
    assert "REDACTED" not in one(spark, sweep, a="no words 123456789 123456788 123456787")


def test_text(spark):
    assert one(spark, T.tokens(F.col("a")), a="The Cat, and 2 dogs!") == ["cat", "2", "dogs"]
    assert one(spark, T.lexemes(F.col("a")), a="how do i do it") == []
    assert one(spark, T.title(F.col("p"), F.col("m"), F.col("f")), p=" ", m="x\n# Head \n", f="a/b.md") == "Head"
    assert one(spark, T.title(F.col("p"), F.col("m"), F.col("f")), p=None, m="x", f="a/b.c.md") == "b.c"
    assert one(spark, T.html_to_text(F.col("a")), a="<style>x</style><p>a &lt; b</p><p>c&amp;lt;<br>d</p>") == "a < b\nc&lt;\nd"
    assert one(spark, T.host(F.col("a")), a="HTTPS://u:p@Ex.Com:8/x") == "ex.com"
    assert one(spark, T.download_name(F.col("a")), a='a/b\r\n"c"') == "a_bc"
    assert one(spark, T.download_name(F.col("a")), a=" \n") == "document"
    assert one(spark, T.email_addresses(F.col("a")), a="A <a@X.de>, b@y.de, ") == ["a@x.de", "b@y.de"]


def test_tables(spark):
    md = one(spark, T.html_table_to_markdown(F.col("a")), a="<table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr></table>")
    assert md == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, T.markdown_tables(F.col("a")), a=f"x\n\n{md}\n\ny") == [md]
    assert one(spark, T.markdown_tables(F.col("a")), a="| a |\nno rule") == []


@pytest.mark.parametrize(
    ("headers", "rows", "formulas", "want"),
    [
        (["a", "b"], [["1", "2"]] * 5, 0, "tabular"), (["a", "b"], [["1", "2"]] * 4, 0, "freeform"), (["a", "b"], [["1", "2"]] * 5, 2, "financial_model"), (["a"], [["x" * 201]], 0, "narrative"),
        (["1", "2"], [["1", "2"]] * 5, 0, "freeform"), (["a"], [], 0, "freeform"), (["a", "b", "c"], [["1"], ["1", "2"], ["1", "2", "3"], ["1", "2", "3", "4"]], 0, "narrative"),
    ],
)
def test_sheet_type(spark, headers, rows, formulas, want):
    df = spark.createDataFrame([(headers, rows, formulas)], "h array<string>, r array<array<string>>, f int")
    assert df.select(S.sheet_type(F.col("h"), F.col("r"), F.col("f")).alias("x")).first().x == want


def test_separated():
    assert S.parse_separated(b"a;b\n1;2\n3;4\n") == (["a", "b"], [["1", "2"], ["3", "4"]])
    assert S.parse_separated(b"a,b\n1, 2\n3\n") == (["a", "b"], [["1", "2"], ["3", ""]])
    assert S.parse_separated("a,b\né,2\n".encode("latin-1"))[1][0][0] == "é"
    with pytest.raises(ValueError):
        S.parse_separated(b"")


def test_embedding(spark):
    v = E.embed_words("cat dog cat", 768)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v.tolist() == E.embed_words("CAT dog, cat", 768).tolist()
    assert not E.embed_words("a \u00e9 !", 768).any()
    # The fixed algorithm, step by step.
    want = [0.0] * 768
    for word in ["cat", "dog", "cat", "x1"]:
        d = hashlib.sha256(word.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 768] += 1
        want[int.from_bytes(d[4:8], "big") % 768] += 1 if d[8] % 2 == 0 else -1
    norm = sum(x * x for x in want) ** 0.5
    assert np.allclose(E.embed_words("Cat, dog-cat a x1", 768), [x / norm for x in want], atol=1e-12)
    got = E.embed(spark.createDataFrame([(1, "cat"), (2, None)], "i long, text string")).orderBy("i").collect()
    assert np.allclose(got[0].embedding, E.embed_words("cat", 768), atol=1e-7) and not any(got[1].embedding)
    with pytest.raises(Exception, match="zeros"):
        spark.range(1).select(E.normalised(F.array(F.lit(0.0)))).collect()
    with pytest.raises(Exception, match="finite"):
        spark.range(1).select(E.normalised(F.array(F.lit(float("nan"))))).collect()
