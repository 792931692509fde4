import random

"""Redaction of whole documents, rule packs from files, the download gate, reports on quotes and question sets."""

import json

import pytest
from pyspark.sql import functions as F

from lakelore.functions import identifiers
from lakelore.operators import evaluation, redaction as R
from tests.conftest import rows

TABLE = "array<struct<sheet_name: string, caption: string, headers: array<string>, rows: array<array<string>>, markdown: string, formulas: int>>"
SSN, EIN, MASK = "123-45-6789", "12-3456789", "[REDACTED-SSN]"


def _sheet(rows_, headers=("a", "b"), **more):
    return {"sheet_name": None, "caption": None, "headers": list(headers), "rows": rows_, "markdown": None, "formulas": 3} | more


def test_tables_are_masked_with_their_document(spark):
    docs = [
        (1, f"of {SSN}", f"SSN {SSN} and {EIN}", [_sheet([["x", SSN], [EIN, EIN]], markdown=f"| {SSN} |", caption=f"see {SSN}")]),
        (2, None, None, [_sheet([["SSN", "987654321"], []], headers=("987654321", "")), _sheet([], headers=())]),  # a cell tells another's number
        (3, "t", "text", [_sheet([["a\x1fb", "c"]])]),  # a separator: nothing of the document may be shown
        (4, "t", "text", None),
        (5, "t", "text", []),
        (6, "t", f"{SSN}, {SSN}, {SSN}", [_sheet([[None, SSN]])]),
    ]
    got = {r.id: r for r in R.redact_documents(spark.createDataFrame(docs, f"id int, title string, markdown string, tables {TABLE}"), tables="tables").collect()}
    first = got[1].tables[0]
    assert (got[1].title, got[1].markdown) == (f"of {MASK}", f"SSN {MASK} and [REDACTED-EIN]")
    assert (first.rows, first.markdown, first.caption, first.formulas) == ([["x", MASK], ["[REDACTED-EIN]"] * 2], f"| {MASK} |", f"see {MASK}", 3)
    assert got[1].redaction == {"ssn": 1 + 2, "ein": 2}  # the title's, and of text (1, 1) and tables (2, 2) the more
    assert got[2].tables[0].rows == [["SSN", MASK], []] and got[2].tables[0].headers == ["987654321", ""] and got[2].tables[1].headers == [] and got[2].redaction == {"ssn": 1}
    assert (got[3].title, got[3].markdown, got[3].tables, got[3].redaction) == (None, None, None, None)
    assert got[4].tables is None and got[5].tables == [] and got[4].redaction == got[5].redaction == {}
    assert got[6].redaction == {"ssn": 3} and got[6].tables[0].rows == [[None, MASK]]


def test_the_shape_of_a_table_survives():
    with pytest.raises(ValueError, match="shape"):  # a rule that takes a separator in
        R.redact_grid([["12", "34"]], (R.Rule("ssn", r"\d\d\x1f\d\d"),))
    assert R.redact_grid([], R.PACK) == ([], {}) and R.redact_grid([[], ["a"]], R.PACK) == ([[], ["a"]], {})


def test_a_number_behind_an_accented_letter_is_masked(spark):
    assert R.redact(f"é{SSN}ü")[0] == f"é{MASK}ü" and R.redact(f"a{SSN}")[1] == {} and R.redact(f"_{SSN}")[1] == {}
    row = spark.range(1).select(identifiers.taxpayer_labels(F.lit(f"é{SSN}")).alias("a"), identifiers.taxpayer_labels(F.lit(f"x{SSN}")).alias("b")).first()
    assert (row.a, row.b) == (["SSN"], [])


def _pack(folder, rules, **about):
    folder.mkdir(exist_ok=True)
    (folder / "pack.json").write_text(json.dumps({"pack": {"id": "own", "version": "3", "requires": "^1.0.0"} | about, "rules": rules}))
    return str(folder)


RULE = {"id": "ssn", "pattern": r"\bNO \d{4}\b", "ignore_case": True}


def test_packs_from_files(spark, tmp_path):
    pack = R.read_pack(spark, _pack(tmp_path / "a", [RULE, {"id": "card", "pattern": r"\d{16}", "check": "luhn", "window": 10}]))
    assert (pack.id, pack.version, len(pack.rules)) == ("own", "3", 2)
    docs = spark.createDataFrame([(1, "t", "no 1234"), (2, "t", SSN)], "id int, title string, markdown string")
    assert {r.id: r.redaction for r in R.redact_documents(docs, pack).collect()} == {1: {"ssn": 1}, 2: {}}
    for k, (rules, about, why) in enumerate([
        ([], {}, "without rules"), ([RULE, RULE], {}, "repeat"), ([RULE | {"pattern": "x*"}], {}, "empty text"), ([RULE | {"pattern": "("}], {}, "no pattern"), ([RULE | {"check": "sum"}], {}, "unknown check"),
        ([RULE | {"more": 1}], {}, "not a rule"), ([{"id": "x"}], {}, "not a rule"), ([RULE], {"requires": "^2.0.0"}, "needs contract"), ([RULE], {"requires": "^1.1.0"}, "needs contract"), ([RULE], {"requires": "^0.9.0"}, "0.x"),
        ([RULE], {"requires": "1.0.0"}, "caret"), ([RULE], {"extra": 1}, "a pack has"),
    ]):
        with pytest.raises(ValueError, match=why):
            R.read_pack(spark, _pack(tmp_path / f"p{k}", rules, **about))
    with pytest.raises(ValueError, match="no pack can be read"):
        R.read_pack(spark, str(tmp_path / "nowhere"))
    (tmp_path / "a" / "pack.json").write_text("{")
    with pytest.raises(ValueError, match="no pack can be read"):
        R.read_pack(spark, str(tmp_path / "a"))


@pytest.mark.parametrize(("wanted", "there", "right"), [("^1.0.0", "1.0.0", True), ("^1.0.0", "1.9.0", True), ("^1.2.3", "1.2.2", False), ("^1.2.3", "1.3.0", True), ("^1.2.3", "2.2.3", False), ("^2.0.0", "1.9.9", False)])
def test_caret_ranges(wanted, there, right):
    assert R.meets(wanted, there) is right


def test_versions_that_cannot_be_compared():
    for wanted, there in (("^0.1.0", "0.1.0"), ("~1.0.0", "1.0.0"), ("^1.0", "1.0.0"), ("^1.0.0", "one")):
        with pytest.raises(ValueError):
            R.meets(wanted, there)


def test_a_new_pack_finds_what_to_scan_again(spark):
    docs = spark.createDataFrame([(1, "t", "x"), (2, "t", SSN)], "id int, title string, markdown string")
    done = R.redact_documents(docs)
    assert R.to_scan_again(done).count() == 0
    new = (*R.PACK, R.Rule("phone", r"\+\d{9}"))
    assert R.to_scan_again(done, new).count() == 2 and R.fingerprint(new) != R.fingerprint(R.PACK)
    assert R.to_scan_again(done, R.Pack("another name", "9", R.PACK)).count() == 0  # the same rules
    never = done.withColumn("redaction_pack", F.lit(None).cast("string"))
    failed = done.withColumn("redaction", F.lit(None).cast("map<string,int>"))
    assert R.to_scan_again(never).count() == R.to_scan_again(failed).count() == 2


def test_download_gate(spark):
    docs = spark.createDataFrame([(1, "k", {}), (2, "k", {"ssn": 1}), (3, None, {}), (4, "k", None), (5, "k", {"ein": 0})], "id int, storage_key string, redaction map<string,int>")
    assert sorted(r.id for r in R.downloadable(docs).collect()) == [1, 5]


def test_rung_report(spark):
    rungs = lambda *x: spark.createDataFrame([(r,) for r in x], "rung string")
    assert evaluation.rung_report(rungs("exact", "exact", "unicode", "none", "none", "none")).first().asDict() == {"exact": 2, "whitespace": 0, "unicode": 1, "markdown": 0, "none": 3, "strained": False}
    assert evaluation.rung_report(rungs("exact", "whitespace", "markdown")).first().strained is True
    assert evaluation.rung_report(rungs("exact", "unicode")).first().strained is False  # half is enough
    for nothing in (rungs("none"), rungs("exact").limit(0)):
        assert evaluation.rung_report(nothing).first().strained is False


def test_gold_issues(spark):
    schema = "id string, query string, expected_answer string, verified_by string, answerable boolean, relevant array<string>"
    asked = [("a", "q", None, None, True, ["d"]), ("b", " ", "x", "me", True, ["d"]), ("c", "q", "x", None, True, []), ("d", "q", None, None, False, []), ("e", "q", None, None, True, ["d"]), ("e", None, "x", "me", True, ["d"])]
    got = rows(evaluation.gold_issues(spark.createDataFrame(asked, schema)))
    assert got == [("b", ["empty query"]), ("c", ["unverified answer", "no relevant document"]), ("e", ["duplicate id", "empty query"]), ("e", ["duplicate id"])]


def test_what_holds_nothing_is_not_scanned_and_the_rest_alike(spark, monkeypatch):
    """Texts and tables of random pieces, nulls at every level included, are masked as when every rule is looked for in each; without nine digits none is."""
    rng = random.Random(4)
    pieces = ["SSN", " ", "123456789", "021000021", "123-45-6789", "12\u30003456789", "4111 1111 1111 1111", "é", "12345678", "-", "routing ", "9", "\n", "1", "Social Security no. ", "x", "taxpayer id "]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randint(0, 5))) + "\x1f" * (rng.random() < 0.02)
    some = lambda f, n: None if rng.random() < 0.05 else [f() for _ in range(rng.randint(0, n))]
    one = lambda: None if rng.random() < 0.03 else {"headers": some(text, 2), "rows": some(lambda: some(text, 3), 3), "markdown": text(), "caption": text(), "note": rng.choice(["123-45-6789", None])}
    docs = [(i, text(), text(), some(one, 2)) for i in range(600)]
    plain = (*R.PACK,)
    want = {}
    for i, *values in docs:
        try:
            *new, counts = R.redact_document(*values, plain)
        except Exception:
            new, counts = [None] * 3, None
        want[i] = (*new, counts)
    table = "struct<headers: array<string>, rows: array<array<string>>, markdown: string, caption: string, note: string>"
    got = R.redact_documents(spark.createDataFrame(docs, f"id int, title string, markdown string, tables array<{table}>").repartition(3), tables="tables").collect()
    assert {r.id: (r.title, r.markdown, None if r.tables is None else [None if t is None else t.asDict() for t in r.tables], r.redaction) for r in got} == want
    assert sum(w[3] is None for w in want.values()) > 5 and sum(bool(w[3]) for w in want.values()) > 50 and sum(w[3] == {} for w in want.values()) > 50
    monkeypatch.setattr(R, "scan", lambda *a: 1 / 0)
    assert R.redact("Order 12-34567 of 2024-05-06") == ("Order 12-34567 of 2024-05-06", {}) and R.redact_grid([["1", "15519"], ["2", "40000"]]) == ([["1", "15519"], ["2", "40000"]], {})
    with pytest.raises(ZeroDivisionError):
        R.redact("123-45-6789")
