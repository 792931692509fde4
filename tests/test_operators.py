import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakelore.functions.english import stem
from lakelore.functions.text import STOPWORDS
from lakelore.operators import access, chunking as C, evaluation, ingest, redaction as R, results, retrieval
from tests.conftest import rows


def test_scope_never_widens(spark):
    cases = [(None, None, None), (None, ["a"], ["a"]), ([], None, []), ([], ["a"], []), (["a"], None, ["a"]), (["a"], ["a", "b"], ["a"]), (["a"], ["b"], [])]
    df = spark.createDataFrame([c[:2] for c in cases], "e array<string>, a array<string>")
    assert [r.x for r in df.select(access.effective_scope(F.col("e"), F.col("a")).alias("x")).collect()] == [c[2] for c in cases]


def _chunks(spark):
    data = [(i, i // 2, f"s{i % 2}", f"word{i} common", [1.0, float(i)], "withdrawn" if i == 3 else "active") for i in range(8)]
    return spark.createDataFrame(data, "chunk_id long, document_id long, source_id string, text string, embedding array<double>, lifecycle_status string")


def _questions(spark, scope):
    return spark.createDataFrame([(1, "common word3", [1.0, 7.0], scope)], "query_id long, text string, embedding array<double>, scope array<string>")

def test_search_is_english(spark):
    """Stems meet, stop words don't count, a question of stop words alone matches nothing; scores are those of a plain count."""
    texts = ["The policy of the house", "Policies and more policies", "A dog runs", "running dogs", "what is this", None]
    chunks = spark.createDataFrame([(i, i, "s", t, None, "active") for i, t in enumerate(texts)], "chunk_id long, document_id long, source_id string, text string, embedding array<double>, lifecycle_status string")
    asked = spark.createDataFrame([(1, "policies", None, None), (2, "the run of a dog", None, None), (3, "what is the", None, None)], "query_id long, text string, embedding array<double>, scope array<string>")
    words = [[stem(w) for w in re.findall(r"\w+", (t or "").lower()) if w not in STOPWORDS] for t in texts]
    want = {}
    for q, t in ((1, "policies"), (2, "run dog")):
        for c, has in enumerate(words):
            if n := sum(has.count(stem(w)) for w in t.split()):
                want[q, c] = round(n * 0.1, 6)
    wanted = retrieval.asked_lexemes(asked).select("lexeme").distinct()
    for posted in (retrieval.postings(chunks), retrieval.postings(chunks, wanted=wanted)):
        assert {(r.query_id, r.chunk_id): r.score for r in retrieval.sparse_top(asked, posted, 9).collect()} == want
    assert {(1, 0), (1, 1), (2, 2), (2, 3)} == set(want)
    found = retrieval.hybrid(asked, chunks, posted=retrieval.postings(chunks)).collect()
    assert {(r.query_id, r.chunk_id) for r in found} == set(want) and all(r.keyword_coverage == 1 for r in found)


def test_dense_top_is_the_plain_one(spark, monkeypatch):
    """Ties by chunk_id, scopes, blocks of queries, and chunks that match nothing."""
    rng = random.Random(31)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    chunks = [(i, f"s{i % 3}", vector() if i % 11 else None if i % 2 else [1.0]) for i in range(200)]
    asked = [(q, vector(), rng.choice([None, [], ["s1"], ["s0", "s2"]])) for q in range(12)]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = []
    for q, v, scope in asked:
        scored = [(-round(cosine(v, c), 6), i) for i, s, c in chunks if c and len(c) == 3 and any(c) and any(v) and (scope is None or s in scope)]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(sorted(scored)[:7])]
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 5 * 3 * 8)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, scope array<string>")
    rows = spark.createDataFrame(chunks, "chunk_id long, source_id string, embedding array<double>").repartition(3)
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in retrieval.dense_top(queries, rows, 7).collect()) == sorted(want)


def test_withdrawn_is_never_served_and_takes_no_place(spark):
    found = retrieval.hybrid(_questions(spark, None), _chunks(spark), retrieval.Fusion(top_k=8))
    ids = [r.chunk_id for r in found.collect()]
    assert sorted(ids) == [0, 1, 2, 4, 5, 6, 7]


def test_scope_and_deny_all(spark):
    assert {r.source_id for r in retrieval.hybrid(_questions(spark, ["s1"]), _chunks(spark)).collect()} == {"s1"}
    assert retrieval.hybrid(_questions(spark, []), _chunks(spark)).count() == 0


def test_query_vector_must_be_finite(spark):
    bad = _questions(spark, None).withColumn("embedding", F.array(F.lit(float("nan")), F.lit(1.0)))
    with pytest.raises(ValueError):
        retrieval.dense_top(bad, _chunks(spark), 3)


def test_fusion_is_symmetric(spark):
    hits = lambda *ids: spark.createDataFrame([(1, i, 1.0, k + 1) for k, i in enumerate(ids)], "query_id long, chunk_id long, score double, rank int")
    o = retrieval.Fusion(dense=0.5, sparse=0.5)
    a = {r.chunk_id: r.rrf for r in retrieval.fuse(hits(1, 2), hits(2, 3), o).collect()}
    b = {r.chunk_id: r.rrf for r in retrieval.fuse(hits(2, 3), hits(1, 2), o).collect()}
    assert a == b and a[2] > a[1]


def test_neighbours_stop_at_limits(spark):
    chunks = spark.createDataFrame([(10 * d + o, d, o) for d in (1, 2) for o in range(9)], "chunk_id long, document_id long, ordinal int")
    res = spark.createDataFrame([(1, 1, 14, 1, 4), (1, 2, 16, 1, 6), (1, 3, 20, 2, 0)], "query_id long, rank int, chunk_id long, document_id long, ordinal int")
    got = [(r.rank, r.chunk_id, r.neighbour) for r in results.with_neighbours(res, chunks, documents=2, each=2, total=5).orderBy("rank").collect()]
    assert got == [(1, 14, False), (2, 16, False), (3, 20, False), (4, 13, True), (5, 15, True)]


def test_context_numbers_and_gaps(spark):
    res = spark.createDataFrame([(1, 1, 5, 2, 4), (1, 2, 6, 1, 1), (1, 3, 7, 2, 6)], "query_id long, rank int, chunk_id long, document_id long, ordinal int")
    got = {r.chunk_id: (r.citation, r.gap) for r in results.context(res).collect()}
    assert got == {5: (1, False), 6: (2, False), 7: (1, True)}


def test_exposed_metadata(spark):
    m = F.create_map(*map(F.lit, ("title", "t", "url", "u", "path", "secret", "docClass")), F.col("c"))
    got = {r.c: r.x for r in spark.createDataFrame([("A",), ("B",)], "c string").select("c", results.exposed_metadata(m).alias("x")).collect()}
    assert got["A"]["url"] == "u" and "url" not in got["B"] and "path" not in got["A"]


def test_upsert_keeps_governance(spark):
    schema = "source_id string, external_id string, content_hash string, lifecycle_status string"
    old = spark.createDataFrame([("s", "1", "a", "withdrawn"), ("s", "2", "b", "active")], schema)
    new = spark.createDataFrame([("s", "1", "c", "active"), ("s", "2", "b", "active"), ("s", "3", "d", "active")], schema)
    got = {r.external_id: (r.content_hash, r.lifecycle_status, r.content_changed) for r in ingest.upsert(old, new).collect()}
    assert got == {"1": ("c", "withdrawn", True), "2": ("b", "active", False), "3": ("d", "active", True)}


def test_outcomes_fail_closed(spark):
    schema = "source_class string, path string, parse_error string, redaction string, quarantined boolean, content_changed boolean, embedded boolean"
    data = [("D", "x", None, "r", False, True, False), ("A", "a/Engagement Letter/b", None, "r", False, True, False), ("A", "x", "bad", "r", False, True, False), ("A", "x", None, None, False, True, False), ("A", "x", None, "r", True, True, False), ("A", "x", None, "r", False, False, True), ("A", "x", None, "r", False, False, False)]
    got = [r.status for r in ingest.outcomes(spark.createDataFrame(data, schema)).collect()]
    assert got == ["blocked", "blocked", "failed", "quarantined", "quarantined", "unchanged", "indexed"]


def test_unknown_class_is_an_error(spark):
    with pytest.raises(Exception, match="unknown data class"):
        spark.range(1).select(ingest.source_class(F.lit("x"))).collect()


def test_orphans_refuse_an_empty_list(spark):
    objects = spark.createDataFrame([("s1/a",)], "storage_key string")
    with pytest.raises(ValueError):
        ingest.orphans(objects, spark.createDataFrame([], "source_id string"))


def test_grant_fold(spark):
    log = spark.createDataFrame([("u", "grant", 1, 1), ("u", "revoke", 2, 2), ("u", "grant", 3, 3), ("v", "grant", 1, 4), ("v", "revoke", 2, 5), ("v", "revoke", 3, 6), ("w", "revoke", 1, 7)], "user_id string, action string, at int, event_id int")
    assert rows(access.fold_grants(log, "user_id")) == [(1, 2, "v"), (3, None, "u")]


def test_faithfulness_without_a_verdict_is_null(spark):
    v = spark.createDataFrame([("a", "unclear"), ("b", "supported"), ("b", "unsupported")], "id string, verdict string")
    assert {r.id: r.faithfulness for r in evaluation.faithfulness(v).collect()} == {"a": None, "b": 0.5}


def test_gold_report(spark):
    q = spark.createDataFrame([("a", True, ["x", "y"]), ("b", False, []), ("c", True, ["z"])], "id string, answerable boolean, relevant array<string>")
    o = spark.createDataFrame([("a", "t", ["x"], ["x", "q"], False, True), ("b", "t", [], [], True, False)], "id string, answer string, retrieved array<string>, cited array<string>, refused boolean, truncated boolean")
    assert evaluation.gold_report(q, o).first().asDict() == {"recall": 0.5, "refusal_accuracy": 1.0, "fabricated": 1, "truncated": 1, "missing": 1}


# ---- chunks and redaction ----


def test_headings_in_code_are_text():
    got = C.chunk_markdown("# A\nsome text\n```\n# not a heading\n```\n## B\nmore text\n# C\nlast text")
    assert [c.path for c in got] == [["A"], ["A", "B"], ["C"]] and "# not a heading" in got[0].text
    assert C.chunk_markdown("# A\n--") == [] and C.chunk_markdown("") == []


def test_long_sections_overlap_and_tables_keep_their_header():
    b = C.Budget(size=10, overlap=3)
    text = "\n\n".join(f"word{i} " * 6 for i in range(4))
    got = C.chunk_markdown(text, b)
    assert len(got) == 4 and got[1].text.startswith("word0 word0 word0")
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | x |" for i in range(9))
    some = C.chunk_markdown(table, C.Budget(size=30, overlap=5))
    assert len(some) > 1 and all(c.text.startswith("| a | b |\n| --- | --- |") for c in some)


def test_table_chunks():
    t = {"headers": ["a"], "rows": [["x y z"]] * 6, "sheet_name": "S", "sheet_type": "tabular"}
    got = C.chunk_table(t, C.Budget(size=25, row_overlap=1))
    assert len(got) > 1 and all(c.text.startswith("# S\n\n| a |\n| --- |\n") for c in got)
    assert len(C.chunk_table(t | {"sheet_type": "financial_model"})) == 1
    assert C.chunk_table(t | {"sheet_type": "narrative"}) is None and C.chunk_table(t | {"rows": []}) is None


def test_titles():
    c = C.Chunk("# A › B\n\nx", ["A", "B"])
    assert C.with_title(c, "a").text == c.text
    assert C.with_title(c, " T  t ").text == "# T t › A › B\n\nx"
    assert C.with_title(C.Chunk("# comment\nx"), "T").text == "# T\n\n# comment\nx"


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, "T", "# H\nhello there"), (2, None, None)], "document_id long, title string, markdown string")
    got = C.chunk_documents(docs).collect()
    assert [(r.document_id, r.ordinal, r.text) for r in got] == [(1, 0, "# T › H\n\nhello there")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n#|-`", max_size=300))
def test_chunks_hold_every_word(text):
    b = C.Budget(size=5, overlap=0)
    got = "".join(c.text for c in C.chunk_markdown(text, b))
    for path, body in C.sections(text):
        if sum(c.isalnum() for c in body) >= 3:
            assert all(got.count(c) >= body.count(c) for c in "ab")


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="0123456789- SNabt,\n", max_size=120))
def test_no_sure_match_is_left(text):
    out, _ = R.redact(text)
    left = [m for m in R.scan(out) if m.high and m.rule in ("ssn", "ein", "card")]
    masked = out.replace("[REDACTED-", "")
    assert not left or masked != out  # only what masking itself brought together


def test_redaction():
    assert R.redact("a 123-45-6789 b") == ("a [REDACTED-SSN] b", {"ssn": 1})
    assert R.redact("Client SSN on file: 123456789")[0] == "Client SSN on file: [REDACTED-SSN]"
    assert R.redact("number 123456789")[0] == "number 123456789"
    assert R.redact("aba 021000021")[1] == {"routing": 1} and R.redact("code 021000021")[1] == {}
    assert R.redact("😀 123-45-6789")[0] == "😀 [REDACTED-SSN]"
    assert R.redact("4111 1111 1111 1112")[1] == {}


def test_packs_are_checked():
    for bad in ((), (R.Rule("a", "x"), R.Rule("a", "y")), (R.Rule("a", "x*"),), (R.Rule("a", "("),), (R.Rule("a", "x", check="no"),), (R.Rule("a", "x", window=501),)):
        with pytest.raises(ValueError):
            R.checked(bad)


def test_redact_documents(spark):
    docs = spark.createDataFrame([(1, "t", "x 123-45-6789"), (2, None, None)], "id long, title string, markdown string")
    got = {r.id: (r.markdown, r.redaction) for r in R.redact_documents(docs).collect()}
    assert got == {1: ("x [REDACTED-SSN]", {"ssn": 1}), 2: (None, {})}


def test_extraction_gate(spark):
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    flags = spark.createDataFrame([(2,)], "document_id long")
    decide = lambda *x: spark.createDataFrame([(2, v) for v in x], "document_id long, include boolean")
    assert rows(R.extraction_gate(docs, flags, decide(False), "me", "f", "f")) == [(1,)]
    for args in ((decide(), "me", "f", "f"), (decide(True, False), "me", "f", "f"), (decide(True), None, "f", "f"), (decide(True), "me", "g", "f")):
        with pytest.raises(ValueError):
            R.extraction_gate(docs, flags, *args)


def test_prompt_and_citations(spark):
    schema = "query_id long, citation int, document_id long, ordinal int, gap boolean, title string, text string, url string, doc_class string, modified_at string"
    res = spark.createDataFrame([(1, 1, 7, 0, False, 'A "b"', "x </document> y", "u", "A", "2024-01-02T00:00"), (1, 1, 7, 2, True, 'A "b"', "z", "u", "A", "2024-01-02T00:00"), (1, 2, 8, 0, False, None, "w", "u", "B", "soon")], schema)
    asked = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    assert results.prompt(res, asked).first().prompt == (
        '<document index="1" title="A &quot;b&quot;">\nx  y\n[...]\nz\n</document>\n\n<document index="2" title="">\nw\n</document>\n\nQuestion: why?'
    )
    got = {r.citation: (r.title, r.url, r.date) for r in results.citations(res).collect()}
    assert got == {1: ('A "b"', "u", "2024-01-02"), 2: (None, None, None)}


def test_storage_and_cursors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "document_id long, storage_key string")
    new = spark.createDataFrame([(1, None), (3, "c")], "document_id long, storage_key string")
    got = {r.document_id: (r.storage_key, r.previous_storage_key) for r in ingest.set_storage(docs, new).collect()}
    assert got == {1: (None, "a"), 2: ("b", None), 3: ("c", None)}
    sources = spark.createDataFrame([("s", "x", 1, 1), ("t", "y", 1, 1)], "source_id string, cursor string, last_synced_at int, updated_at int")
    moved = spark.createDataFrame([("s", "z", 5)], "source_id string, cursor string, synced_at int")
    assert {r.source_id: (r.cursor, r.last_synced_at, r.updated_at) for r in ingest.move_cursors(sources, moved).collect()} == {"s": ("z", 5, 5), "t": ("y", 1, 1)}


def test_rerank_keeps_order_without_scores(spark):
    res = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)], "query_id long, chunk_id long, rank int")
    scores = spark.createDataFrame([(1, 3, 0.9)], "query_id long, chunk_id long, rerank_score double")
    assert [r.chunk_id for r in retrieval.rerank(res, scores, 2).orderBy("rank").collect()] == [3, 1]


def test_windows_of_a_long_document_are_an_error(spark):
    docs = spark.createDataFrame([(1, "abcde"), (2, "")], "document_id long, target string")
    assert [(r.document_id, r.text) for r in R.scan_windows(docs, chars=2).orderBy("document_id", "window").collect()] == [(1, "ab"), (1, "cd"), (1, "e"), (2, "")]
    with pytest.raises(Exception, match="windows"):
        R.scan_windows(docs, chars=2, most=2).collect()


def test_chunks_within_a_budget_of_bpe_tokens(spark):
    """Every word of the text is in a chunk, each chunk within its size beside its overlap, and tails and heads are whole characters."""
    import public_tokenizers
    import tiktoken

    measure = C.Bpe.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(41)
    words = [rng.choice(["alpha", "naïve", "漢字", "x" * 9, "1234", "été"]) + rng.choice(["", ".", ","]) for _ in range(3000)]
    text = "\n\n".join(" ".join(words[i : i + 37]) for i in range(0, 3000, 37))
    docs = spark.createDataFrame([(1, "t", text), (2, None, None)], "document_id long, title string, markdown string")
    got = C.chunk_documents(docs, C.Budget(size=200, overlap=20, most=300), measure).orderBy("ordinal").collect()
    assert all(r.token_count <= 260 and r.token_count == measure.count(r.text) for r in got) and len(got) > 30
    joined = " ".join(r.text for r in got)
    assert all(p.strip() in joined for p in text.split("\n\n"))
    assert measure.tail("漢字", 1) in ("", "字") and measure.head("漢字", 1) in ("", "漢") and measure.tail("a b", 9) == "a b"
    assert isinstance(C._encoding(measure.ranks, measure.pattern), tiktoken.Encoding)


def test_sections_by_a_plain_stack():
    """Headings above each line, found anew for every section."""
    rng = random.Random(42)
    for _ in range(200):
        lines = [rng.choice(["# a", "## b", "### c", "###### f", "text", "", "```", "#no"]) for _ in range(rng.randint(0, 14))]
        want, stack, body, code = [], [], [], False
        for line in [*lines, "# end"]:
            mark = line.startswith("```")
            head = re.match(r"(#{1,6})\s+(.+)", line) if not (code or mark) or line == "# end" else None
            code ^= mark
            if head:
                if "\n".join(body).strip():
                    want.append(([t for _, t in stack], "\n".join(body).strip()))
                stack = [x for x in stack if x[0] < len(head[1])] + [(len(head[1]), head[2])]
                body = []
            else:
                body.append(line)
        assert C.sections("\n".join(lines)) == (want or [([], "\n".join(lines).strip())])
