"""Every operator and stage on odd tables: nulls, ties, repeated rows, empty and very long texts, and columns with names of their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakelore.llm import bpe, chat, dac, exact_dedup, langid, line_dedup, ngram_join, packing, passage_dedup, quality, syncmers
from tests.llm.conftest import ODD

#: Names that operators use within; a user's columns may have them too.
NAMES = [
    "__row", "__text", "__gone", "__parts", "__blocks", "__was", "__key", "__words", "__inner", "__found", "__both", "__last", "__n", "row", "file", "text_", "pos", "h1", "since", "to",
    "n", "name", "host", "path", "size", "token", "short", "root", "stays", "kept", "part", "at", "words", "context", "ids", "score", "removed_words", "lang_pred", "n_blocks", "low",
]
FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    """odd: repeated rows under clashing names, all alike (as a struct, a string or null); one: a single row; none: no row."""
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(ODD)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same = [(F.struct(F.lit(1).alias("file"), F.lit(1).alias("row")) if k % 3 == 0 else F.lit("clash") if k % 3 == 1 else F.lit(None).cast("double")).alias(n) for k, n in enumerate(NAMES)]
    return {"odd": plain.select("*", *same), "one": plain.where("doc_id = 4").select("*", *same), "none": plain.limit(0).select("*", *same), "plain": plain}


def _same(found, rows):
    """Rows with the texts they had or have; other columns pass through."""
    assert found.select("__row", "__text", "n").distinct().count() == (1 if rows else 0)
    return found.count() == rows


@pytest.mark.parametrize("which", ["odd", "one", "none"])
def test_operators(spark, tables, vocab, which):
    docs = tables[which]
    n = {"odd": 11, "one": 1, "none": 0}[which]
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    judged = quality.classify(docs, labels)
    assert judged.count() == n and judged.where("low is null or toxic is null or kept is null").count() == 0
    found = exact_dedup.dedup(docs)
    assert found.count() == n and found.where("kept").count() == {"odd": 7, "one": 1, "none": 0}[which]
    assert syncmers.fingerprints(docs).where("near_next between 0 and 1").count() == n
    assert langid.identify(docs, langid.fit(docs)).where("score between 0 and 1").count() == n
    pieces = packing.pack(docs, vocab("word_bpe_49k.json"))
    assert (pieces.agg(F.sum("length")).first()[0] or 0) >= n
    near = ngram_join.near_duplicates(docs)
    assert near.count() == n and near.where("stays").count() == {"odd": 9, "one": 1, "none": 0}[which]
    for dedup in (line_dedup.dedup_lines, passage_dedup.dedup_passages, passage_dedup.dedup):
        assert _same(dedup(docs), n)
    assert dac.read(spark, dac.write(docs, vocab("word_bpe_49k.json"))).count() == n
    assert _same(bpe.encode_and_decode(docs.drop("ids"), vocab("byte_bpe_50k.json")), n)
    turns = docs.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"})
    read = chat.digests(chat.read_chats(chat.format_chats(turns)))
    assert (read.agg(F.sum("n_turns")).first()[0] or 0) == n


@pytest.mark.parametrize("which", ["odd", "one", "none"])
def test_stages(spark, tables, data, which):
    docs = tables[which]
    kept = {"language": {"odd": 8, "one": 1, "none": 0}, "line_dedup": {"odd": 11, "one": 1, "none": 0}, "near_duplicates": {"odd": 9, "one": 1, "none": 0}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == FIELDS
        assert out.count() == kept.get(name, {}).get(which, out.count()), name
    assert corpus_pipeline.pack(spark, docs, data).select("doc_id").distinct().count() == {"odd": 10, "one": 1, "none": 0}[which]


def test_a_column_named_like_a_row_id_is_no_row_id(tables):
    """Repeated rows under an alike ``__row``: the first occurrence keeps its text, one of a component stays."""
    rows = tables["plain"].limit(0).sparkSession.createDataFrame([(1, "w " * 60, "x"), (2, "w " * 60, "x"), (3, "other", "x")], "doc_id long, text string, __row string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()} == {1: "w " * 60, 2: "", 3: "other"}
    found = {r.doc_id: (r.component_id, r.stays) for r in ngram_join.near_duplicates(rows).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (3, True)}
