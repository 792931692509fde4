"""The registered queries with SQL, and the pipeline's stages, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakelore.llm.common import settle
from lakelore.llm.queries import oracle_sql, queries
from tests.llm.test_dedup import brute_lines, brute_near
from tests.llm.test_passages import brute_passages


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries()[name](spark, data)
    found = con.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    names = sorted(got.columns)
    assert sorted(columns) == names
    want = sorted([tuple(str(r[columns.index(n)]) for n in names) for r in found.fetchall()])
    assert sorted([tuple(str(r[n]) for n in names) for r in got.collect()]) == want


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = list(docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "line_dedup", "near_duplicates", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, data))
        assert out.columns == names, name
        kept.append((name, docs, out))
        docs = out
    by = {n: (a, b) for n, a, b in kept}
    a, b = by["language"]
    assert a.where(F.col("text").rlike(r"\p{L}")).count() == b.count()
    a, b = by["quality"]
    assert b.join(a, "doc_id", "left_semi").count() == b.count() < a.count()
    a, b = by["line_dedup"]
    rows = [(r.doc_id, r.text) for r in a.orderBy("doc_id").collect()]
    want = {i: t for (i, was), t in zip(rows, brute_passages(brute_lines([t for _, t in rows], 50), 50), strict=True) if t == was or t.strip()}
    assert {r.doc_id: r.text for r in b.collect()} == want
    a, b = by["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in a.orderBy("doc_id").collect()]
    want = {rows[k][0] for k, (n, root) in enumerate(brute_near([t for _, t in rows], 80)) if root == k}
    assert {r.doc_id for r in b.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_language_stage_without_a_language(spark, data):
    """No language is known, so none is learned: documents with a letter stay all the same."""
    rows = [(1, "clean words of a document", None, "s", 25), (2, None, None, "s", 0), (3, " 12 ", None, "s", 4), (None, "été", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, docs, data).collect()
    assert sorted(map(tuple, got), key=str) == sorted((rows[0], rows[3]), key=str)
