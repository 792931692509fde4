from pyspark.sql import functions as F

from lakelore.functions import embedding
from lakelore.operators import ingest, retrieval
from lakelore.operators.embedding_store import EmbeddingStore

OLD, NEW = ("local", "words-16"), ("local", "words-32")


def _chunks(spark, *texts):
    rows = spark.createDataFrame([(i, i, "s", t, "active") for i, t in enumerate(texts)], "chunk_id long, document_id long, source_id string, text string, lifecycle_status string")
    return rows.withColumn("chunk_hash", ingest.chunk_hash(F.array().cast("array<string>"), F.coalesce("text", F.lit(""))))


def _embed(n, seen=None):
    def run(rows):
        if seen is not None:
            seen.append(sorted(r.text or "" for r in rows.collect()))
        return embedding.embed(rows, dimensions=n)

    return run


def test_only_what_is_missing_is_computed(spark, tmp_path):
    store, seen = EmbeddingStore(spark, str(tmp_path / "e")), []
    chunks = _chunks(spark, "one apple", "two pears", "one apple", "", None)
    assert store.active() is None and store.embedded(chunks).where("embedding is not null").count() == 0
    assert store.refresh(chunks, *OLD, _embed(16, seen)) == 3 and seen[-1] == ["", "one apple", "two pears"]
    assert store.refresh(chunks, *OLD, _embed(16, seen)) == 0 and seen[-1] == []
    changed = _chunks(spark, "one apple", "three plums", "one apple", "", None)
    assert store.refresh(changed, *OLD, _embed(16, seen)) == 1 and seen[-1] == ["three plums"]
    store.activate(*OLD)
    got = {r.chunk_id: r for r in EmbeddingStore(spark, str(tmp_path / "e")).embedded(changed).collect()}
    assert len(got) == 5 and all(len(r.embedding) == 16 and r.embedding_model == OLD[1] for r in got.values())
    want = {r.chunk_id: r.embedding for r in embedding.embed(changed, dimensions=16).collect()}
    assert {i: r.embedding for i, r in got.items()} == want


def test_searches_see_the_old_model_until_the_switch(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "e"))
    chunks = _chunks(spark, "one apple", "two pears", "three plums")
    store.refresh(chunks, *OLD, _embed(16))
    store.activate(*OLD)
    ask = lambda n: embedding.embed(spark.createDataFrame([(1, "apple one")], "query_id long, text string"), dimensions=n).withColumn("scope", F.lit(None).cast("array<string>"))

    def hits(n):
        return [(r.chunk_id, r.score) for r in retrieval.dense_top(ask(n), retrieval.visible(store.embedded(chunks), *store.active()), 1).collect()]

    assert hits(16) == [(0, 1.0)]
    assert store.refresh(chunks, *NEW, _embed(32)) == 3
    assert store.active() == OLD and hits(16) == [(0, 1.0)] and hits(32) == []
    store.activate(*NEW)
    assert hits(32) == [(0, 1.0)] and hits(16) == []
    assert store.embedded(chunks, *OLD).where("size(embedding) = 16").count() == 3  # the way back is open


def test_vectors_that_no_chunk_has_go(spark, tmp_path, monkeypatch):
    store = EmbeddingStore(spark, str(tmp_path / "e"))
    store.refresh(_chunks(spark, "a b", "c d", "e f"), *OLD, _embed(16))
    store.refresh(_chunks(spark, "x y"), *NEW, _embed(32))
    commit, late = store.log.commit, []

    def meanwhile(entry, *a, **k):
        if entry["kind"] == "pruned" and not late:
            late.append(EmbeddingStore(spark, str(tmp_path / "e")).refresh(_chunks(spark, "later"), *OLD, _embed(16)))
        return commit(entry, *a, **k)

    monkeypatch.setattr(store.log, "commit", meanwhile)
    store.prune(_chunks(spark, "a b"), *OLD)
    assert late == [1] and store.missing(_chunks(spark, "a b", "later", "c d"), *OLD).count() == 1 and store.missing(_chunks(spark, "x y"), *NEW).count() == 0
