import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakelore.functions import text as T
from lakelore.operators import lexical_index, retrieval, vector_index
from lakelore.operators.lexical_index import LexicalIndex
from lakelore.operators.vector_index import VectorIndex
from tests.conftest import rows

WORDS = ["common", *[f"w{i}" for i in range(60)], "rare", "running", "runs", "ran"]


def _chunks(spark, n, seed=1, first=0, vectors=0):
    """Texts of very different lengths; every one holds a common word; some sources, some vectors."""
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        size = rng.choice([3, 5, 8, 40, 200]) if i % 50 else 900
        words = ["common"] + [WORDS[min(int(rng.expovariate(0.08)), len(WORDS) - 1)] for _ in range(size)] + ["rare"] * (i % 97 == 0)
        kind = i % 9
        vector = [rng.gauss(kind == j % 9, 0.3) for j in range(vectors)] if vectors and i % 11 else None
        out.append((i, f"s{i % 4}", " ".join(words), vector))
    return spark.createDataFrame(out, "chunk_id long, source_id string, text string, embedding array<float>").repartition(4)


def _queries(spark, vectors=0):
    rng = random.Random(9)
    texts = ["common", "rare common", "w1 w2 w3", "w59 w40", "nothing here known", "the of and", "w5 rare w7 common w1", "running"]
    scopes = [None, ["s1"], None, ["s0", "s3"], None, None, [], None]
    some = [(i, t, s, [rng.gauss(i == j % 9, 0.3) for j in range(vectors)] if vectors else None) for i, (t, s) in enumerate(zip(texts, scopes, strict=True))]
    return spark.createDataFrame(some, "query_id long, text string, scope array<string>, embedding array<double>")


def _plain(queries, chunks, k, analyse=T.tokens):
    return rows(retrieval.sparse_top(queries, retrieval.postings(chunks, analyse), k, analyse))


def test_lexical_index_gives_what_scoring_everything_gives(spark, tmp_path):
    chunks, queries = _chunks(spark, 1500), _queries(spark)
    index = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
    assert index.search(queries, 5).count() == 0 and index.reads(queries, 5) == lexical_index.Read(0, 0, 0, 0)
    index.add(chunks)
    for k in (1, 7, 100, 5000):
        assert rows(index.search(queries, k)) == _plain(queries, chunks, k)
    assert rows(index.search(queries, 7, probe=1)) == _plain(queries, chunks, 7)
    read = index.reads(queries.where("query_id in (2, 6)"), 7)
    assert read.postings > 1500 and read.postings_read < read.postings / 3 and read.blocks_read < read.blocks / 2


def test_lexical_index_grows_and_forgets(spark, tmp_path, monkeypatch):
    queries = _queries(spark)
    index = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
    old, new = _chunks(spark, 400), _chunks(spark, 200, seed=5, first=400)
    assert index.add(old, "feed", 0) is not None and index.add(old, "feed", 0) is None
    index.add(new, "feed", 1)
    both = old.unionByName(new)
    assert rows(index.search(queries, 9)) == _plain(queries, both, 9)
    gone = spark.createDataFrame([(i,) for i in range(0, 600, 5)], "chunk_id long")
    index.remove(gone)
    left = both.join(gone, "chunk_id", "left_anti")
    assert rows(index.search(queries, 9)) == _plain(queries, left, 9)
    # Some come back with other texts.
    back = _chunks(spark, 600, seed=8).where("chunk_id % 10 = 0")
    index.add(back)
    left = left.unionByName(back)
    assert rows(index.search(queries, 9)) == _plain(queries, left, 9)
    # What is taken out or added while segments are merged counts.
    commit, late = index.log.commit, []

    def meanwhile(entry, *a, **k):
        if entry["kind"] == "merged" and not late:
            late.append(1)
            other = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
            other.remove(spark.createDataFrame([(1,), (10,)], "chunk_id long"))
            other.add(_chunks(spark, 3, seed=3, first=900))
        return commit(entry, *a, **k)

    monkeypatch.setattr(index.log, "commit", meanwhile)
    index.merge()
    left = left.where("chunk_id not in (1, 10)").unionByName(_chunks(spark, 3, seed=3, first=900))
    again = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
    assert len(again.live()) == 2 and rows(again.search(queries, 9)) == _plain(queries, left, 9)
    again.merge()
    assert len(again.live()) == 1 and rows(again.search(queries, 9)) == _plain(queries, left, 9)
    assert len(again.log.vacuum(grace=0)) > 3 and rows(again.search(queries, 9)) == _plain(queries, left, 9)
    assert again.add(old, "feed", 1) is None


def test_a_frequent_word_is_in_many_files(spark, tmp_path):
    """Every chunk holds one word: its blocks are small and spread over files."""
    index = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
    chunks = spark.range(4000, numPartitions=4).select(F.col("id").alias("chunk_id"), F.lit("s").alias("source_id"), F.concat(F.lit("common "), F.repeat(F.lit("x "), (F.col("id") % 7 * 20).cast("int"))).alias("text"))
    index.add(chunks)
    blocks = index.scan(index.live(), ["lexeme", "n", F.input_file_name().alias("file")]).where("lexeme = 'common'")
    assert blocks.agg(F.max("n")).first()[0] < 3 * lexical_index.RANGE and blocks.select("file").distinct().count() > 1


def test_blocks_are_made_where_chunks_are_dealt(spark, tmp_path, monkeypatch):
    """Chunks are dealt once, by range; how they come in batches and over how many tasks changes nothing; a segment without its tokens merges too."""
    monkeypatch.setattr(lexical_index, "TOKENS", 3000)
    chunks, queries = _chunks(spark, 400), _queries(spark)
    index = LexicalIndex(spark, str(tmp_path / "i"), T.tokens)
    index.add(chunks)
    plan = index._blocks(index.live()[0]["folders"][1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "Aggregate" not in plan
    dealt = [(t, r, i, f"s{i}", words) for t, r, i, words in ((1, 0, 1, ["b", "a", "b"]), (1, 0, 2, ["a"]), (1, 1, 3, ["a", "c", "c"]), (2, 1, 4, ["c", "a"]), (2, 1, 5, ["a"]))]
    whole = pa.RecordBatch.from_pylist([dict(zip(("tier", "range", "chunk_id", "source_id", "tokens"), d, strict=True)) for d in dealt])
    for size in (1, 2, 3, 5):
        made = [b for batch in lexical_index._blocks_of(whole.slice(i, size) for i in range(0, 5, size)) for b in batch.to_pylist()]
        got = {(b["tier"], b["range"], b["lexeme"]): (b["most"], b["n"], [(p["chunk_id"], p["source_id"], p["places"]) for p in b["postings"]]) for b in made}
        assert len(made) == len(got) and got == {
            (1, 0, "a"): (1, 2, [(1, "s1", 1), (2, "s2", 1)]), (1, 0, "b"): (2, 1, [(1, "s1", 2)]), (1, 1, "a"): (1, 1, [(3, "s3", 1)]),
            (1, 1, "c"): (2, 1, [(3, "s3", 2)]), (2, 1, "a"): (1, 2, [(4, "s4", 1), (5, "s5", 1)]), (2, 1, "c"): (1, 1, [(4, "s4", 1)]),
        }
    live = index.live
    monkeypatch.setattr(index, "live", lambda: [e | {"folders": e["folders"][:1]} for e in live()])
    index.remove(chunks.where("chunk_id % 7 = 0"))
    index.merge()
    assert len(live()) == 1 and rows(index.search(queries, 9)) == _plain(queries, chunks.where("chunk_id % 7 <> 0"), 9)


def test_english_index_and_distinct_stems(spark, tmp_path):
    """Stems found once for each word give the postings of stemming each place."""
    chunks, queries = _chunks(spark, 120), _queries(spark)
    words = chunks.select("chunk_id", "source_id", F.explode(retrieval.english_tokens(F.col("text"))).alias("lexeme"))
    want = rows(words.groupBy("lexeme", "chunk_id", "source_id").agg(F.count("*").alias("places")))
    assert rows(retrieval.postings(chunks)) == want
    wanted = spark.createDataFrame([("run",), ("rare",)], "lexeme string")
    assert rows(retrieval.postings(chunks, wanted=wanted)) == [r for r in want if r[1] in ("run", "rare")]
    index = LexicalIndex(spark, str(tmp_path / "i"))
    index.add(chunks)
    assert rows(index.search(queries, 6)) == rows(retrieval.sparse_top(queries, retrieval.postings(chunks), 6))


def test_vector_index(spark, tmp_path):
    chunks, queries = _chunks(spark, 900, vectors=16), _queries(spark, vectors=16)
    index = VectorIndex(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="train first"):
        index.add(chunks)
    assert index.search(queries, 5).count() == 0
    index.train(chunks)
    odd = spark.createDataFrame([(5000, "s", "x", [0.0] * 16), (5001, "s", "x", [1.0] * 3), (5002, "s", "x", [float("nan")] * 16), (5003, "s", "x", None)], chunks.schema)
    assert index.add(chunks.unionByName(odd), "feed", 0) is not None and index.add(chunks, "feed", 0) is None
    exact = retrieval.dense_top(queries, chunks, 10)
    assert rows(index.search(queries, 10, probes=1000)) == rows(exact)
    asked = chunks.where("embedding is not null").select(F.col("chunk_id").alias("query_id"), "embedding", F.lit(None).cast("array<string>").alias("scope"))
    exact = retrieval.dense_top(asked, chunks, 10)
    got = vector_index.recall(index.search(asked, 10), exact)
    assert got.agg(F.avg("recall")).first()[0] >= 0.9 and index._about()["probes"] < 30
    one = vector_index.recall(index.search(asked, 10, probes=1), exact).agg(F.avg("recall")).first()[0]
    assert one < 1.0 and got.where("wanted <> 10").isEmpty()
    with pytest.raises(Exception, match="not finite"):
        index.search(queries.withColumn("embedding", F.array_repeat(F.lit(float("inf")), 16)), 3).count()
    with pytest.raises(Exception, match="components"):
        index.search(queries.withColumn("embedding", F.array_repeat(F.lit(1.0), 3)), 3).count()


def test_vector_index_grows_and_forgets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    chunks, queries = _chunks(spark, 500, vectors=8), _queries(spark, vectors=8)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.train(chunks, lists=6)
    index.add(chunks.where("chunk_id < 300"))
    index.remove(chunks.where("chunk_id % 4 = 0").select("chunk_id"))
    index.add(chunks.where("chunk_id >= 300 or chunk_id % 8 = 0"))
    there = chunks.where("chunk_id >= 300 or chunk_id % 4 <> 0 or chunk_id % 8 = 0")
    exact = rows(retrieval.dense_top(queries, there, 12))
    assert rows(index.search(queries, 12, probes=6)) == exact
    monkeypatch.setattr(vector_index, "FEW_BYTES", 0)  # many queries: dealt by block, not broadcast
    assert rows(index.search(queries, 12, probes=6)) == exact
    index.merge()
    assert len(index.live()) == 1 and rows(index.search(queries, 12, probes=6)) == exact
    index.remove(spark.createDataFrame([(301,)], "chunk_id long"))
    assert rows(index.search(queries, 12, probes=6)) == rows(retrieval.dense_top(queries, there.where("chunk_id <> 301"), 12))
    most = index.scan(index.live(), [F.size("ids").alias("n")]).agg(F.max("n")).first()[0]
    assert most < 60


def test_many_queries_hold_few_scores_at_once(spark, monkeypatch):
    """20000 queries by 3000 chunks: 480 MB as one matrix of scores. In groups, with ties, other lengths and nulls, they find what one by one they do."""
    rng = np.random.default_rng(3)
    q, x = rng.integers(-3, 4, (20_000, 4)).astype(float), rng.integers(-3, 4, (3000, 4)).astype(float)
    tracemalloc.start()
    nearest = retrieval.Nearest(q, [None] * len(q), 5, 6)
    nearest.add(x, np.arange(len(x)), ["s"] * len(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    with np.errstate(invalid="ignore", divide="ignore"):
        scores = np.round(q[:500] @ x.T / np.linalg.norm(q[:500], axis=1)[:, None] / np.linalg.norm(x, axis=1), 6) + 0.0
    scores[:, ~x.any(1)] = -np.inf
    want = {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s))[:5]] for i, s in enumerate(scores) if q[i].any()}
    found = {i: [int(c) for c in nearest.best.chunk[nearest.best.query == i]] for i in range(500) if q[i].any()}
    assert found == want
    for name, n in (("QUERY_BYTES", 64), ("GROUP", 90), ("SHELF", 50), ("STRIPE", 3), ("CELLS", 700), ("EXACT", 64)):
        monkeypatch.setattr(retrieval, name, n)
    asked = spark.createDataFrame([(i, q[i].tolist(), None) for i in range(500)] + [(500, [1.0] * 3, None), (501, None, None)], "query_id long, embedding array<double>, scope array<string>")
    chunks = spark.createDataFrame([(i, "s", x[i].tolist()) for i in range(3000)] + [(3000, "s", [1.0, 2.0, 2.0]), (3001, "s", [None, 1.0, 1.0, 1.0])], "chunk_id long, source_id string, embedding array<double>")
    got = rows(retrieval.dense_top(asked, chunks, 5).select("query_id", "rank", "chunk_id"))
    assert got == sorted([(c, i, k + 1) for i, of in want.items() for k, c in enumerate(of)] + [(3000, 500, 1)], key=repr)
    with pytest.raises(Exception, match="not finite"):
        retrieval.dense_top(asked.withColumn("embedding", F.array_repeat(F.lit(float("nan")), 4)), chunks, 5).count()


def test_lists_to_read_are_measured():
    """Few lists where vectors fall into groups, many where they don't; all there are at most."""
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(20, 16))
    far = [vector_index.probes_for(groups[rng.integers(0, 20, 2000)] + s * rng.normal(size=(2000, 16)), groups) for s in (0.01, 1.0, 50.0)]
    assert far[0] == 1 and far[0] < far[1] < far[2] <= 20
    assert vector_index.probes_for(groups[:1], groups[:1]) == 1


def test_candidates_of_a_search():
    assert [vector_index.ef_search(p, c) for p, c in ((12, 100), (500, 100), (5000, 100), (12, 3), (12, 9000))] == [100, 500, 1000, 40, 1000]


def test_hybrid_over_indexes(spark, tmp_path):
    chunks = _chunks(spark, 300, vectors=8).withColumns({"document_id": F.col("chunk_id"), "lifecycle_status": F.lit("active")})
    queries = _queries(spark, vectors=8)
    words, vectors = LexicalIndex(spark, str(tmp_path / "i"), T.tokens), VectorIndex(spark, str(tmp_path / "v"))
    words.add(chunks)
    vectors.train(chunks, lists=4)
    vectors.add(chunks)
    got = retrieval.hybrid(queries, chunks, analyse=T.tokens, lexical=words.search, near=lambda q, k: vectors.search(q, k, probes=4))
    assert rows(got) == rows(retrieval.hybrid(queries, chunks, analyse=T.tokens))
    with pytest.raises(ValueError):
        retrieval.hybrid(queries, chunks, keep=F.lit(True), lexical=words.search)


def test_only_texts_that_were_found_are_joined(spark):
    """Chunks whose vectors come from another table: what wasn't found is left out before its text is dealt to that join."""
    made, queries = _chunks(spark, 100, vectors=8), _queries(spark, vectors=8)
    texts = made.drop("embedding").withColumns({"document_id": F.col("chunk_id"), "lifecycle_status": F.lit("active")})
    chunks = texts.join(made.select("chunk_id", "embedding"), "chunk_id", "left")
    got = retrieval.hybrid(queries, chunks, retrieval.Fusion(top_k=2), analyse=T.tokens)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("LeftOuter") < plan.find("LeftSemi") and got.count() == 2 * queries.where("scope is null or size(scope) > 0").count()
