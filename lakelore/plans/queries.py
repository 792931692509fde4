"""Registered queries over the driver's tables, each with SQL for comparison where SQL can say it.

The tables play these parts: documents are documents and chunks (with embeddings' vectors of the same number), toxic labels
mark withdrawn documents, benchmark items are questions, events are logs, customers and orders are grants.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import answers, claims, embedding, english, identifiers, text as T
from ..functions.sheets import sheet_type
from ..operators import access, audit, chunking, evaluation, ingest, quotes, redaction, results, retrieval
from ..operators.claims import Claims
from ..operators.embedding_store import EmbeddingStore
from ..operators.lexical_index import LexicalIndex
from ..operators.vector_index import LISTS, VectorIndex, recall
from ..session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the tables in their parts ------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    toxic = table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(vectors, "doc_id", "left").join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), "lang", "text", "embedding",
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "withdrawn").otherwise("active").alias("lifecycle_status"),
    )


def questions(spark: SparkSession, d: str, scope: str = "cast(null as array<string>)") -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.expr(scope).alias("scope"))
    return items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_PARTS = """
chunks AS (
  SELECT d.doc_id AS chunk_id, d.source AS source_id, d.lang, d.text, CAST(e.embedding AS DOUBLE[]) AS embedding, coalesce(l.toxic, 0) = 0 AS active
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
), questions AS (
  SELECT b.item_id AS query_id, b.text, CAST(e.embedding AS DOUBLE[]) AS embedding, {scope} AS scope FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
), seen AS (SELECT * FROM chunks WHERE active {keep}),
has AS (
  SELECT chunk_id, t AS lexeme, count(*) AS places FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {of})
  WHERE t <> '' AND t NOT IN ({stop}) GROUP BY ALL
), asked AS (
  SELECT DISTINCT query_id, t AS lexeme FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM questions)
  WHERE t <> '' AND t NOT IN ({stop})
)"""


def _parts(scope: str = "CAST(NULL AS VARCHAR[])", keep: str = "", of: str = "chunks") -> str:
    return "WITH " + _PARTS.format(scope=scope, keep=keep, of=of, stop=_STOP)


_DENSE = """, dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(list_cosine_similarity(c.embedding, q.embedding), 6) AS score
    FROM questions q JOIN seen c ON c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND (q.scope IS NULL OR list_contains(q.scope, c.source_id)))
  QUALIFY rank <= {pool}
)"""
_SPARSE = """, sparse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(places) * 0.1::DOUBLE, 6) AS score FROM asked JOIN has USING (lexeme) JOIN seen USING (chunk_id) JOIN questions q USING (query_id)
    WHERE q.scope IS NULL OR list_contains(q.scope, seen.source_id) GROUP BY ALL)
  QUALIFY rank <= {pool}
)"""
_FUSED = """, fused AS (
  SELECT query_id, chunk_id, coalesce(d.score, 0) AS dense_score, coalesce(s.score, 0) AS sparse_score,
    0.7::DOUBLE / (60 + coalesce(d.rank, 1000000)) + 0.3::DOUBLE / (60 + coalesce(s.rank, 1000000)) AS rrf
  FROM dense d FULL JOIN sparse s USING (query_id, chunk_id)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id) AS rank FROM fused {filter} QUALIFY rank <= 12
), covered AS (
  SELECT query_id, chunk_id, count(*) AS n FROM best JOIN asked USING (query_id) JOIN has USING (chunk_id, lexeme) GROUP BY ALL
)"""
_RESULT = """
SELECT b.query_id, b.rank, b.chunk_id, b.chunk_id AS document_id, c.source_id, round(rrf / greatest(max(rrf) OVER (PARTITION BY b.query_id), 1e-9), 6) AS score,
  dense_score, sparse_score, round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM asked a WHERE a.query_id = b.query_id), 6) AS keyword_coverage
FROM best b JOIN chunks c USING (chunk_id) LEFT JOIN covered v USING (query_id, chunk_id)"""


def _hybrid_sql(scope: str = "CAST(NULL AS VARCHAR[])", keep: str = "", filter: str = "", pool: int = 96) -> str:
    return _parts(scope, keep) + _DENSE.format(pool=pool) + _SPARSE.format(pool=pool) + _FUSED.format(filter=filter) + _RESULT


#: Documents as they are nowhere in the tables: eleven of twelve hold a number, a label, a heading, a fence or a table, by their doc_id.
_PLANTED = """CASE doc_id % 12 WHEN 0 THEN concat(coalesce(text, ''), ' on file 123-45-', 1000 + doc_id % 9000, '.')
  WHEN 1 THEN concat('EIN 12-3456789 stands first. ', coalesce(text, '')) WHEN 2 THEN concat(coalesce(text, ''), ' The taxpayer owed $1,2', doc_id)
  WHEN 3 THEN concat('# Form 1040 shows $5,000', chr(10), coalesce(text, '')) WHEN 4 THEN concat(coalesce(text, ''), ' A 1099-MISC for $600, a W-2 of $70,000; SSN on file: 12345', 1000 + doc_id % 9000)
  WHEN 5 THEN concat('## Schedule C: $300', chr(10), '# Title ', doc_id, ' ', chr(10), coalesce(text, ''))
  WHEN 6 THEN concat('Taxpayer ID list 123456789, 98765', 1000 + doc_id % 9000, ' and 111222333. ', coalesce(text, ''))
  WHEN 7 THEN concat(coalesce(text, ''), ' runs 123456789, 987654321 and 111222333, and 12 3456789x')
  WHEN 8 THEN concat('```', chr(10), '# no heading', chr(10), '```', chr(10), '| a | b |', chr(10), '|---|:-:|', chr(10), '| ', doc_id, ' | x |', chr(10), coalesce(text, ''))
  WHEN 9 THEN concat(coalesce(text, ''), chr(10), '| one |', chr(10), '| --- |', chr(10), chr(10), '| no rule |', chr(10), '| two |', chr(10), '|-|', chr(10), '| 1 |', chr(10), '| 2 |')
  WHEN 10 THEN concat('Dear Mrs Smith, routing number: 021000021, account no. 000123456. Engagement letter for 000-12-3456 and 666-12-3456. ', coalesce(text, '')) ELSE text END"""
_PLANTED_DOCS = f"(SELECT * EXCLUDE (text), {_PLANTED} AS text FROM documents)"


def planted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", F.expr(_PLANTED.replace("chr(10)", "char(10)")))


# ---- retrieval ----------------------------------------------------------------------------------------------------------


@query(_parts() + _DENSE.format(pool=12) + "SELECT * FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top(questions(spark, d), retrieval.visible(chunks(spark, d)), 12)


@query(_parts() + _SPARSE.format(pool=12) + "SELECT * FROM sparse")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_top(questions(spark, d), retrieval.postings(retrieval.visible(chunks(spark, d)), T.tokens), 12, T.tokens)


@query()
def sparse_english(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search with English stems; DuckDB has no stemmer here, so tests hold it against a plain version."""
    asked = questions(spark, d)
    wanted = retrieval.asked_lexemes(asked).select("lexeme").distinct()
    return retrieval.sparse_top(asked, retrieval.postings(retrieval.visible(chunks(spark, d)), wanted=wanted), 12)


@query()
def hybrid_english(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d), chunks(spark, d))


@query(_hybrid_sql())
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens)


def _index(spark: SparkSession, d: str) -> LexicalIndex:
    """An index of the visible chunks, built in steps: some are added later, some are taken out and added again, and all is merged once."""
    index = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", T.tokens, buckets=4)
    seen = retrieval.visible(chunks(spark, d))
    index.add(seen.where("chunk_id % 3 <> 0"))
    index.remove(seen.where("chunk_id % 7 = 1").select("chunk_id"))
    index.merge()
    index.add(seen.where("chunk_id % 3 = 0"))
    index.replace(seen.where("chunk_id % 7 = 1"))
    return index


@query(_parts() + _SPARSE.format(pool=12) + "SELECT * FROM sparse")
def sparse_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(questions(spark, d), 12)


@query(_hybrid_sql("['src0', concat('src', b.item_id % 20)]"))
def hybrid_index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d, "array('src0', concat('src', item_id % 20))"), chunks(spark, d), analyse=T.tokens, lexical=_index(spark, d).search)


def _vectors(spark: SparkSession, d: str) -> VectorIndex:
    index = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    seen = retrieval.visible(chunks(spark, d))
    index.train(seen)
    index.add(seen.where("chunk_id % 3 <> 0"))
    index.remove(seen.where("chunk_id % 7 = 1").select("chunk_id"))
    index.merge()
    index.add(seen.where("chunk_id % 3 = 0"))
    index.remove(seen.where("chunk_id % 7 = 1").select("chunk_id"))
    index.add(seen.where("chunk_id % 7 = 1"))
    return index


@query(_parts() + _DENSE.format(pool=12) + "SELECT * FROM dense")
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    """With every list read, the index gives what the exact scan does."""
    return _vectors(spark, d).search(questions(spark, d), 12, probes=LISTS)


@query()
def dense_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest the index finds, of each question and each vector as one, reading few lists."""
    seen = retrieval.visible(chunks(spark, d))
    asked = seen.where("embedding is not null").select(F.col("chunk_id").alias("query_id"), "embedding", F.lit(None).cast("array<string>").alias("scope"))
    return recall(_vectors(spark, d).search(asked, 10), retrieval.dense_top(asked, seen, 10))


@query(_hybrid_sql("['src0', concat('src', b.item_id % 20)]"))
def hybrid_scoped(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d, "array('src0', concat('src', item_id % 20))"), chunks(spark, d), analyse=T.tokens)


@query(_hybrid_sql("CAST([] AS VARCHAR[])"))
def hybrid_deny_all(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d, "cast(array() as array<string>)"), chunks(spark, d), analyse=T.tokens)


@query(_hybrid_sql(keep="AND lang = 'en'"))
def hybrid_optional_pre(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens, keep=F.col("lang") == "en")


_EN = "WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE lang = 'en')"


@query(
    _parts() + _DENSE.format(pool=1000).replace("dense AS", "dense_all AS") + _SPARSE.format(pool=1000).replace("sparse AS", "sparse_all AS")
    + f""", few AS (
  SELECT query_id FROM questions WHERE query_id NOT IN (
    SELECT query_id FROM (SELECT query_id, chunk_id FROM dense_all WHERE rank <= 96 UNION SELECT query_id, chunk_id FROM sparse_all WHERE rank <= 96)
    {_EN} GROUP BY query_id HAVING count(*) >= 12)
), dense AS (SELECT * FROM dense_all WHERE rank <= 96 OR query_id IN (FROM few)), sparse AS (SELECT * FROM sparse_all WHERE rank <= 96 OR query_id IN (FROM few))"""
    + _FUSED.format(filter=_EN) + _RESULT
)
def hybrid_optional_post(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens, keep=F.col("lang") == "en", optional="post")


@query(_parts() + "SELECT query_id, chunk_id, round(count(*)::DOUBLE / n, 6) AS keyword_coverage FROM asked JOIN has USING (lexeme) JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id) USING (query_id) GROUP BY query_id, chunk_id, n")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.lexemes(F.col("text")).alias("q"))
    lexemes = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("lexeme"))
    has = retrieval.postings(chunks(spark, d), T.tokens, lexemes.select("lexeme").distinct()).select("lexeme", "chunk_id")
    return has.join(lexemes, "lexeme").groupBy("query_id", "chunk_id", "n").agg(F.count("*").alias("k")).select("query_id", "chunk_id", F.round(F.col("k") / F.col("n"), 6).alias("keyword_coverage"))


@query(_hybrid_sql().replace("SELECT b.query_id, b.rank", "SELECT * FROM (SELECT b.query_id, b.rank") + ") WHERE dense_score >= 0.3 OR keyword_coverage >= 0.5")
def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens)
    return found.where(retrieval.passes_floor(F.col("dense_score"), F.col("keyword_coverage"), F.col("sparse_score"), 0.3))


@query("SELECT query_id, max(dense_score) AS top_score FROM (" + _hybrid_sql() + ") GROUP BY query_id")
def top_relevance(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_relevance(retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens))


@query(_parts(keep="AND chunk_id % 3 = 1") + _DENSE.format(pool=12) + "SELECT * FROM dense")
def model_hits(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of another provider or model aren't seen, whatever their length."""
    named = chunks(spark, d).withColumns({"embedding_provider": F.when(F.col("chunk_id") % 3 == 0, "other").otherwise("local"), "embedding_model": F.when(F.col("chunk_id") % 3 == 1, "m1").otherwise("m2")})
    return retrieval.dense_top(questions(spark, d), retrieval.visible(named, "local", "m1"), 12)


@query(f"""
WITH h AS ({_hybrid_sql()}), s AS (SELECT *, CASE WHEN chunk_id % 3 > 0 THEN chunk_id * 7 % 11 END AS r FROM h)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC NULLS LAST, rank, chunk_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC NULLS LAST, rank, chunk_id) <= 5""")
def rerank_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits in the order of another judge's scores, which every third hit lacks."""
    found = retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens)
    scores = found.where("chunk_id % 3 > 0").select("query_id", "chunk_id", (F.col("chunk_id") * 7 % 11).cast("double").alias("rerank_score"))
    return retrieval.rerank(found, scores, 5).select("query_id", "chunk_id", "rank")


@query("SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k') IN ('7', '69', '89'), false)")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(retrieval.json_filter(F.col("props"), {"k": ["7", "69", "89"]})).select("event_id")


@query("""
SELECT vec_id, round(u[1], 6) AS first, round(u[len(u)], 6) AS last, round(list_sum(list_transform(u, lambda x, i: x * i)), 4) AS weighted, round(list_sum(list_transform(u, lambda x: abs(x))), 4) AS total
FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def normalise_vectors(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "embeddings").select("vec_id", embedding.normalised(F.col("embedding")).alias("u"))
    weighted = F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(weighted, 4).alias("weighted"), F.round(total, 4).alias("total"))


@query()
def embed_hashing(spark: SparkSession, d: str) -> DataFrame:
    return embedding.embed(table(spark, d, "documents").select("doc_id", "text"))


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END AS text FROM t)
SELECT 1 AS run, (SELECT count(DISTINCT text) FROM t WHERE doc_id % 3 <> 0) AS computed, 'none' AS active
UNION ALL SELECT 2, (SELECT count(DISTINCT text) FROM t WHERE text NOT IN (SELECT text FROM t WHERE doc_id % 3 <> 0)), 'words-64'
UNION ALL SELECT 3, 0, 'words-64' UNION ALL SELECT 4, (SELECT count(DISTINCT text) FROM c WHERE text NOT IN (FROM t SELECT text)), 'words-64'
UNION ALL SELECT 5, (SELECT count(DISTINCT text) FROM c), 'words-64' UNION ALL SELECT 6, 0, 'words-32'""")
def embedding_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors each run computes, and the model that searches see before it: some documents, all, all again, some changed, under a new model, again."""
    store = EmbeddingStore(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = lambda rows: rows.withColumn("chunk_hash", ingest.chunk_hash(F.array().cast("array<string>"), F.col("text")))
    whole = hashed(docs)
    changed = hashed(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))))
    runs = []
    for n, (rows, size) in enumerate([(whole.where("doc_id % 3 <> 0"), 64), (whole, 64), (whole, 64), (changed, 64), (changed, 32), (changed, 32)], 1):
        active = store.active()
        runs.append((n, store.refresh(rows, "local", f"words-{size}", lambda r, size=size: embedding.embed(r, dimensions=size)), active[1] if active else "none"))
        if n in (1, 5):
            store.activate("local", f"words-{size}")
    return spark.createDataFrame(runs, "run int, computed long, active string")


# ---- after retrieval ----------------------------------------------------------------------------------------------------

_TURNS = "SELECT conv_id AS query_id, turn + 1 AS rank, conv_id * 1000 + turn AS chunk_id, role AS document_id, turn AS ordinal, text FROM conversations"


def ranked_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as ranked results: a conversation is a query, a role a document, the turn its rank and place."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("role").alias("document_id"), F.col("turn").alias("ordinal"), "text"
    )


_BODY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT query_id, rank, chunk_id FROM ({_TURNS}) QUALIFY row_number() OVER (PARTITION BY query_id, {_BODY} ORDER BY rank, chunk_id) = 1 OR {_BODY} = ''")
def dedup_bodies(spark: SparkSession, d: str) -> DataFrame:
    return results.drop_duplicate_bodies(ranked_turns(spark, d)).select("query_id", "rank", "chunk_id")


@query(f"SELECT query_id, rank, chunk_id FROM ({_TURNS}) QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank, chunk_id) <= 2")
def cap_per_document(spark: SparkSession, d: str) -> DataFrame:
    return results.cap_per_document(ranked_turns(spark, d), 2).select("query_id", "rank", "chunk_id")


@query(f"""
WITH r AS ({_TURNS}), f AS (SELECT query_id, document_id, min(rank) AS first FROM r GROUP BY ALL)
SELECT r.query_id, r.chunk_id, dense_rank() OVER (PARTITION BY r.query_id ORDER BY first) AS citation,
  coalesce(ordinal <> lag(ordinal) OVER (PARTITION BY r.query_id, r.document_id ORDER BY ordinal) + 1, false) AS gap FROM r JOIN f USING (query_id, document_id)""")
def context_groups(spark: SparkSession, d: str) -> DataFrame:
    return results.context(ranked_turns(spark, d)).select("query_id", "chunk_id", "citation", "gap")


@query(f"SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document_id) AS rank FROM ({_TURNS}) GROUP BY query_id, document_id")
def doc_ranking(spark: SparkSession, d: str) -> DataFrame:
    return results.document_ranking(ranked_turns(spark, d))


@query("""
WITH l AS (SELECT l_orderkey AS document_id, l_linenumber AS ordinal, min(l_orderkey * 100 + l_linenumber) AS chunk_id, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
o AS (SELECT o_custkey % 25 AS query_id, document_id, ordinal, chunk_id, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY q DESC, chunk_id) AS rank FROM l JOIN orders ON o_orderkey = document_id),
r AS (SELECT * FROM o WHERE rank <= 12),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, document_id) AS place FROM (SELECT query_id, document_id, min(rank) AS best FROM r GROUP BY ALL) QUALIFY place <= 2),
n AS (SELECT DISTINCT query_id, document_id, place, unnest([ordinal - 1, ordinal + 1]) AS ordinal FROM r JOIN c USING (query_id, document_id)),
a AS (SELECT n.*, l.chunk_id FROM n JOIN l USING (document_id, ordinal) ANTI JOIN r USING (query_id, document_id, ordinal) QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY ordinal) <= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, ordinal, chunk_id) AS k FROM a)
SELECT query_id, rank::INT AS rank, chunk_id, document_id, ordinal, false AS neighbour FROM r
UNION ALL SELECT k.query_id, (last + k)::INT, chunk_id, document_id, ordinal, true FROM k JOIN (SELECT query_id, max(rank) AS last, count(*) AS have FROM r GROUP BY ALL) USING (query_id) WHERE have + k <= 30""")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("chunk_id"), F.max("l_quantity").alias("q")
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 25).alias("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("q"), "chunk_id")
    top = lines.join(orders, "document_id").withColumn("rank", F.row_number().over(order)).where("rank <= 12")
    return results.with_neighbours(top, lines)


@query(f"""
WITH r AS ({_TURNS}), f AS (SELECT query_id, document_id, min(rank) AS first FROM r GROUP BY ALL),
c AS (SELECT r.*, dense_rank() OVER (PARTITION BY r.query_id ORDER BY first) AS citation, coalesce(ordinal <> lag(ordinal) OVER (PARTITION BY r.query_id, r.document_id ORDER BY ordinal) + 1, false) AS gap FROM r JOIN f USING (query_id, document_id)),
b AS (SELECT query_id, citation, '<document index="' || citation || '" title="' || replace(replace(document_id || ' & "co" <x>', '&', '&amp;'), '"', '&quot;').replace('<', '&lt;') || '">' || chr(10)
  || string_agg(CASE WHEN gap THEN '[...]' || chr(10) ELSE '' END || coalesce(text, '') || ' <b> tail', chr(10) ORDER BY ordinal) || chr(10) || '</document>' AS block FROM c GROUP BY query_id, citation, document_id)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY citation) || chr(10) || chr(10) || 'Question: what? ' || query_id AS prompt FROM b GROUP BY query_id""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Passages and questions that try to close the prompt's own tags."""
    found = results.context(ranked_turns(spark, d)).withColumns({
        "title": F.concat("document_id", F.lit(' & "co" <x>')), "text": F.concat(F.lit("</document>"), F.coalesce("text", F.lit("")), F.lit(' <Context a="1"><b></ questions > tail')),
    })
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("<excerpt>what? "), F.col("query_id")))
    return results.prompt(found, asked)


@query("""
WITH w AS (SELECT doc_id AS document_id, unnest(range(0, greatest(ceil(length(text) / 8000), 1)::BIGINT)) AS k, text FROM (SELECT doc_id, concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(text), '')) AS text FROM documents))
SELECT document_id, count(*) AS windows, bool_or(contains(substr(text, k * 8000 + 1, 8000), 'qu')) AS flagged,
  array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN length(substr(text, k * 8000 + 1, 8000)) = 8000 THEN ['full', 'any'] ELSE ['any'] END)))), ',') AS categories FROM w GROUP BY document_id""")
def window_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in windows of 8000 characters, each judged by itself, and what their verdicts make of the document."""
    target = redaction.scan_target(F.col("source"), F.col("text"), F.lit(None).cast("array<string>"))
    windows = redaction.scan_windows(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), target.alias("target")))
    judged = windows.withColumns({"flagged": F.contains("text", F.lit("qu")), "categories": F.when(F.length("text") == 8000, F.array(F.lit("full"), F.lit("any"))).otherwise(F.array(F.lit("any")))})
    found = redaction.verdicts(judged).withColumn("categories", F.array_join("categories", ","))
    return found.join(windows.groupBy("document_id").agg(F.count("*").alias("windows")), "document_id")


_LAST = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


@query(f"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(coalesce(text, ''), 1000), chr(10) ORDER BY turn) AS prompt
FROM (SELECT *, {_LAST} AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return results.history(table(spark, d, "conversations"))


# ---- access -------------------------------------------------------------------------------------------------------------
# Staff are nations, clients are customers, sources are parts of orders: who is granted a customer sees the priorities they order by.


def _grants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customers = table(spark, d, "customer")
    staff = customers.select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("client_id"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("revoked_at"))
    clients = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").alias("client_id")).distinct()
    direct = table(spark, d, "supplier").select(F.col("s_nationkey").alias("user_id"), F.concat(F.lit("supplier-"), F.col("s_nationkey") % 3).alias("source_id"), F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01")).alias("revoked_at"))
    return staff, clients, direct


_GRANTS = """
SELECT c_nationkey AS user_id, o_orderpriority AS source_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0
UNION SELECT s_nationkey, 'supplier-' || (s_nationkey % 3) FROM supplier WHERE s_acctbal >= 0"""


@query(_GRANTS)
def acl_user_sources(spark: SparkSession, d: str) -> DataFrame:
    return access.user_sources(*_grants(spark, d))


@query(f"""
SELECT n_regionkey AS group_id, source_id FROM ({_GRANTS}) JOIN nation ON n_nationkey = user_id
JOIN (SELECT n_regionkey, count(*) AS members FROM nation GROUP BY 1) USING (n_regionkey) WHERE source_id <> '5-LOW' GROUP BY n_regionkey, source_id, members HAVING count(DISTINCT user_id) = members""")
def acl_shared_sources(spark: SparkSession, d: str) -> DataFrame:
    held = access.user_sources(*_grants(spark, d))
    sources = held.select("source_id").distinct().withColumn("data_class", F.when(F.col("source_id") == "5-LOW", "client_confidential").otherwise("general"))
    members = table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("user_id"))
    return access.shared_sources(held, sources, members)


@query("SELECT DISTINCT c_nationkey AS user_id, o_orderpriority AS source_id, c_custkey AS client_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def acl_client_routes(spark: SparkSession, d: str) -> DataFrame:
    staff, clients, _ = _grants(spark, d)
    return access.client_routes(staff, clients)


@query("""
SELECT query_id, coalesce(array_to_string(CASE WHEN enforced IS NULL THEN asked WHEN asked IS NULL THEN enforced ELSE list_sort(list_intersect(asked, enforced)) END, ','), 'all') AS scope,
  enforced IS NULL OR list_contains(enforced, 'src1') AS may_see FROM (
  SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[]) ELSE ['src1', 'src2'] END AS enforced,
    CASE item_id % 2 WHEN 0 THEN NULL ELSE ['src1', 'src3'] END AS asked FROM benchmark)""")
def acl_effective_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.expr("case item_id % 3 when 0 then null when 1 then cast(array() as array<string>) else array('src1', 'src2') end").alias("enforced"),
        F.expr("case item_id % 2 when 0 then null else array('src1', 'src3') end").alias("asked"),
    )
    return rows.select("query_id", F.coalesce(F.array_join(access.effective_scope(F.col("enforced"), F.col("asked")), ","), F.lit("all")).alias("scope"), access.allowed(F.col("enforced"), F.lit("src1")).alias("may_see"))


_GRANT_LOG = "SELECT user_id, event_type AS client_id, CASE WHEN value < 20 THEN ts END AS revoked_at, date_trunc('day', ts) AS granted_at, event_id AS id FROM events"


@query(f"SELECT * FROM ({_GRANT_LOG}) QUALIFY row_number() OVER (PARTITION BY user_id, client_id ORDER BY revoked_at IS NOT NULL, granted_at DESC, id) = 1")
def grant_dedup(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("client_id"), F.when(F.col("value") < 20, F.col("ts")).alias("revoked_at"), F.date_trunc("day", "ts").alias("granted_at"), F.col("event_id").alias("id")
    )
    return access.dedup_grants(log)


@query("""
WITH e AS (SELECT user_id, CASE WHEN event_type IN ('signup', 'view') THEN 'grant' ELSE 'revoke' END AS action, ts, event_id FROM events),
g AS (SELECT user_id, max(row(ts, event_id)) AS g FROM e WHERE action = 'grant' GROUP BY user_id)
SELECT user_id, g[1] AS granted_at, min(ts) FILTER (action = 'revoke' AND row(ts, event_id) > g) AS revoked_at FROM e JOIN g USING (user_id) GROUP BY user_id, g""")
def grant_fold(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", F.when(F.col("event_type").isin("signup", "view"), "grant").otherwise("revoke").alias("action"), F.col("ts").alias("at"), "event_id")
    return access.fold_grants(log, "user_id")


# ---- ingestion ----------------------------------------------------------------------------------------------------------


def ingest_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), F.concat(F.lit("d"), F.col("user_id")).alias("external_id"),
        F.expr("case event_type when 'error' then 'failed' when 'purchase' then 'ingested' when 'signup' then 'blocked' else 'seen' end").alias("action"),
        F.when(F.col("value") < 100, F.concat(F.lit("gate: "), F.floor("value").cast("string"))).alias("rejection_reason"), F.col("ts").alias("created_at"),
    )


_LOG = """SELECT event_id, 's' || (user_id % 3) AS source_id, 'd' || user_id AS external_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ingested' WHEN 'signup' THEN 'blocked' ELSE 'seen' END AS action,
  CASE WHEN value < 100 THEN 'gate: ' || floor(value)::BIGINT END AS rejection_reason FROM events"""


@query(f"""
WITH l AS ({_LOG}), r AS (SELECT source_id, external_id, max(created_at) AS resolved FROM l WHERE action IN ('ingested', 'blocked') GROUP BY ALL)
SELECT * FROM (SELECT source_id, external_id, count(*) AS failures, min(created_at) AS first_failed FROM l LEFT JOIN r USING (source_id, external_id)
WHERE action = 'failed' AND (resolved IS NULL OR created_at > resolved) GROUP BY source_id, external_id HAVING count(*) < 5) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY first_failed, external_id) <= 50""")
def retryable_failures(spark: SparkSession, d: str) -> DataFrame:
    return ingest.retryable(ingest_log(spark, d))


@query(f"""
SELECT * FROM (SELECT source_id, external_id, arg_max(rejection_reason, row(created_at, event_id)) AS latest_reason, count(*) AS attempts, max(created_at) AS last_at FROM ({_LOG})
WHERE action = 'blocked' AND rejection_reason LIKE 'gate:%' GROUP BY source_id, external_id) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY last_at DESC, external_id) <= 20""")
def gate_failure_quarantines(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gate_quarantines(ingest_log(spark, d))


@query("""
SELECT user_id AS job_id, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS indexed, count(*) FILTER (event_type = 'error') AS failed
FROM events GROUP BY user_id""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: (F.col("event_type") == t).cast("long")
    return ingest.job_counters(table(spark, d, "events").select(F.col("user_id").alias("job_id"), one("view").alias("seen"), one("purchase").alias("indexed"), one("error").alias("failed")))


_VERSIONS = """
old AS (SELECT source AS source_id, doc_id::VARCHAR AS external_id, sha256('v2' || chr(10) || text) AS content_hash, 'active' AS lifecycle_status FROM documents WHERE n_chars <= 4000),
new AS (SELECT source AS source_id, doc_id::VARCHAR AS external_id, sha256('v2' || chr(10) || CASE lang WHEN 'en' THEN text ELSE text || '.' END) AS content_hash, 'withdrawn' AS lifecycle_status FROM documents WHERE n_chars >= 1000)"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    ids = (F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"))
    old = docs.where("n_chars <= 4000").select(*ids, ingest.content_hash(F.col("text")).alias("content_hash"), F.lit("active").alias("lifecycle_status"))
    changed = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit(".")))
    return old, docs.where("n_chars >= 1000").select(*ids, ingest.content_hash(changed).alias("content_hash"), F.lit("withdrawn").alias("lifecycle_status"))


@query(f"""
WITH {_VERSIONS} SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.content_hash, o.content_hash) AS content_hash,
  coalesce(o.lifecycle_status, n.lifecycle_status) AS lifecycle_status, n.content_hash IS NOT NULL AND n.content_hash IS DISTINCT FROM o.content_hash AS content_changed
FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.external_id = n.external_id""")
def upsert_changed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upsert(*_versions(spark, d))


@query("""
SELECT l_orderkey AS document_id, l_linenumber AS ordinal, l_comment FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_comment FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'O') USING (l_orderkey))
UNION ALL SELECT o_orderkey, 0, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_returnflag").alias("l_comment"))
    new = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("document_id"), F.lit(0).cast("long").alias("ordinal"), F.col("o_orderstatus").alias("l_comment"))
    return ingest.replace_chunks(have, new)


@query("SELECT source AS source_id, doc_id::VARCHAR AS external_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def delete_by_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"))
    gone = table(spark, d, "labels").where("toxic = 1").join(table(spark, d, "documents"), "doc_id").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"))
    return ingest.delete_documents(docs, gone)


@query("SELECT page_id, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS source_id FROM pages WHERE lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) NOT LIKE 'www.%'")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("storage_key"))
    live = table(spark, d, "pages").select(T.host(F.col("url")).alias("source_id")).where("source_id like 'www.%'").distinct()
    return ingest.orphans(objects, live).select("page_id", "source_id")


@query("SELECT doc_id FROM documents ANTI JOIN embeddings ON vec_id = doc_id")
def documents_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return ingest.without_chunks(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"))).select(F.col("document_id").alias("doc_id"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return ingest.page(table(spark, d, "documents"), 100, 50, key="doc_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, ts AS created_at, 'ingested' AS status FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 25")
def claim_uploads(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "signup", "pending").otherwise("ingested").alias("status"))
    return ingest.claim_uploads(log, 25)


@query("""
WITH u AS (SELECT event_id AS id, ts AS created_at, 's' || (user_id % 3) AS source_id, row_number() OVER (ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'signup')
SELECT id, CASE WHEN n <= 10 AND n % 2 = 0 THEN 'ingested' WHEN n > 10 AND source_id = 's1' AND k - (SELECT count(*) FROM u WHERE n <= 10 AND source_id = 's1') <= 5 THEN 'claimed' ELSE 'pending' END AS status FROM u""")
def upload_claims(spark: SparkSession, d: str) -> DataFrame:
    """States of uploads after two workers' claims: the first finished every second of its ten before its lease ran out, the second holds five of one source."""
    events = table(spark, d, "events").where("event_type = 'signup'")
    staged = events.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), F.col("ts").alias("created_at"))
    leases = Claims(spark, f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}", lease=60)
    first = leases.claim(staged, 10, "a", now=0)
    order = Window.orderBy("created_at", "id")  # ten rows
    leases.finish(first.withColumn("n", F.row_number().over(order)).where("n % 2 = 0"), "a", now=30)
    leases.claim(staged.join(first.select("id"), "id", "left_anti"), 5, "b", now=50, source_id="s1")
    return leases.uploads(staged, now=70).select("id", "status")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new/' || doc_id WHEN doc_id % 4 <> 1 AND doc_id % 3 = 0 THEN source || '/' || doc_id END AS storage_key,
  CASE WHEN doc_id % 4 < 2 AND doc_id % 3 = 0 THEN source || '/' || doc_id END AS previous_storage_key FROM documents""")
def storage_updates(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth document gets a new key, the next ones lose theirs; the keys that they had are handed back."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "doc_id")).alias("storage_key"))
    stored = docs.where("document_id % 4 < 2").select("document_id", F.when(F.col("document_id") % 4 == 0, F.concat(F.lit("new/"), F.col("document_id"))).alias("storage_key"))
    return ingest.set_storage(docs, stored).select(F.col("document_id").alias("doc_id"), "storage_key", "previous_storage_key")


@query("""
SELECT source AS source_id, count(*) AS total, count(*) FILTER (n_chars > 1000) AS to_reset, count(*) FILTER (n_chars > 1000 OR doc_id % 9 = 0) AS taken_up FROM documents GROUP BY source""")
def forced_rerun(spark: SparkSession, d: str) -> DataFrame:
    """What a forced run would take up again, and what it takes up once those documents have lost their hashes: they and the really changed ones."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), "text", "n_chars", ingest.content_hash(F.col("text")).alias("content_hash"))
    report = ingest.attempts_report(docs, F.col("n_chars") > 1000)
    changed = F.when(F.col("external_id").cast("long") % 9 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    incoming = docs.select("source_id", "external_id", ingest.content_hash(changed).alias("content_hash"))
    merged = ingest.upsert(ingest.invalidate(docs, F.col("n_chars") > 1000).select("source_id", "external_id", "content_hash"), incoming)
    taken = merged.groupBy(F.col("source_id").alias("of")).agg(F.count_if("content_changed").alias("taken_up"))
    return report.join(taken, F.col("source_id").eqNullSafe(F.col("of"))).drop("of")


_CLASSES = f"""
SELECT doc_id, source_class, CASE WHEN source_class = 'D' OR card THEN 'D' WHEN toxic THEN 'C' ELSE source_class END AS doc_class FROM (
  SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'A' WHEN 'fr' THEN 'B' ELSE 'D' END AS source_class, coalesce(l.toxic, 0) = 1 AS toxic,
    regexp_matches(d.text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AS card FROM {_PLANTED_DOCS} d LEFT JOIN labels l USING (doc_id))"""


@query(f"SELECT doc_id, doc_class, doc_class IN ('C', 'D') AS quarantined FROM ({_CLASSES})")
def classify_document(spark: SparkSession, d: str) -> DataFrame:
    docs = planted(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    kind = F.expr("case lang when 'en' then 'general' when 'de' then 'sop' when 'fr' then 'research' else 'client_confidential' end")
    found = F.when(F.col("text").rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.array(F.lit("ssn"))).otherwise(F.array().cast("array<string>"))
    judged = ingest.document_class(ingest.source_class(kind), found, F.lit(False), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return docs.select("doc_id", judged.alias("j")).select("doc_id", "j.doc_class", "j.quarantined")


@query(f"""
WITH c AS (SELECT d.doc_id, d.source AS source_id, d.n_chars, c.source_class, c.doc_class FROM documents d JOIN ({_CLASSES}) c USING (doc_id))
SELECT source_id, 0::BIGINT AS skipped, count(*) FILTER (s = 'blocked') AS blocked, count(*) FILTER (s = 'quarantined') AS quarantined, count(*) FILTER (s = 'failed') AS failed,
  count(*) FILTER (s = 'unchanged') AS unchanged, count(*) FILTER (s = 'indexed') AS indexed
FROM (SELECT *, CASE WHEN source_class IN ('C', 'D') THEN 'blocked' WHEN n_chars < 100 THEN 'failed' WHEN doc_class IN ('C', 'D') THEN 'quarantined' WHEN n_chars < 1000 AND doc_id IN (SELECT vec_id FROM embeddings) THEN 'unchanged' ELSE 'indexed' END AS s FROM c)
GROUP BY source_id""")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = planted(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    docs = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded")), "doc_id", "left")
    kind = F.expr("case lang when 'en' then 'general' when 'de' then 'sop' when 'fr' then 'research' else 'client_confidential' end")
    found = F.when(F.col("text").rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.array(F.lit("ssn"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(
        F.col("source").alias("source_id"), ingest.source_class(kind).alias("source_class"), F.lit("/docs/a").alias("path"), F.when(F.col("n_chars") < 100, "too short").alias("parse_error"),
        F.lit("done").alias("redaction"), (F.col("n_chars") >= 1000).alias("content_changed"), F.coalesce("embedded", F.lit(False)).alias("embedded"),
        ingest.document_class(ingest.source_class(kind), found, F.lit(False), F.coalesce(F.col("toxic") == 1, F.lit(False)))["quarantined"].alias("quarantined"),
    )
    return ingest.run_counters(ingest.outcomes(rows))


@query("""
SELECT page_id, CASE WHEN lower(url) LIKE '%/de/%' THEN '/de/' WHEN lower(url) LIKE '%casino%' THEN 'casino' END AS reason FROM pages""")
def path_denylist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", ingest.excluded_by(F.col("url"), ("/de/", "casino")).alias("reason"))


# ---- texts --------------------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '</(p|div|tr|li|h[1-6]|table)>|<br[ \t]*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '', ''),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '\\.example\\.(com|org)$')")
def url_host_allow(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))
    return rows.where(F.col("host").endswith(".example.com") | F.col("host").endswith(".example.org"))


@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^#[ \t]+(.+)$', 1)), ''), source) AS title FROM " + _PLANTED_DOCS)
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", T.title(F.lit(None).cast("string"), F.col("text"), F.concat("source", F.lit(".md"))).alias("title"))


#: By lines: a table begins with a row between pipes that a rule follows and that no row before it belongs to.
_TABLES = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM {_PLANTED_DOCS}),
k AS (SELECT *, regexp_matches(line, '^\|.*\|[ \t]*$') AS piped, regexp_matches(line, '^\|[ \t:|-]*-[ \t:|-]*\|[ \t]*$') AS rule FROM l),
n AS (SELECT *, piped AND coalesce(lead(rule) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM k),
s AS (SELECT *, sum(CASE WHEN begins OR NOT piped THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM n)
SELECT doc_id, count(DISTINCT part) FILTER (begins) AS tables FROM s GROUP BY doc_id"""


@query(_TABLES)
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", F.size(T.markdown_tables(F.col("text"))).cast("long").alias("tables"))


@query("SELECT page_id, left(trim(replace(replace(url, '/', '_'), '\"', '')), 200) AS name FROM pages")
def download_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.download_name(F.col("url")).alias("name"))


@query(r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS p FROM documents),
s AS (SELECT doc_id, p, list_sum(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN (length(p) - i) % 2 = 1
  THEN (2 * substr(p, i, 1)::INT) // 10 + (2 * substr(p, i, 1)::INT) % 10 ELSE substr(p, i, 1)::INT END)) % 10 = 0 AS valid FROM r)
SELECT doc_id, p AS digits, valid, left(p, 1) || repeat('X', length(p) - 2) || right(p, 1) AS masked FROM s""")
def luhn_scan(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("digits"))
    return runs.select("doc_id", "digits", identifiers.luhn(F.col("digits")).alias("valid"), identifiers.mask(F.col("digits")).alias("masked"))


@query("""
SELECT o_orderkey, (3 * (d[1] + d[4] + d[7]) + 7 * (d[2] + d[5] + d[8]) + d[3] + d[6] + d[9]) % 10 = 0 AND (3 * (d[1] + d[4] + d[7]) + 7 * (d[2] + d[5] + d[8]) + d[3] + d[6] + d[9]) > 0 AS valid
FROM (SELECT o_orderkey, list_transform(range(1, 10), lambda i: substr(lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 9, '0'), i, 1)::INT) AS d FROM orders)""")
def aba_scan(spark: SparkSession, d: str) -> DataFrame:
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 9, "0")
    return table(spark, d, "orders").select("o_orderkey", identifiers.aba(digits).alias("valid"))


_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in identifiers.TAXPAYER_PATTERNS)


@query(f"SELECT doc_id, array_to_string(list_filter([{_LABELS}], lambda x: x IS NOT NULL), ',') AS labels FROM {_PLANTED_DOCS}")
def taxpayer_labels(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", F.array_join(identifiers.taxpayer_labels(F.col("text")), ",").alias("labels"))


_SWEPT = f"""SELECT doc_id, text, CASE WHEN regexp_matches(text, '{identifiers.VOCABULARY}') AND len(regexp_extract_all(text, '{identifiers.BARE}')) >= 3
  THEN regexp_replace(text, '{identifiers.BARE}', '[REDACTED-SSN]', 'g') ELSE text END AS swept FROM {_PLANTED_DOCS}"""


@query(f"SELECT doc_id, swept <> text AS changed, sha256(swept) AS swept FROM ({_SWEPT})")
def density_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d).select("doc_id", "text", identifiers.density_sweep(F.col("text"), F.col("text")).alias("swept"))
    return rows.select("doc_id", (F.col("swept") != F.col("text")).alias("changed"), F.sha2("swept", 256).alias("swept"))


@query("SELECT doc_id, sha256('v2' || chr(10) || text) AS content_hash, sha256(source || '/' || lang || '::' || text) AS chunk_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"), ingest.chunk_hash(F.array("source", "lang"), F.col("text")).alias("chunk_hash"))


def _screened(name: str, pattern: str) -> str:
    """A pattern's hits in SQL. DuckDB has no look-ahead: what the first pattern's ones leave out goes afterwards."""
    if "(?!" not in pattern:
        return f"len(regexp_extract_all(text, '{pattern}')) AS \"{name}\""
    plain = re.sub(r"\(\?![^)]*\)", "", pattern)
    left_out = "list_filter(regexp_extract_all(text, '" + plain + "'), lambda x: NOT (x[1:3] IN ('000', '666') OR x[1] = '9' OR x[5:6] = '00' OR x[8:11] = '0000'))"
    return f'len({left_out}) AS "{name}"'


_NAMES = [n for n, _ in identifiers.SCREEN_PATTERNS]
_PART = "sum(('0x' || substr(content_hash, {at}, 8))::BIGINT)::HUGEINT::VARCHAR"


@query(
    f"""WITH h AS (SELECT doc_id, sha256('v2' || chr(10) || coalesce(text, '')) AS content_hash, {", ".join(_screened(n, p) for n, p in identifiers.SCREEN_PATTERNS)} FROM {_PLANTED_DOCS})
SELECT {", ".join(f'sum("{n}")::BIGINT AS "{n}"' for n in _NAMES)}, count(*) FILTER ({" + ".join(f'"{n}"' for n in _NAMES)} > 0) AS flagged, count(*) AS documents,
  sha256(concat_ws(',', {", ".join(_PART.format(at=1 + 8 * i) for i in range(4))})) AS fingerprint FROM h"""
)
def corpus_screen(spark: SparkSession, d: str) -> DataFrame:
    counts = [c.cast("long").alias(n) for n, c in identifiers.screen_counts(F.coalesce("text", F.lit(""))).items()]
    hits = planted(spark, d).select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"), *counts)
    return evaluation.screen_inventory(hits, _NAMES)


def _may_hold(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quotes.candidates(items, table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold a quote: documents with its rarest word, then the text itself."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return _may_hold(spark, d).join(items, "item_id").where(F.contains("text", "quote")).select("item_id", "doc_id")


#: A text's steps of folding, in SQL: white space; typographic characters; marks.
_PLAIN = "replace(translate({0}, '‘’‚“”„–—−', '''''''\"\"\"---'), '…', '...')"
_FOLDED = {
    "whitespace": "trim(regexp_replace({0}, '\\s+', ' ', 'g'))",
    "unicode": f"trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))",
    "markdown": f"trim(regexp_replace(regexp_replace({_PLAIN}, '[*_`#>\\[\\]]', '', 'g'), '\\s+', ' ', 'g'))",
}


@query(f"""
WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN translate(text, '-"', '–”') WHEN 3 THEN '**' || text || '**' ELSE text END AS quote FROM benchmark),
f AS (SELECT *, {", ".join(f"{x.format('quote')} AS q_{n}" for n, x in _FOLDED.items())} FROM q),
t AS (SELECT doc_id, text, {", ".join(f"{x.format('text')} AS t_{n}" for n, x in _FOLDED.items())} FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(text, quote) THEN 'exact' WHEN contains(t_whitespace, q_whitespace) THEN 'whitespace' WHEN contains(t_unicode, q_unicode) THEN 'unicode' ELSE 'markdown' END AS rung, q_markdown AS words
FROM f JOIN t ON contains(t_markdown, q_markdown)""")
def quote_ladder(spark: SparkSession, d: str) -> DataFrame:
    """How quotes are found that are as they were, with doubled spaces, with typographic dashes and quotes, or marked bold; and the words that their spans lead to."""
    quote = F.expr("case item_id % 4 when 1 then replace(text, ' ', '  ') when 2 then translate(text, '-\"', '–”') when 3 then concat('**', text, '**') else text end")
    items = table(spark, d, "benchmark").select("item_id", quote.alias("quote"))
    found = _may_hold(spark, d).join(items, "item_id").select("item_id", "doc_id", "text", claims.located(F.col("quote"), F.col("text")).alias("at")).where("at.rung <> 'none'")
    words = F.regexp_replace(F.expr("substring(text, at.start + 1, at.end - at.start)"), r"[*_`#>\[\]]", "")
    plain = F.replace(F.translate(words, "‘’‚“”„–—−", "'''\"\"\"---"), F.lit("…"), F.lit("..."))
    return found.select("item_id", "doc_id", "at.rung", F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("words"))


@query()
def english_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stems in order."""
    return table(spark, d, "documents").select("doc_id", F.array_join(english.english_tokens(F.col("text")), " ").alias("stems"))


# ---- logs ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, event_type AS endpoint, value::FLOAT AS top_score, ts AS created_at FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def audit_since_watermark(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"), F.col("value").cast("float").alias("top_score"), F.col("ts").alias("created_at"), F.col("props").alias("question_text"))
    return audit.shippable_since(log, F.lit("2024-01-15").cast("timestamp"))


@query("""
SELECT source_ids[1] AS first_source, sum(n)::BIGINT AS n, string_agg(endpoint || '=' || n, ',' ORDER BY endpoint) AS by_endpoint FROM (
  SELECT list_sort(['s' || (user_id % 5), 's' || (user_id % 7)]) AS source_ids, event_type AS endpoint, count(*) AS n FROM events
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND value < 20 GROUP BY ALL) GROUP BY source_ids""")
def weak_result_digest(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(
        F.array(F.concat(F.lit("s"), F.col("user_id") % 5), F.concat(F.lit("s"), F.col("user_id") % 7)).alias("source_ids"), F.col("event_type").alias("endpoint"),
        F.lit(1).alias("retrieved_count"), F.col("value").alias("top_score"), F.col("ts").alias("created_at"),
    )
    weak = audit.weak_results(log, F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"), 20)
    by = F.array_join(F.transform(F.map_entries("by_endpoint"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return audit.weak_digest(weak).select(F.get("source_ids", F.lit(0)).alias("first_source"), "n", by.alias("by_endpoint"))


_FEEDBACK = "SELECT event_id, user_id AS answer_id, CASE WHEN value < 5 THEN NULL ELSE event_type END AS principal_subject, CASE WHEN value > 50 THEN 'helpful' ELSE 'not_helpful' END AS rating, ts AS created_at FROM events"


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("answer_id"), F.when(F.col("value") >= 5, F.col("event_type")).alias("principal_subject"), F.when(F.col("value") > 50, "helpful").otherwise("not_helpful").alias("rating"), F.col("ts").alias("created_at")
    )


@query(f"SELECT * FROM ({_FEEDBACK}) QUALIFY row_number() OVER (PARTITION BY answer_id, principal_subject ORDER BY created_at DESC, event_id DESC) = 1")
def feedback_upsert(spark: SparkSession, d: str) -> DataFrame:
    return audit.fold_feedback(feedback(spark, d))


@query(f"SELECT count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful FROM ({_FEEDBACK})")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    return audit.feedback_stats(feedback(spark, d))


@query(f"SELECT * FROM ({_FEEDBACK}) WHERE rating = 'not_helpful' ORDER BY created_at DESC, event_id DESC LIMIT 20")
def feedback_negatives(spark: SparkSession, d: str) -> DataFrame:
    return audit.recent_negatives(feedback(spark, d))


@query("""
SELECT o_orderkey AS document_id, c_name AS source_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS chunks, '' AS url, o_totalprice > 100000 AS flagged
FROM orders JOIN customer ON c_custkey = o_custkey""")
def audit_worksheet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("source_id"), F.lit("{}").alias("metadata"), "o_totalprice")
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"))
    return audit.worksheet(docs, sources, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id")), F.col("o_totalprice") > 100000)


@query("SELECT query_id, sha256(text) AS question_hash, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids, count(*)::INT AS retrieved_count, max(dense_score)::FLOAT AS top_score FROM (" + _hybrid_sql() + ") JOIN benchmark ON item_id = query_id GROUP BY query_id, text")
def audit_projection(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    rows = audit.audit_rows(retrieval.hybrid(asked, chunks(spark, d), analyse=T.tokens), asked.select("query_id", F.col("text").alias("question")), "search")
    return rows.select("query_id", "question_hash", F.array_join("chunk_ids", ",").alias("chunk_ids"), "retrieved_count", "top_score")


# ---- measures -----------------------------------------------------------------------------------------------------------

_METRICS = "SELECT " + ", ".join(
    f"round(avg(h{k}::DOUBLE / n), 6) AS recall_{k}, round(avg(h{k}::DOUBLE / {k}), 6) AS precision_{k}, round(avg(g{k} / i{k}), 6) AS ndcg_{k}" for k in (1, 3, 5, 10)
) + ", round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT r.query_id, r.n, f.first, " + ", ".join(
    f"coalesce(f.h{k}, 0) AS h{k}, coalesce(f.g{k}, 0) AS g{k}, list_sum(list_transform(range(1, least(r.n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS i{k}" for k in (1, 3, 5, 10)
) + " FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id) r LEFT JOIN (SELECT query_id, min(rank) AS first, " + ", ".join(
    f"count(*) FILTER (rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS g{k}" for k in (1, 3, 5, 10)
) + " FROM rank JOIN rel USING (query_id, document_id) GROUP BY query_id) f USING (query_id))"


@query(
    "WITH rank AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, document_id) AS rank FROM ("
    "SELECT o_custkey AS query_id, l_partkey AS document_id, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)), "
    "rel AS (SELECT DISTINCT o_custkey AS query_id, l_partkey AS document_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') " + _METRICS
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("document_id"), "l_quantity", "l_returnflag")
    totals = lines.groupBy("query_id", "document_id").agg(F.sum("l_quantity").alias("q"))
    ranking = totals.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("q"), "document_id")))
    return evaluation.retrieval_metrics(ranking, lines.where("l_returnflag = 'R'").select("query_id", "document_id"))


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """query_id, document_id: documents that a benchmark item stands in."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    held = _may_hold(spark, d).join(items, "item_id").where(F.contains("text", "quote"))
    return held.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"))


_REL = "SELECT item_id AS query_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(f"WITH rank AS (SELECT query_id, document_id, rank FROM ({_hybrid_sql()})), rel AS ({_REL}) " + _METRICS)
def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the fused search itself: of each benchmark item, the documents that it stands in."""
    found = results.document_ranking(retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens))
    return evaluation.retrieval_metrics(found, _relevant(spark, d))


@query(f"""
WITH h AS ({_hybrid_sql()}), r AS (SELECT query_id, list(DISTINCT document_id) AS relevant FROM ({_REL}) GROUP BY query_id),
o AS (SELECT query_id, list(document_id) FILTER (rank <= 3) AS retrieved, list(document_id) FILTER (rank BETWEEN 3 AND 4) AS cited, max(dense_score) < 0.3 AS refused FROM h WHERE query_id % 5 <> 0 GROUP BY query_id),
j AS (SELECT b.item_id, r.relevant IS NOT NULL AS answerable, r.relevant, o.retrieved, o.cited, o.refused, o.query_id IS NOT NULL AS seen FROM benchmark b LEFT JOIN r ON r.query_id = item_id LEFT JOIN o ON o.query_id = item_id)
SELECT round(avg(CASE WHEN seen AND answerable THEN len(list_intersect(relevant, retrieved))::DOUBLE / len(relevant) END), 6) AS recall, round(avg(CASE WHEN seen THEN (refused = NOT answerable)::INT END), 6) AS refusal_accuracy,
  count(*) FILTER (len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) > 0) AS fabricated, count(*) FILTER (seen AND item_id % 7 = 0) AS truncated, count(*) FILTER (NOT seen) AS missing FROM j""")
def gold_report(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of the search's hits: three are retrieved, the third and fourth cited, weak ones refused; every fifth question has no answer."""
    found = retrieval.hybrid(questions(spark, d), chunks(spark, d), analyse=T.tokens).where("query_id % 5 <> 0")
    ids = lambda test: F.collect_list(F.when(test, F.col("document_id")))
    observed = found.groupBy(F.col("query_id").alias("id")).agg(
        F.lit("x").alias("answer"), ids(F.col("rank") <= 3).alias("retrieved"), ids(F.col("rank").between(3, 4)).alias("cited"), (F.max("dense_score") < 0.3).alias("refused"), F.first(F.col("query_id") % 7 == 0).alias("truncated")
    )
    relevant = _relevant(spark, d).groupBy(F.col("query_id").alias("id")).agg(F.collect_set("document_id").alias("relevant"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id")).join(relevant, "id", "left").withColumn("answerable", F.col("relevant").isNotNull())
    return evaluation.gold_report(asked, observed)


@query("""
SELECT user_id AS id, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 6) AS faithfulness FROM events GROUP BY user_id""")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.expr("case event_type when 'purchase' then 'supported' when 'error' then 'unsupported' else 'unclear' end")
    return evaluation.faithfulness(table(spark, d, "events").select(F.col("user_id").alias("id"), verdict.alias("verdict")))


# ---- answers, sheets, chunks ----------------------------------------------------------------------------------------------

#: Turns as answers: a list, a range and something in brackets, made of the turn's own numbers, behind its text; each fifth says that nothing was found.
_ANSWER = f"""CASE WHEN (conv_id + turn) % 5 = 0 THEN '{answers.EMPTY_ANSWER}'
  ELSE concat(coalesce(text, ''), ' [', turn, ', ', conv_id % 120, '] and [', conv_id % 7, '-', conv_id % 90, '] or [', role, ']') END"""
_CITED = f"""
WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations),
p AS (SELECT conv_id, turn, unnest(string_split(g, ',')) AS p FROM (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\\[([0-9 ,\\t\\n–—-]+)\\]', 1)) AS g FROM a)),
r AS (SELECT *, TRY_CAST(regexp_extract(p, '^\\s*([0-9]+)', 1) AS BIGINT) AS first, TRY_CAST(regexp_extract(p, '([0-9]+)\\s*$', 1) AS BIGINT) AS last FROM p WHERE regexp_matches(p, '^\\s*[0-9]+\\s*([–—-]\\s*[0-9]+\\s*)?$')),
c AS (SELECT DISTINCT conv_id, turn, unnest(range(first, last + 1)) AS id FROM r WHERE last - first BETWEEN 0 AND 50)"""


@query(_CITED + """
SELECT conv_id, turn, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS cited FROM a LEFT JOIN c USING (conv_id, turn) GROUP BY conv_id, turn""")
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("answer"))
    return rows.select("conv_id", "turn", F.array_join(answers.cited(F.col("answer")), ",").alias("cited"))


@query(_CITED + f"""
SELECT conv_id, turn, concat_ws(',', CASE WHEN count(*) FILTER (id NOT IN (1, 2) AND id <= 99) > 0 THEN 'invalid_citation' END,
  CASE WHEN count(*) FILTER (id IN (1, 2)) = 0 AND any_value(answer) <> '{answers.EMPTY_ANSWER}' THEN 'uncited_answer' END) AS warnings FROM a LEFT JOIN c USING (conv_id, turn) GROUP BY conv_id, turn""")
def citation_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Sources 1 and 2 exist."""
    valid = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("answer"))
    return rows.select("conv_id", "turn", F.array_join(answers.warnings(F.col("answer"), valid), ",").alias("warnings"))


#: Turns as answers that refuse, nearly refuse, or don't.
_REFUSING = f"""CASE (conv_id + turn) % 6 WHEN 0 THEN ' {answers.EMPTY_ANSWER} '
  WHEN 1 THEN concat('{answers.EMPTY_ANSWER[:-1]}', chr(10), chr(10), 'closest related material: v1.', turn, ' of ', role, ' [', conv_id, '].')
  WHEN 2 THEN concat('{answers.EMPTY_ANSWER}', chr(10), coalesce(text, ''))
  WHEN 3 THEN concat('These ', role, ' notes do not bear on the question at all.', CASE WHEN turn % 2 = 0 THEN concat(chr(10), 'Closest related material: one. Two [1].') ELSE '' END)
  WHEN 4 THEN concat('Yes. They do not bear on the question.', role) ELSE coalesce(text, '') END"""


@query(f"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split({_REFUSING}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
SELECT conv_id, turn, coalesce((l[1] IN ('{answers.EMPTY_ANSWER}', '{answers.EMPTY_ANSWER[:-1]}') OR regexp_matches(l[1], '(?i)^[^.!?]*\\bdo not bear on the question( at all)?\\.?$'))
  AND (len(l) = 1 OR len(l) = 2 AND regexp_matches(l[2], '(?i)^closest related material:([^\\[\\].!?]|[.!?]+[^\\s\\[\\].!?])*\\[\\d+\\]\\s*\\.?$')), false) AS refused FROM l""")
def refusal_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_REFUSING.replace("chr(10)", "char(10)")).alias("answer"))
    return rows.select("conv_id", "turn", answers.is_refusal(F.col("answer")).alias("refused"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a sheet of its lines."""
    line = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("rows")).select(
        "l_orderkey", F.array(F.lit("part"), F.lit("quantity")).alias("headers"), "rows"
    )


@query("""
SELECT l_orderkey, CASE WHEN (l_orderkey % 5)::DOUBLE / (2 * count(*)) >= 0.2 THEN 'financial_model' WHEN l_orderkey % 7 = 0 THEN 'narrative' WHEN count(*) >= 5 THEN 'tabular' ELSE 'freeform' END AS sheet_type
FROM lineitem GROUP BY l_orderkey""")
def sheet_classify(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with up to four formulas, every seventh with a long cell."""
    long = F.when(F.col("l_orderkey") % 7 == 0, F.transform("rows", lambda r: F.array(F.rpad(r[0], 201, "x"), r[1]))).otherwise(F.col("rows"))
    return sheets(spark, d).select("l_orderkey", sheet_type(F.col("headers"), long, F.col("l_orderkey") % 5).alias("sheet_type"))


@query()
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    docs = planted(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("markdown"))
    return chunking.chunk_documents(docs)


@query()
def chunk_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within a budget of BPE tokens."""
    import public_tokenizers

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("markdown"))
    measure = chunking.Bpe.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chunking.chunk_documents(docs, measure=measure)


@query()
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    sheet = F.struct(F.lit("lines").alias("sheet_name"), sheet_type(F.col("headers"), F.col("rows"), F.lit(0)).alias("sheet_type"), "headers", "rows", T.markdown_table(F.col("headers"), F.col("rows")).alias("markdown"))
    docs = sheets(spark, d).select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("Order "), F.col("l_orderkey")).alias("title"), F.lit("").alias("markdown"), F.array(sheet).alias("tables"))
    return chunking.chunk_documents(docs, chunking.Budget(size=60, row_overlap=1))


@query()
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    docs = planted(spark, d).select("doc_id", F.col("source").alias("title"), F.col("text").alias("markdown"))
    return redaction.redact_documents(docs).drop("redaction_pack")


def _numbered_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a document with a sheet: every third names a number beside what it is, every fifth shows its sheet in its text too."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))).alias("lines"))
    more = F.array(F.array(F.lit("SSN of the client"), F.concat(F.lit("123-45-"), (1000 + F.col("l_orderkey") % 9000).cast("string"))), F.array(F.lit("EIN"), F.lit("12-3456789")))
    rows = F.when(F.col("l_orderkey") % 3 == 0, F.concat("lines", more)).otherwise(F.col("lines"))
    headers = F.array(F.lit("line"), F.lit("part"))
    sheet = F.struct(F.concat(F.lit("Order "), F.col("l_orderkey")).alias("sheet_name"), headers.alias("headers"), F.col("rows"), T.markdown_table(headers, F.col("rows")).alias("markdown"), F.lit("kept").alias("note"))
    shown = F.when(F.col("l_orderkey") % 5 == 0, F.array_join(F.transform("rows", lambda r: F.array_join(r, ": ")), chr(10))).otherwise("")
    return lines.select("l_orderkey", rows.alias("rows")).select(
        F.col("l_orderkey").alias("document_id"), F.concat(F.lit("Order of 12-345"), (1000 + F.col("l_orderkey") % 9000).cast("string")).alias("title"), shown.alias("markdown"), F.array(sheet).alias("tables"),
    )


@query("""
WITH l AS (SELECT l_orderkey AS id, count(*) AS n, string_agg(l_linenumber || '|' || l_partkey, chr(10) ORDER BY l_linenumber::VARCHAR, l_partkey::VARCHAR) AS cells FROM lineitem GROUP BY 1)
SELECT id AS document_id, 'Order of [REDACTED-EIN]' AS title, CASE WHEN id % 3 = 0 THEN 'ein=2,ssn=1' ELSE 'ein=1' END AS redaction,
  cells || CASE WHEN id % 3 = 0 THEN chr(10) || 'SSN of the client|[REDACTED-SSN]' || chr(10) || 'EIN|[REDACTED-EIN]' ELSE '' END AS cells,
  CASE WHEN id % 5 > 0 THEN '' ELSE replace(cells, '|', ': ') || CASE WHEN id % 3 = 0 THEN chr(10) || 'SSN of the client: [REDACTED-SSN]' || chr(10) || 'EIN: [REDACTED-EIN]' ELSE '' END END AS markdown,
  id % 3 = 0 AS masked FROM l""")
def redact_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nested sheets masked as a whole: a sheet that its text shows too counts once, and its Markdown is masked alike."""
    found = redaction.redact_documents(_numbered_sheets(spark, d), tables="tables")
    sheet = F.col("tables")[0]
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("redaction"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    cells = F.array_join(F.transform(sheet["rows"], lambda r: F.array_join(r, "|")), chr(10))
    masked = F.contains(sheet["markdown"], F.lit("[REDACTED-SSN]")) & (sheet["note"] == "kept")
    return found.select("document_id", "title", counts.alias("redaction"), cells.alias("cells"), "markdown", masked.alias("masked"))


@query(f"""
SELECT doc_id FROM {_PLANTED_DOCS} WHERE doc_id % 4 <> 3 AND NOT regexp_matches(text, '\\b[0-9]{{3}}[-\\s][0-9]{{2}}[-\\s][0-9]{{4}}\\b|\\b[0-9]{{2}}[-\\s][0-9]{{7}}\\b') AND doc_id % 12 NOT IN (4, 6, 10)
  AND NOT regexp_matches(text, '\\b([0-9][ -]?){{12,18}}[0-9]\\b')""")
def downloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose originals may be handed out: stored, and nothing in them was masked. Texts with a long run of digits are left aside."""
    docs = planted(spark, d).where(~F.col("text").rlike(r"\b(\d[ -]?){12,18}\d\b")).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("markdown"), F.when(F.col("doc_id") % 4 != 3, F.concat(F.lit("k/"), F.col("doc_id"))).alias("storage_key"))
    return redaction.downloadable(redaction.redact_documents(docs)).select("doc_id")


@query(f"""
SELECT doc_id, array_to_string(labels, ',') AS labels FROM (SELECT doc_id, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS labels FROM {_PLANTED_DOCS})
WHERE NOT list_has_any(labels, [{", ".join(f"'{x}'" for x in identifiers.IDENTIFYING)}])""")
def generation_screen(spark: SparkSession, d: str) -> DataFrame:
    """Documents as passages: those that hold an identifier are dropped, the rest keep their labels."""
    kept = redaction.generation_screen(planted(spark, d).select("doc_id", "text"))
    return kept.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("""
SELECT count(*) AS measured, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS invalid_citation_rate, round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 6) AS refusal_rate,
  round(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*), 6) AS self_retrieval_rate FROM events WHERE value > 50""")
def grounding_scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.when(F.col("value") > 50, "ok").otherwise("error").alias("status"), F.when(F.col("event_type") == "error", F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).alias("invalid"),
        (F.col("event_type") == "view").alias("refused"), (F.col("event_type") == "purchase").alias("self_retrieved"),
    )
    return evaluation.grounding_scorecard(rows)


@query("""
SELECT 'source' AS kind, source AS id FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src0')
UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents WHERE source IS DISTINCT FROM 'src0'
UNION ALL SELECT 'chunk', item_id::VARCHAR FROM benchmark ANTI JOIN (SELECT doc_id AS item_id FROM documents WHERE source = 'src0') USING (item_id)
UNION ALL SELECT 'key', source || '/' || doc_id FROM documents WHERE source = 'src0'""")
def purge_source(spark: SparkSession, d: str) -> DataFrame:
    """What is left of sources, documents and chunks (the benchmark's items), and the keys of the originals to delete."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.concat_ws("/", "source", "doc_id").alias("storage_key"))
    parts = ingest.purge_source("src0", docs.select("source_id").distinct(), docs, table(spark, d, "benchmark").select(F.col("item_id").alias("document_id")))
    named = [p.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for p, kind, c in zip(parts, ("source", "document", "chunk", "key"), ("source_id", "document_id", "document_id", "storage_key"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 2 = 0 THEN 'createdAt=' || n_chars END, CASE WHEN lang <> 'es' THEN 'docClass=' || doc_class END, 'mimeType=text', CASE WHEN source IS NOT NULL THEN 'title=' || source END,
  CASE WHEN lang <> 'es' AND doc_class = 'A' THEN 'url=u' || doc_id END) AS fields
FROM (SELECT *, CASE WHEN lang IN ('en', 'de') AND n_chars >= 1000 THEN 'B' WHEN lang = 'fr' THEN 'C' ELSE 'A' END AS doc_class FROM documents)""")
def exposed_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Each document's metadata as it leaves: listed fields that have a value, the address for class A only."""
    kind = F.when(F.col("lang").isin("en", "de") & (F.col("n_chars") >= 1000), "B").when(F.col("lang") == "fr", "C").otherwise("A")
    m = {
        "path": F.col("lang"), "secret": F.lit("x"), "title": F.col("source"), "mimeType": F.lit("text"), "url": F.concat(F.lit("u"), F.col("doc_id")),
        "createdAt": F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")), "docClass": F.when(F.col("lang") != "es", kind),
    }
    left = results.exposed_metadata(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]))
    fields = F.array_sort(F.transform(F.map_entries(left), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, d, "documents").select("doc_id", F.array_join(fields, ",").alias("fields"))
