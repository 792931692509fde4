"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ball_tree, bpe, chat, dac, exact_dedup, langid, line_dedup, ngram_join, packing, passage_dedup, quality, syncmers, vector_codes, warc
from .common import documents

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Loss-bearing tokens of a sequence, at most: a document's first line, if it has others, is context and bears none.
LOSS = 4032


def packed(docs: DataFrame) -> DataFrame:
    """Documents in sequences, under all three limits."""
    docs = docs.select("doc_id", "text", packing.first_line(F.col("text")).alias("context"))
    return packing.pack(docs, tokenizer(WORDS), loss=LOSS, context="context")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, sf_dir))


#: Conversation -1: its texts look like the template's own marks.
_TRICKY = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.read_chats(chat.format_chats(turns.unionByName(spark.sql(_TRICKY)))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).drop("stays")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    return left.select("doc_id", "removed_lines", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passage_dedup.dedup_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(spark, dac.write(documents(spark, sf_dir), tokenizer(WORDS)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_and_decode(docs, tokenizer(BYTES), keep_ids=False)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.read(spark, warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_syncmers": op3_syncmers,
        "op4_language": op4_language,
        "op5_chat": op5_chat,
        "op6_packing": op6_packing,
        "op7_ngram_join": op7_ngram_join,
        "op8_line_dedup": op8_line_dedup,
        "op8_passages": op8_passages,
        "op9_token_files": op9_token_files,
        "op10_bpe": op10_bpe,
        "op11_warc": op11_warc,
        "op12_vector_codes": op12_vector_codes,
        "op13_ball_tree": op13_ball_tree,
    }


#: Null text is empty; the row with the most code points stays, then the smallest doc_id.
_OP2 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""

#: Turn marks add 3 characters for <s>, 3 for a <t> between merged turns, the rest per stretch of one role; escaping adds one
#: per control string.
_OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, lag(role) OVER w AS before,
    length(regexp_replace(text, '[<\[]\\*(?:/?s>|t>|/?INST\]|OUT\]|/?ROLE\]|END\])', '\0.', 'g')) AS body
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body + CASE WHEN before = role THEN 3 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 18 + length(role) END))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


#: Windows hold the lines themselves; a run of 50 words that stands earlier too is deleted.
_OP8 = r"""
WITH l AS (
  SELECT doc_id, pos, line, trim(line, e' \t\n\x0b\x0c\r') AS t FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), w AS (
  SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE t <> ''
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS since FROM w
), r AS (
  SELECT doc_id, list(t) OVER f AS run, min(pos) OVER f AS a, max(pos) OVER f AS b, sum(words) OVER f AS total FROM c
  WINDOW f AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, list(t) OVER g, min(pos) OVER g, max(pos) OVER g, sum(words) OVER g FROM c
  WINDOW g AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), k AS (
  SELECT doc_id, a, b, min((doc_id, a)) OVER (PARTITION BY run) AS earliest FROM r WHERE total >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM k WHERE earliest < (doc_id, a)
)
SELECT d.doc_id, coalesce(n, 0) AS removed_lines, coalesce(words, 0)::BIGINT AS removed_words, length(kept) AS kept_chars, sha256(kept) AS kept_sha256
FROM (
  SELECT l.doc_id, count(gone.pos) FILTER (l.t <> '') AS n, sum(w.words) FILTER (gone.pos IS NOT NULL) AS words,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL OR l.t = ''), '') AS kept
  FROM l LEFT JOIN gone USING (doc_id, pos) LEFT JOIN w USING (doc_id, pos) GROUP BY l.doc_id
) d
"""


#: Payloads are compared as they are.
_OP11 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _lloyd(rounds: int) -> str:
    """Rounds over x (r, part, pos, x) from b0 (part, entry, pos, c): a{k} assigns, b{k + 1} moves. Every distance is computed."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT r, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY r, part
)""")
        if k < rounds:
            out.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c FROM b{k}
  LEFT JOIN (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM a{k} JOIN x USING (r, part) GROUP BY ALL) USING (part, entry, pos)
)""")
    return ", ".join(out)


_OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS q FROM embeddings WHERE {_SOUND}
), x AS MATERIALIZED (
  SELECT r, i // w AS part, i % w AS pos, x FROM (SELECT r, len(q) // 8 AS w, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 16), {_lloyd(6)}
, e AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b6) AS codebooks_sha256
FROM e JOIN kept USING (r)
"""

_OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}
), x AS MATERIALIZED (SELECT r, 0 AS part, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM kept),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 40), {_lloyd(5)}
SELECT vec_id, entry::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY entry))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN kept USING (r) JOIN (SELECT entry, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM b5 GROUP BY entry) USING (entry)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_warc": _OP11, "op12_vector_codes": _OP12, "op13_ball_tree": _OP13, "op2_exact_dedup": _OP2, "op5_chat": _OP5, "op8_line_dedup": _OP8}
