"""Logs of questions and answers: projections, digests, feedback, worksheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Columns of the audit log that may be shipped: neither question nor answer.
SHIPPABLE = (
    "id", "principal_kind", "principal_sources", "principal_subject", "question_hash", "channel", "model", "embedding_provider", "embedding_model", "source_ids",
    "chunk_ids", "doc_ids", "retrieved_count", "endpoint", "top_score", "answer_id", "created_at",
)


def kept_text(text: Column, policy: str) -> Column:
    """Texts are kept under the policy "full" only."""
    return F.when(F.lit(policy == "full"), text)


def audit_rows(results: DataFrame, questions: DataFrame, endpoint: str, policy: str = "hash") -> DataFrame:
    """One log row per question (query_id, question): its hash, what was found, the best score."""
    order = F.struct("rank", "chunk_id", "document_id", "source_id")
    found = results.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("hits"), F.max("dense_score").cast("float").alias("top_score"))
    ids = lambda c: F.coalesce(F.array_distinct(F.col(f"hits.{c}")), F.array())
    return questions.join(found, "query_id", "left").select(
        "query_id", F.sha2("question", 256).alias("question_hash"), ids("source_id").alias("source_ids"), ids("document_id").alias("doc_ids"), ids("chunk_id").alias("chunk_ids"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("retrieved_count"), "top_score", F.lit(endpoint).alias("endpoint"), kept_text(F.col("question"), policy).alias("question_text"),
    )


def shippable_since(log: DataFrame, after: Column | None, until: Column | None = None) -> DataFrame:
    """Rows newer than a watermark, oldest first, without texts."""
    out = log if after is None else log.where(F.col("created_at") > after)
    out = out if until is None else out.where(F.col("created_at") <= until)
    return out.select(*[c for c in SHIPPABLE if c in log.columns]).orderBy("created_at", "id")


def weak_results(log: DataFrame, since: Column, until: Column, below: float) -> DataFrame:
    """Questions in a window of time that found nothing good: no row, or a best score under ``below``."""
    return log.where((F.col("created_at") >= since) & (F.col("created_at") < until) & ((F.col("retrieved_count") == 0) | F.col("top_score").isNull() | (F.col("top_score") < below)))


def weak_digest(weak: DataFrame) -> DataFrame:
    """source_ids (sorted), n, by_endpoint (map): weak questions by what they were allowed to search."""
    counted = weak.groupBy(F.array_sort(F.coalesce("source_ids", F.array().cast("array<string>"))).alias("source_ids"), "endpoint").count()
    return counted.groupBy("source_ids").agg(
        F.sum("count").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", "count")))).alias("by_endpoint")
    )


def fold_feedback(feedback: DataFrame) -> DataFrame:
    """The last rating per answer and subject; null subjects are one subject."""
    order = Window.partitionBy("answer_id", "principal_subject").orderBy(F.desc("created_at"), F.desc("event_id"))
    return feedback.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.col("rating") == "helpful").alias("helpful"), F.count_if(F.col("rating") == "not_helpful").alias("not_helpful"))


def recent_negatives(feedback: DataFrame, n: int = 20) -> DataFrame:
    return feedback.where("rating = 'not_helpful'").orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def worksheet(documents: DataFrame, sources: DataFrame, chunks: DataFrame, flagged: Column) -> DataFrame:
    """A row per document: its source, its number of chunks (0 if none), its address, whether a pattern flags it."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    joined = documents.join(sources, "source_id").join(n, "document_id", "left")
    return joined.select("document_id", "source_name", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.get_json_object("metadata", "$.url"), F.lit("")).alias("url"), flagged.alias("flagged"))
