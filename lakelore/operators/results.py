"""What is done with ranked results before an answer: duplicates, caps, neighbours, context, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def drop_duplicate_bodies(results: DataFrame, text: str = "text") -> DataFrame:
    """Of results of a query with the same text but for white space, the best ranked stays; empty texts all stay."""
    body = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    order = Window.partitionBy("query_id", "__body").orderBy("rank", "chunk_id")
    rows = results.withColumn("__body", body).withColumn("__n", F.row_number().over(order))
    return rows.where("__n = 1 or __body = ''").drop("__body", "__n")


def cap_per_document(results: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` results of a document per query, the best ranked."""
    order = Window.partitionBy("query_id", "document_id").orderBy("rank", "chunk_id")
    return results.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def with_neighbours(results: DataFrame, chunks: DataFrame, documents: int = 2, each: int = 4, total: int = 30) -> DataFrame:
    """Results, then the chunks before and behind those of the first documents: score 0, ranked last.

    ``results``: query_id, rank, chunk_id, document_id, ordinal. Of a document its first ``each`` neighbours by ordinal are
    added, and ``total`` rows per query is the limit. Chunks that are results already don't come again.
    """
    first = results.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "document_id")
    chosen = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= documents)
    near = results.join(chosen.select("query_id", "document_id", "place"), ["query_id", "document_id"])
    near = near.select("query_id", "document_id", "place", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal")).distinct()
    near = near.join(results.select("query_id", "document_id", "ordinal"), ["query_id", "document_id", "ordinal"], "left_anti")
    found = near.join(chunks.select("document_id", "ordinal", "chunk_id"), ["document_id", "ordinal"])
    by_document = Window.partitionBy("query_id", "document_id").orderBy("ordinal")
    found = found.withColumn("__n", F.row_number().over(by_document)).where(F.col("__n") <= each)
    have = results.groupBy("query_id").agg(F.max("rank").alias("__last"), F.count("*").alias("__have"))
    behind = Window.partitionBy("query_id").orderBy("place", "ordinal", "chunk_id")
    found = found.join(have, "query_id").withColumn("__k", F.row_number().over(behind)).where(F.col("__have") + F.col("__k") <= total)
    added = found.select("query_id", (F.col("__last") + F.col("__k")).cast("int").alias("rank"), "chunk_id", "document_id", "ordinal", F.lit(True).alias("neighbour"))
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "document_id", "ordinal", F.lit(False).alias("neighbour")).unionByName(added)


def context(results: DataFrame) -> DataFrame:
    """Results with citation (documents numbered by first appearance) and gap (a chunk doesn't follow the one before it)."""
    first = F.min("rank").over(Window.partitionBy("query_id", "document_id"))
    rows = results.withColumn("__first", first)
    cited = F.dense_rank().over(Window.partitionBy("query_id").orderBy("__first"))
    before = F.lag("ordinal").over(Window.partitionBy("query_id", "document_id").orderBy("ordinal"))
    return rows.withColumn("citation", cited).withColumn("gap", F.coalesce(F.col("ordinal") != before + 1, F.lit(False))).drop("__first")


def document_ranking(results: DataFrame) -> DataFrame:
    """query_id, document_id, rank: documents in the order of their first chunk."""
    first = results.groupBy("query_id", "document_id").agg(F.min("rank").alias("__first"))
    return first.select("query_id", "document_id", F.row_number().over(Window.partitionBy("query_id").orderBy("__first", "document_id")).alias("rank"))


#: Metadata fields that may leave the engine; the address only for class A.
EXPOSED = ("title", "url", "mimeType", "sizeBytes", "createdAt", "modifiedAt", "docClass")


def exposed_metadata(metadata: Column) -> Column:
    """A map of metadata cut to what may leave; without a class the address stays in."""
    is_a = F.coalesce(F.element_at(metadata, F.lit("docClass")) == "A", F.lit(False))
    return F.map_filter(metadata, lambda k, v: k.isin(*EXPOSED) & v.isNotNull() & ((k != "url") | is_a))


def citations(results: DataFrame) -> DataFrame:
    """One row per query and document: citation, title, url (class A only), date (of ten characters that are one)."""
    day = F.left("modified_at", F.lit(10))
    return results.groupBy("query_id", "citation", "document_id").agg(
        F.min("title").alias("title"), F.min(F.when(F.col("doc_class") == "A", F.col("url"))).alias("url"), F.min(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)).alias("date")
    )


def prompt(results: DataFrame, question: DataFrame) -> DataFrame:
    """query_id, prompt: passages by citation and ordinal under their titles, tags made harmless, then the question."""
    from ..functions.answers import neutral

    attribute = F.replace(F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    passage = F.concat(F.when(F.col("gap"), "[...]\n").otherwise(""), neutral(F.col("text")))
    documents = results.groupBy("query_id", "citation").agg(
        F.min(attribute).alias("name"), F.array_sort(F.collect_list(F.struct("ordinal", passage.alias("body")))).alias("parts")
    )
    block = F.concat(F.lit('<document index="'), F.col("citation"), F.lit('" title="'), F.col("name"), F.lit('">\n'), F.array_join("parts.body", "\n"), F.lit("\n</document>"))
    whole = documents.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", block.alias("block")))).alias("blocks"))
    return whole.join(question, "query_id").select("query_id", F.concat(F.array_join("blocks.block", "\n\n"), F.lit("\n\nQuestion: "), neutral(F.col("question"))).alias("prompt"))


def history(turns: DataFrame, last: int = 6, chars: int = 1000) -> DataFrame:
    """conv_id, prompt: the last turns of a conversation, each cut to ``chars``, with the role before it."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= last)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.left(F.coalesce("text", F.lit("")), F.lit(chars)))
    said = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return said.select("conv_id", F.array_join("lines.line", "\n").alias("prompt"))
