"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def retrieval_metrics(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: recall, precision and nDCG at each k and the mean reciprocal rank, over all queries of ``relevant``.

    ranking: query_id, document_id, rank (from 1). relevant: query_id, document_id.
    """
    wanted = relevant.distinct().withColumn("__good", F.lit(1))
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranking.join(wanted, ["query_id", "document_id"])
    gain = lambda r: 1 / F.log2(r + 1)
    cut = [f(k) for k in ks for f in (
        lambda k: F.count_if(F.col("rank") <= k).alias(f"h{k}"),
        lambda k: F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias(f"g{k}"),
    )]
    found = hits.groupBy("query_id").agg(*cut, F.min("rank").alias("first"))
    rows = size.join(found, "query_id", "left").fillna(0, [f"{x}{k}" for k in ks for x in "hg"])
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + gain(i))
    out = []
    for k in ks:
        out += [
            F.round(F.avg(F.col(f"h{k}") / F.col("n")), 6).alias(f"recall_{k}"), F.round(F.avg(F.col(f"h{k}") / F.lit(k)), 6).alias(f"precision_{k}"),
            F.round(F.avg(F.col(f"g{k}") / ideal(k)), 6).alias(f"ndcg_{k}"),
        ]
    return rows.agg(*out, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def gold_report(questions: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: recall over answerable questions, refusal accuracy, and how many have invented citations, were cut, or are missing.

    questions: id, answerable, relevant (array). observations: id, answer, retrieved, cited (arrays), refused, truncated.
    """
    rows = questions.join(observations, "id", "left")
    seen = F.col("answer").isNotNull()
    recall = F.size(F.array_intersect("relevant", "retrieved")) / F.nullif(F.size("relevant"), F.lit(0))
    return rows.agg(
        F.round(F.avg(F.when(seen & F.col("answerable"), recall)), 6).alias("recall"),
        F.round(F.avg(F.when(seen, (F.col("refused") == ~F.col("answerable")).cast("int"))), 6).alias("refusal_accuracy"),
        F.count_if(F.size(F.array_except("cited", "retrieved")) > 0).alias("fabricated"), F.count_if(F.col("truncated")).alias("truncated"), F.count_if(~seen).alias("missing"),
    )


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """id, faithfulness: supported claims of those judged; null if none was. verdicts: id, verdict."""
    yes, no = F.count_if(F.col("verdict") == "supported"), F.count_if(F.col("verdict") == "unsupported")
    return verdicts.groupBy("id").agg(F.round(yes / F.nullif(yes + no, F.lit(0)), 6).alias("faithfulness"))


def rung_report(rungs: DataFrame) -> DataFrame:
    """One row: quotes per rung, and strained if fewer than half of those found are exact."""
    n = {k: F.count_if(F.col("rung") == k) for k in ("exact", "whitespace", "unicode", "markdown", "none")}
    found = F.count_if(F.col("rung") != "none")
    return rungs.agg(*[c.alias(k) for k, c in n.items()], F.coalesce(n["exact"] / F.nullif(found, F.lit(0)) < 0.5, F.lit(False)).alias("strained"))


def gold_issues(questions: DataFrame) -> DataFrame:
    """id, issues of a question set: repeated ids, empty queries, answers nobody verified, answerable ones without a document."""
    n = questions.groupBy("id").agg(F.count("*").alias("__n"))
    rows = questions.join(n, "id")
    issue = lambda test, name: F.when(test, F.lit(name))
    issues = F.array_compact(F.array(
        issue(F.col("__n") > 1, "duplicate id"), issue(F.trim(F.coalesce("query", F.lit(""))) == "", "empty query"),
        issue(F.col("expected_answer").isNotNull() & F.col("verified_by").isNull(), "unverified answer"), issue(F.col("answerable") & (F.size("relevant") == 0), "no relevant document"),
    ))
    return rows.select("id", issues.alias("issues")).where(F.size("issues") > 0).distinct()


def grounding_scorecard(answers: DataFrame) -> DataFrame:
    """One row: rates of invalid citations, of refusals and of questions that retrieve their own document, over rows measured (status ok)."""
    rows = answers.where("status = 'ok'")
    share = lambda test: F.round(F.count_if(test) / F.nullif(F.count("*"), F.lit(0)), 6)
    return rows.agg(
        F.count("*").alias("measured"), share(F.size("invalid") > 0).alias("invalid_citation_rate"), share(F.col("refused")).alias("refusal_rate"), share(F.col("self_retrieved")).alias("self_retrieval_rate")
    )


def screen_inventory(hits: DataFrame, names: list[str]) -> DataFrame:
    """One row: hits per pattern, flagged documents, and the fingerprint of the corpus. hits: document_id, content_hash, a count per name."""
    flagged = sum((F.col(n) for n in names), start=F.lit(0)) > 0
    # The fingerprint adds up hashes, so no task gathers them all and their order is no matter.
    part = lambda i: F.sum(F.conv(F.substring("content_hash", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return hits.agg(*[F.sum(n).alias(n) for n in names], F.count_if(flagged).alias("flagged"), F.count("*").alias("documents"), F.sha2(F.concat_ws(",", part(0), part(1), part(2), part(3)), 256).alias("fingerprint"))
