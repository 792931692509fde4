"""Which documents may hold a quote: few of all, found by words, before any text is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..session import settled
from .segments import if_few


def candidates(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, text: documents with the rarest word of a quote, whatever stands between its words. items: item_id, quote.

    A quote's first and last word may be cut within a document's word, and words of the stop list aren't looked up, so neither chooses. A quote that has no other
    word is compared with every document by the words it has: those are quotes of a word or two.
    """
    parts = F.filter(F.split(F.lower(F.coalesce("quote", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = settled(items.where("quote is not null and quote <> ''").select("item_id", T.tokens(F.col("quote")).alias("tokens"), parts.alias("parts")))
    edges = F.array(F.element_at("parts", 1), F.element_at("parts", -1))
    inner = F.when(F.size("parts") > 0, F.array_except(F.array_distinct("tokens"), edges)).otherwise(F.array().cast("array<string>"))
    words = split.select("item_id", F.explode(inner).alias("lexeme"))
    has = docs.select("doc_id", F.explode(T.lexemes(F.col("text"))).alias("lexeme")).join(words.select("lexeme").distinct(), "lexeme", "left_semi")
    rarest = words.join(has.groupBy("lexeme").agg(F.count("*").alias("n")), "lexeme").groupBy("item_id").agg(F.min_by("lexeme", F.struct("n", "lexeme")).alias("lexeme"))
    found = has.join(rarest, "lexeme").join(docs, "doc_id").select("item_id", "doc_id", "text")
    short = settled(split.where(F.size(inner) == 0).select("item_id", "parts"))
    if short.isEmpty():
        return found
    lowered = docs.withColumn("lowered", F.lower("text"))
    by_words = lowered.join(if_few(short, 3), F.forall("parts", lambda w: F.contains("lowered", w)))
    return found.unionByName(by_words.select("item_id", "doc_id", "text"))
