from pyspark.sql import functions as F

from lakelore.functions import claims
from lakelore.operators import quotes

DOCS = ["The quick brown fox jumps.", "quick", "Of the and to", "a fox — brown!", "", None, "QUICK brown", "foxes", "x; y; z", "no such thing of the sort"]
QUOTES = ["quick brown fox", "quick", "of the", "fox", "ox", "the", "; y", "—", "jumps.", "quick brown", "and", "such thing of the", "", None, "unknown words here now", "f x"]


def _tables(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, quote string")


def test_short_quotes_are_found(spark):
    """Of one word or two, of stop words, of none: as comparing every pair finds them."""
    docs, items = _tables(spark)
    found = quotes.candidates(items, docs).join(items, "item_id").where(F.contains("text", "quote"))
    want = sorted((i, d) for i, q in enumerate(QUOTES) if q for d, t in enumerate(DOCS) if t and q in t)
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == want


def test_candidates_are_documents_with_the_quotes_words(spark):
    docs, items = _tables(spark)
    found = quotes.candidates(items, docs).join(items, "item_id").select("item_id", "doc_id", claims.located(F.col("quote"), F.col("text"))["rung"].alias("rung"))
    rungs = {(r.item_id, r.doc_id): r.rung for r in found.where("rung <> 'none'").collect()}
    assert all(rungs[i, d] == "exact" for i, q in enumerate(QUOTES) if q for d, t in enumerate(DOCS) if t and q in t)
    assert quotes.candidates(items.limit(0), docs).count() == quotes.candidates(items, docs.limit(0)).count() == 0
