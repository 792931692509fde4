"""Operator 8: line deduplication by winnowing over line hashes.

Units are lines with a word, compared after trimming. A run is some lines that follow one another in a
document (blank lines between them don't count), of ``min_words`` words or more. Every run that stands at an earlier
place too (documents by doc_id, then by place) is deleted; the earliest stays. Shorter repeats stay. Repeats that begin and end
within lines are the matter of passage_dedup, the other half of this operator; dedup() does both.

1. Winnow: each window, the shortest run of ``min_words`` words from a line on, selects its line of least hash; a document's
   fingerprints are the lines selected, each once. Equal windows select the same line, so the fingerprints are guaranteed.
2. Join positions: a fingerprint that stands at one place only matches nothing. Documents without another are done with.
3. Extend both ways: the windows that hold a repeated fingerprint, forward from each line and backward from it, are keyed by
   128 bits of their lines' hashes and joined with the earliest place of that key: one row per key, so copies are
   never paired with each other. A line lies in a repeated run iff one of its windows does: a run that holds the line can
   be cut from both ends until it is a window that begins at or before the line, or one that ends at it.
4. Delete the lines of all windows that stand at an earlier place too.

All grouping is aggregated before the shuffle; rows of a hot fingerprint or window stay where they are. Windows over a
document's lines (32 bytes each) are the only thing gathered per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, filled, free_name, if_few, join_one, settle, with_row_id

#: What is trimmed from a line, and what a word is made of.
_SPACE, _WORD = " \t\n\x0b\f\r", r"[^\x20\x09-\x0D]+"


def later_lines(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """For rows of __row, doc_id, text: the places (__row, pos, words) of the lines to delete."""
    work = Scratch(rows.sparkSession)
    lines = rows.select("__row", "doc_id", F.posexplode(F.split(filled(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(_SPACE))).where("line <> ''")
    lines = work.settle(
        lines.select("__row", "doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), F.regexp_count("line", F.lit(_WORD)).alias("words"))
    )
    places = Window.partitionBy("__row").orderBy("pos")
    upto = F.sum("words").over(places.rowsBetween(Window.unboundedPreceding, 0))
    told = lambda of: of.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("words"))

    def over(forward: bool):
        return Window.partitionBy("__row").orderBy("since" if forward else "upto").rangeBetween(*((0, min_words - 1) if forward else (1 - min_words, 0)))

    least = told(lines).select("__row", F.sum("words").over(over(True)).alias("total"), F.min(F.struct("h1", "h2", "pos")).over(over(True)).alias("f"))
    selected = work.settle(least.where(F.col("total") >= min_words).select("__row", "f.*").distinct())
    at = F.struct("__row", "pos")
    repeated = work.settle(selected.groupBy("h1", "h2").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n")).where("a <> b").select("h1", "h2", "n"))
    hits = work.settle(join_one(selected, repeated, ["h1", "h2"]).select("__row", "pos", F.lit(1).alias("hit")))
    near = told(lines.join(hits.select("__row").distinct(), "__row", "left_semi").join(hits, ["__row", "pos"], "left"))

    def windows(forward: bool) -> DataFrame:
        of = {"h1s": F.collect_list("h1"), "h2s": F.collect_list("h2"), "first": F.min("pos"), "last": F.max("pos"), "total": F.sum("words"), "hits": F.sum("hit")}
        found = near.select("__row", "doc_id", *[f.over(over(forward)).alias(n) for n, f in of.items()]).where((F.col("total") >= min_words) & (F.col("hits") > 0))
        return found.select("__row", "doc_id", "first", "last", F.lit(forward).alias("forward"), F.xxhash64("h1s").alias("k1"), F.xxhash64("h2s", F.size("h2s")).alias("k2"))

    tried = work.settle(windows(True).unionByName(windows(False)))
    place = F.struct("doc_id", "__row", "first")
    earliest = work.settle(tried.groupBy("k1", "k2").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    matched = join_one(tried, earliest, ["k1", "k2"]).where(F.col("earliest") < place)
    # Of the windows matched, the furthest end of those begun so far and the furthest start of those still to end tell whether a line is within one.
    ends = work.settle(
        matched.groupBy("__row", F.when(F.col("forward"), F.col("first")).otherwise(F.col("last")).alias("pos"))
        .agg(F.max(F.when(F.col("forward"), F.col("last"))).alias("to"), F.min(F.when(~F.col("forward"), F.col("first"))).alias("since"))
    )
    hit = lines.select("__row", "pos", "words").join(ends.select("__row").distinct(), "__row", "left_semi").join(ends, ["__row", "pos"], "left")
    to = F.max("to").over(places.rowsBetween(Window.unboundedPreceding, 0))
    since = F.min("since").over(places.rowsBetween(0, Window.unboundedFollowing))
    out = settle(hit.select("__row", "pos", "words", to.alias("to"), since.alias("since")).where("to >= pos or since <= pos").select("__row", "pos", "words"))
    work.drop()
    return out


def stretches(places: DataFrame, since: str, to: str) -> DataFrame:
    """__row, since, to: overlapping and touching stretches of a row made one."""
    order = Window.partitionBy("__row").orderBy("since", "to")
    spans = places.select("__row", F.col(since).cast("int").alias("since"), F.col(to).cast("int").alias("to")).withColumn("upto", F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("stretch", F.sum(F.when(F.col("since") <= F.col("upto") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("__row", "stretch").agg(F.min("since").alias("since"), F.max("to").alias("to")).drop("stretch")


def without(parts: Column, gone: Column) -> Column:
    """An array of arrays: the stretches of ``parts`` that lie before, between and behind those in ``gone`` (array of since, to; in order). Each part is copied once."""
    since = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["to"] + 1))
    to = F.concat(F.transform(gone, lambda g: g["since"]), F.array(F.size(parts)))
    return F.transform(F.arrays_zip(since.alias("since"), to.alias("to")), lambda x: F.slice(parts, x["since"] + 1, x["to"] - x["since"]))


def with_gone(docs: DataFrame, row: str, gone: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    """``docs`` with ``name``, the stretches (__row, since, to) to delete in order, null if there is none, and ``counts`` over them."""
    each = gone.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("since", "to"))).alias("gone"), *[c.alias(n) for n, c in counts.items()])
    each = settle(each.select(F.col("__row").alias(row), F.col("gone").alias(name), *[F.col(n).alias(name + n) for n in counts]))
    return docs.join(if_few(each, 2 * F.size(name) + 4), row, "left")


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by what is left of it, and new columns removed_lines and removed_words.

    Every row stays, in its own right if repeated; a text of which nothing is left is empty, a null text stays null. Null
    doc_ids come first in the order. Columns of ``docs`` with the two new names are replaced, other columns pass through
    whatever their names; an empty table gives no rows. The work grows with a text's lines, not with its lines times those deleted.
    """
    row = free_name(docs, "__row")
    rows = with_row_id(docs, row)
    places = later_lines(rows.select(F.col(row).alias("__row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_words)
    words = places.groupBy("__row").agg(F.count("*").alias("lines"), F.sum("words").alias("words"))
    gone = stretches(places, "pos", "pos").join(words, "__row")
    new, name, parts = ("removed_lines", "removed_words"), free_name(rows, "__gone"), free_name(rows, "__parts")
    joined = with_gone(rows, row, gone, {"lines": F.first("lines"), "words": F.first("words")}, name)
    joined = joined.withColumn(parts, F.when(F.col(name).isNotNull(), F.split(F.col(f"`{text}`"), "\n", -1)))
    left = F.array_join(F.flatten(without(F.col(parts), F.col(name))), "\n")
    keep = {c: F.col(f"`{c}`") for c in docs.columns if c not in new} | {text: F.when(F.col(name).isNull(), F.col(f"`{text}`")).otherwise(left).alias(text)}
    return joined.select(*keep.values(), *[F.coalesce(name + n.removeprefix("removed_"), F.lit(0)).cast("long").alias(n) for n in new])
