"""Operator 8 within lines: passages of words that stand at an earlier place too, wherever in lines they begin and end.

Units are words (runs of anything but ASCII white space). A word is deleted if ``min_words`` words in a row that hold it stand
at an earlier place too (documents by doc_id, then by place) that they don't overlap; the earliest stays.

1. Winnow: each window of ``min_words`` words selects its run of k words of least hash, k being half of it. Equal windows share
   the selected run, an anchor: the fingerprints are guaranteed.
2. Join positions: an anchor selected at one place only matches nothing. Each of the others has its context: all words of the
   windows that hold it. If a context stands earlier too, so do all its windows: its words go and it is done with. So
   copies cost a row per anchor.
3. Extend word by word both ways: from anchors that still stand at several places in different contexts, each window that
   holds one is keyed by 128 bits of its words' hashes and joined with the earliest place of that key. No places are paired.
4. Delete the words of all contexts and windows that stand at an earlier place too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, filled, free_name, if_few, join_one, settle, with_row_id
from .line_dedup import dedup_lines, stretches, with_gone, without

_SPACE, _SPACES, _WORD = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Low bits of a packed run hold its place, the rest its hash, so the least goes by hash, then by place.
_PLACE_BITS = 31


def _over(rows: DataFrame, name: str, n: int, pair) -> DataFrame:
    """``rows`` with each element of an array made one of itself and the n - 1 after it, by doubling; the last n - 1 go. Each step
    is a column of its own, as an expression within a lambda would be computed again for each element."""
    a, span = F.col(name), 1
    while span < n:
        by = min(span, n - span)
        rows = rows.withColumn(name, F.transform(a, lambda x, i: pair(x, F.get(a, i + by))))  # noqa: B023
        span += by
    return rows.withColumn(name, F.slice(a, 1, F.greatest(F.size(a) - (n - 1), F.lit(0))))


def _hashes(text: Column) -> Column:
    return F.transform(F.split(F.btrim(text, F.lit(_SPACE)), f"{_SPACES}+", -1), lambda x: F.xxhash64(x))


def _twice(*of: Column) -> list[Column]:
    return [F.xxhash64(*of), F.xxhash64(F.lit(1), *of)]


def later_passages(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """For rows of __row, doc_id, text: the stretches of words (__row, since, to; the first word is 0) to delete."""
    if min_words < 2:
        raise ValueError("min_words < 2")
    k = (min_words + 1) // 2
    before, mask = min_words - k, (1 << _PLACE_BITS) - 1
    place = lambda at: F.struct("doc_id", "__row", F.col(at).alias("at"))
    apart = (F.col("earliest.__row") != F.col("__row")) | (F.col("at") - F.col("earliest.at") >= min_words)
    h, g = F.col("h"), F.col("g")

    step = rows.select("__row", "doc_id", _hashes(filled(F.col("text"))).alias("h")).where(F.size("h") >= min_words).withColumn("g", h)
    step = _over(step, "g", k, lambda x, y: F.xxhash64(x, y))
    packed = lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), _PLACE_BITS).bitwiseOR(i.cast("long"))
    step = _over(step.withColumn("m", F.transform(g, packed)), "m", min_words - k + 1, F.least)
    step = step.withColumn("m", F.array_distinct("m"))

    def anchor(x: Column) -> Column:
        at = x.bitwiseAND(F.lit(mask)).cast("int")
        since = F.greatest(at - before, F.lit(0))
        c1, c2 = _twice(F.slice(h, since + 1, at + min_words - since), at - since)
        return F.struct(at.alias("at"), F.get(g, at).alias("g"), since.alias("since"), F.least(at + min_words, F.size(h)).alias("end"), c1.alias("c1"), c2.alias("c2"))

    work = Scratch(rows.sparkSession)
    anchors = work.settle(step.select("__row", "doc_id", F.inline(F.transform("m", anchor))))
    several = lambda of: work.settle(of.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    tried = work.settle(join_one(anchors, several(anchors), ["g"]))
    earliest = work.settle(tried.groupBy("c1", "c2").agg(F.min(place("at")).alias("earliest"), F.count("*").alias("n")))
    told = work.settle(join_one(tried, earliest, ["c1", "c2"]).select("__row", "at", "g", "since", "end", apart.alias("whole")))
    whole = told.where("whole").select("__row", "since", (F.col("end") - 1).alias("to"))

    left = told.where("not whole")
    edges = join_one(left, several(left), ["g"]).groupBy("__row").agg(F.collect_set("at").alias("ats"))
    near = rows.join(if_few(work.settle(edges), F.size("ats") + 3), "__row").select("__row", "doc_id", "ats", _hashes(filled(F.col("text"))).alias("h"))
    begins = F.flatten(F.transform("ats", lambda p: F.sequence(F.greatest(p - before, F.lit(0)), F.least(p, F.size(h) - min_words))))
    near = near.select("__row", "doc_id", "h", F.array_distinct(begins).alias("begins"))

    def window(s: Column) -> Column:
        k1, k2 = _twice(F.slice(h, s + 1, min_words))
        return F.struct(s.alias("at"), k1.alias("k1"), k2.alias("k2"))

    windows = work.settle(near.select("__row", "doc_id", F.inline(F.transform("begins", window))))
    first = work.settle(windows.groupBy("k1", "k2").agg(F.min(place("at")).alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    found = join_one(windows, first, ["k1", "k2"]).where(apart).select("__row", F.col("at").alias("since"), (F.col("at") + (min_words - 1)).alias("to"))
    out = settle(stretches(whole.unionByName(found), "since", "to"))
    work.drop()
    return out


def dedup_passages(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by what is left of it, and a new column removed_words.

    White space goes with the word before it, but for that after a passage's last word if it holds a line break. Every row stays;
    a null text stays null. Null doc_ids come first in the order. A column of ``docs`` with the new name is replaced, others pass
    through whatever their names; an empty table gives no rows. Very long texts are an array of words within their task.
    """
    row = free_name(docs, "__row")
    rows = with_row_id(docs, row)
    gone = later_passages(rows.select(F.col(row).alias("__row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_words)
    name, parts = free_name(rows, "__gone"), free_name(rows, "__parts")
    joined = with_gone(rows, row, gone, {"words": F.sum(F.col("to") - F.col("since") + 1)}, name)
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{_WORD}+{_SPACES}*"), F.lit(0))
    joined = joined.withColumn(parts, F.when(F.col(name).isNotNull(), pieces))
    # What stays, each stretch followed by the line break, if any, behind the passage that comes next.
    behind = F.transform(name, lambda g: F.get(parts, g["to"]))
    breaks = F.concat(F.transform(behind, lambda x: F.array(F.when(F.contains(x, F.lit("\n")), F.regexp_replace(x, f"^{_WORD}+", "")).otherwise(""))), F.array(F.array(F.lit(""))))
    kept = F.array_join(F.flatten(F.zip_with(without(F.col(parts), F.col(name)), breaks, lambda x, y: F.concat(x, y))), "")
    left = F.concat(F.regexp_extract(F.col(f"`{text}`"), f"^{_SPACES}*", 0), kept)
    keep = {c: F.col(f"`{c}`") for c in docs.columns if c != "removed_words"} | {text: F.when(F.col(name).isNull(), F.col(f"`{text}`")).otherwise(left).alias(text)}
    return joined.select(*keep.values(), F.coalesce(name + "words", F.lit(0)).cast("long").alias("removed_words"))


def dedup(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Operator 8 as a whole: dedup_lines(), then dedup_passages() over what it has left; ``docs`` with its text replaced and
    new columns removed_lines, removed_words. Odd rows, ties, empty tables and very long texts as in those two."""
    lines = settle(dedup_lines(docs, min_words, doc_id, text))
    was, kept = free_name(lines, "__was"), [c for c in lines.columns if c != "removed_words"]
    found = dedup_passages(lines.withColumnRenamed("removed_words", was), min_words, doc_id, text)
    return found.select(*[F.col(f"`{c}`") for c in kept], (F.col(was) + F.col("removed_words")).alias("removed_words"))
