"""Operator 3: document fingerprints of closed syncmers.

A text is a row of words (runs of anything but ASCII white space; at most 64 characters each, so a text
without spaces has words too). A run of k words is a closed syncmer if the least hash of its inner runs of s
words stands at its first or last place. Whether it is depends on those k words alone, so equal
passages have equal syncmers wherever they stand. A fingerprint (``fingerprints``) holds all different syncmers of its text, each
with the place of its first occurrence. A text with words but no syncmer (there is one from 2k - s - 1 words on) has one anchor,
all its words. ``with_anchors`` also makes samples: one in ``share`` of the syncmers, those of least hash, but ``least`` of them if
there are as many.

Likeness: of all hashes of both fingerprints together (of samples: the least of them, as many as the smaller one is sure to hold),
the share found in both at places that agree: with no shift, with the same shift as another match, or with about the shift of one of the two matches before
or after it (by a quarter of the words between them at most), as edits spread over a text move it bit by bit. It is found by
sorting, so its time hardly grows faster than the fingerprints.
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import filled, free_name, identified, with_row_id

_WORD = r"[^\x20\x09-\x0D]{1,64}"
#: Low bits of an anchor hold its place, the rest its hash, so sorting goes by hash. A text of more words is an error.
_PLACE_BITS = 27
#: Neighbouring matches may differ in shift by their distance divided by this, and by one.
_DRIFT = 4


#: Syncmers that a sample holds at least, if there are as many, and one in how many it holds of more.
LEAST, SHARE = 64, 4


def with_anchors(rows: DataFrame, text: str, out: str, k: int = 5, s: int = 2, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``rows`` with ``out``: the anchors of a text, an ascending array of longs; all of them if ``share`` is 1. Each step is a column of its
    own, as an expression within a lambda would be computed again for each element."""
    if not 0 < s < k:
        raise ValueError("0 < s < k")
    words, inner, found = (free_name(rows, f"__{x}") for x in ("words", "inner", "found"))
    w, h, a = F.col(words), F.col(inner), F.col(found)
    keep = [F.col(f"`{c}`") for c in rows.columns if c != out]
    step = rows.select(*keep, F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0)).alias(words))
    few = F.when(F.size(w) < 1 << _PLACE_BITS, w).otherwise(F.raise_error(F.lit(f"a text of 2**{_PLACE_BITS} words or more")))
    step = step.select(*keep, words, F.transform(few, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, s)])).alias(inner))
    packed = lambda x, i: F.shiftleft(x.bitwiseAND(F.lit((1 << 63 - _PLACE_BITS) - 1)), _PLACE_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    last = k - s  # the last inner run's place

    def anchor(x: Column, i: Column) -> Column:
        rest = [F.get(h, i + j) for j in range(1, last + 1)]
        edge = F.least(x, rest[-1]) <= F.least(*rest[:-1], x) if len(rest) > 1 else F.lit(True)
        return F.when((i <= F.size(h) - k) & edge, packed(F.xxhash64(x, *rest), i))

    whole = F.when(F.size(w) > 0, F.array(packed(F.xxhash64(F.array_join(w, " ")), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*keep, words, F.sort_array(F.array_compact(F.transform(h, anchor))).alias(found))
    step = step.select(*keep, F.when(F.size(a) == 0, whole).otherwise(a).alias(found))
    first = lambda x, i: (i == 0) | (F.shiftright(x, _PLACE_BITS) != F.shiftright(F.get(a, F.greatest(i - 1, F.lit(0))), _PLACE_BITS))
    step = step.select(*keep, F.filter(a, first).alias(found))
    if share == 1:
        return step.select(*keep, a.alias(out))
    return step.select(*keep, F.slice(a, 1, F.greatest(F.lit(least), F.ceil(F.size(a) / share).cast("int"))).alias(out))


def as_string(anchors: Column) -> Column:
    """A fingerprint: each anchor in hexadecimal, joined by commas."""
    return F.array_join(F.transform(anchors, F.hex), ",")


def with_likeness(rows: DataFrame, left: str, right: str, out: str, least: int | None = LEAST) -> DataFrame:
    """``rows`` with ``out``: likeness of two anchor arrays, 0 to 1; two empty ones are alike. least: what samples hold at least;
    None: the arrays hold all anchors, and all count."""
    both, last, n = (free_name(rows, f"__{x}") for x in ("both", "last", "n"))
    l, r, m = F.col(left), F.col(right), F.col(both)  # noqa: E741
    keep = [F.col(f"`{c}`") for c in rows.columns if c != out]
    hash_, place = (lambda x: F.shiftright(x, _PLACE_BITS)), (lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    hashes = lambda c: F.transform(c, hash_)
    sided = lambda c, side: F.transform(c, lambda x: F.struct(hash_(x).alias("hash"), F.lit(side).alias("side"), place(x).alias("at")))
    sorted_ = F.sort_array(F.concat(sided(l, 0), sided(r, 1))).alias(both)
    # In order of hash, a match is a row whose hash the next has too.
    after = lambda i: F.get(m, i + 1)
    shifted = lambda x, i: F.struct((x["at"] - after(i)["at"]).alias("shift"), x["at"].alias("at"))
    if least is None:
        step = rows.select(*keep, (F.size(l) + F.size(r)).alias(n), sorted_)
        match = F.transform(m, lambda x, i: F.when(after(i)["hash"] == x["hash"], shifted(x, i)))
        step = step.select(*keep, n, F.sort_array(F.array_compact(match)).alias(both))
        step = step.select(*keep, (F.col(n) - F.size(m)).alias(n), both)
    else:
        # How many of the least hashes both are sure to hold, the number of those there are, and the last of them.
        sure = F.least(F.greatest(F.size(l), F.lit(least)), F.greatest(F.size(r), F.lit(least)))
        total = F.slice(F.sort_array(F.array_union(hashes(l), hashes(r))), 1, sure)
        step = rows.select(*keep, total.alias(last), sorted_)
        match = F.transform(m, lambda x, i: F.when((after(i)["hash"] == x["hash"]) & (x["hash"] <= F.element_at(F.col(last), -1)), shifted(x, i)))
        step = step.select(*keep, F.size(last).alias(n), F.when(F.size(last) > 0, F.sort_array(F.array_compact(match))).alias(both))
    # In order of shift, neighbours tell whether another match has the same one.
    same = lambda x, i: F.coalesce(F.get(m, i - 1)["shift"] == x["shift"], F.lit(False)) | F.coalesce(F.get(m, i + 1)["shift"] == x["shift"], F.lit(False))
    step = step.select(*keep, n, F.sort_array(F.transform(m, lambda x, i: F.struct(x["at"].alias("at"), x["shift"].alias("shift"), (same(x, i) | (x["shift"] == 0)).alias("agrees")))).alias(both))

    def follows(x: Column, y: Column) -> Column:
        apart = F.greatest(F.abs(x["at"] - y["at"]), F.abs(x["at"] - x["shift"] - y["at"] + y["shift"]))
        return F.coalesce(F.abs(x["shift"] - y["shift"]) <= 1 + apart / _DRIFT, F.lit(False))

    agrees = lambda x, i: x["agrees"] | functools.reduce(Column.__or__, [follows(x, F.get(m, i + j)) for j in (-2, -1, 1, 2)])
    return step.select(*keep, F.when(F.col(n) == 0, 1.0).otherwise(F.size(F.filter(m, agrees)) / F.col(n)).alias(out))


def _dealt(bounds: list[tuple[int, int]], key: Column, mixed: Column) -> tuple[Column, Column]:
    """In which stretch a row is, from 1, and whether it begins it, of stretches that begin at the ``bounds``, ascending (key, hash)."""
    keys, hashes = (F.from_json(F.lit(str([b[i] for b in bounds])), "array<bigint>") for i in (0, 1))  # literals, once folded
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]

    def reached(at: Column) -> Column:
        return (F.get(keys, at) < key) | ((F.get(keys, at) == key) & (F.get(hashes, at) <= mixed))

    within = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & reached(lo + s - 1), lo + s).otherwise(lo))
    return within, (F.get(keys, F.col("__in") - 1) == key) & (F.get(hashes, F.col("__in") - 1) == mixed)


def with_next(docs: DataFrame, carried: list[str], doc_id: str = "doc_id", rows_each: int = 2000, row: str | None = None) -> DataFrame:
    """Rows with ``next_<c>`` for each carried column: that of the next row by doc_id, after the last of the first.

    Rows are dealt into stretches of doc_id whose bounds are quantiles, at most 32768 of them (3 GB of text each at 100 TB,
    sorted with spilling). A doc_id that several quantiles fall on has as many stretches, by a hash of where a row stands in the
    table. The least row of a stretch also goes to the one before, as its end. So each row travels once, and no stretch is the
    whole table, even if all rows have one doc_id or none.
    Ties of doc_id go by that hash, the same whenever the rows are read; null doc_ids come last. ``row`` names a column made by
    with_row_id(). Columns: doc_id and the carried ones.
    """
    at = row or free_name(docs, "__row")
    docs = docs if row else with_row_id(docs, at)
    rows = docs.select(doc_id, *carried, F.coalesce(F.col(doc_id), F.lit(2**63 - 1)).alias("__key"), F.xxhash64(at).alias("__mixed"), F.col(at).alias("__at"))
    key, mixed = F.col("__key"), F.col("__mixed")
    n, lowest = rows.agg(F.count("*"), F.min(key)).first()
    stretches = max(1, min(32768, -(-n // rows_each)))
    shares = [i / stretches for i in range(stretches)]
    often = Counter(rows.agg(F.percentile_approx(key, shares, max(10_000, 4 * stretches))).first()[0] or [])
    bounds = sorted({(b, i * 2**64 // c - 2**63) for b, c in often.items() for i in range(c)} | {(lowest or 0, -(2**63))})
    # One row a stretch comes to the driver: its least key and hash. Stretches without rows go.
    firsts = rows.groupBy(_dealt(bounds, key, mixed)[0]).agg(F.min(F.struct(key.alias("key"), mixed.alias("mixed"))).alias("least")).collect()
    bounds = sorted((r.least.key, r.least.mixed) for r in firsts) or bounds
    within, begins = _dealt(bounds, key, mixed)
    rows = rows.withColumn("__in", within)
    own = F.struct(F.col("__in").alias("at"), F.lit(False).alias("end"))
    before = F.struct(F.when(F.col("__in") == 1, len(bounds)).otherwise(F.col("__in") - 1).alias("at"), F.lit(True).alias("end"))
    rows = rows.withColumn("__go", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("__go.at").orderBy("__go.end", "__key", "__mixed", "__at")
    return rows.select(doc_id, *carried, F.col("__go.end").alias("__end"), *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("not __end").drop("__end")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, s: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. A fingerprint holds all syncmers of its text, and likeness counts all of both. Null texts count as empty; an empty text has an empty fingerprint. An empty table gives no rows, a
    table of one row is its own next document. Repeated rows, and rows of one doc_id, follow each other by a hash of where they stand in the
    table, null doc_ids come last; many of one doc_id are dealt over many tasks. Very long texts are arrays of words within their task; one of
    2**27 words or more is an error. Other columns don't matter, whatever their names.
    """
    rows = identified(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": filled(F.col(f"`{text}`"))})
    rows = with_anchors(rows, "text", "anchors", k, s, share=1)
    rows = with_next(rows, ["text", "anchors"], row="__row")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("left(next_text, cast(floor(n_chars / 2) as int))")))
    rows = rows.select("doc_id", "n_chars", "anchors", "next_anchors", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_anchors(rows, "edited", "edited_anchors", k, s, share=1).drop("edited")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited", least=None)
    rows = with_likeness(rows, "anchors", "next_anchors", "near_next", least=None)
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("anchors")).alias("fingerprint"), as_string(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next")
