"""Answers as columns: citations, refusals, quotes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The answer given when nothing was found, and the lines that may stand for it or follow it.
EMPTY_ANSWER = "The available documents do not contain enough information to answer that."
_LABEL = r"(?i:[^.!?\n]*\bdo not bear on the question(?: at all)?\.?)"
_RELATED = r"(?i:closest related material:(?:[^\[\]\n.!?]|[.!?](?!\s))*\[\d+\]\s*\.?)"
#: The whole of an answer that refuses: one of the two openings, then a related line or nothing; lines may be padded and parted by blank ones.
_REFUSAL = rf"^\s*(?:{EMPTY_ANSWER[:-1]}\.?|{_LABEL})[ \t\r]*(?:\n\s*{_RELATED})?\s*$"
RANGE_SPAN, PLAUSIBLE = 50, 99


def cited(answer: Column) -> Column:
    """Indices cited, ascending: [1], [1, 2] and [1-3]; a range counts if it spans 50 at most."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([0-9 ,\t\n–—-]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    ranged = r"^\s*([0-9]+)\s*[–—-]\s*([0-9]+)\s*$"

    def indices(p: Column) -> Column:
        a, b = (F.regexp_extract(p, ranged, i).try_cast("bigint") for i in (1, 2))
        single = F.regexp_extract(p, r"^\s*([0-9]+)\s*$", 1).try_cast("bigint")
        some = F.when((b >= a) & (b - a <= RANGE_SPAN), F.sequence(a, b))
        return F.coalesce(some, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, indices))))


def invalid(answer: Column, valid: Column) -> Column:
    """Cited indices up to 99 that no citation has."""
    return F.filter(F.array_except(cited(answer), valid), lambda i: i <= PLAUSIBLE)


def is_refusal(answer: Column) -> Column:
    """The empty answer or its label on the first line, then at most one line of related material."""
    return answer.rlike(_REFUSAL)


def warnings(answer: Column, valid: Column) -> Column:
    """invalid_citation for fabricated indices, uncited_answer for an answer that cites none and is no refusal."""
    uncited = (F.size(F.array_intersect(cited(answer), valid)) == 0) & ~is_refusal(answer)
    return F.array_compact(F.array(F.when(F.size(invalid(answer, valid)) > 0, F.lit("invalid_citation")), F.when(uncited, F.lit("uncited_answer"))))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _plain(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses as ASCII."""
    return F.replace(F.translate(text, "‘’‚“”„–—−", "'''\"\"\"---"), F.lit("…"), F.lit("..."))


def quote_rung(quote: Column, source: Column) -> Column:
    """How a quote is found in its source: exact, whitespace, unicode, markdown, or none; each step folds more."""
    bare = lambda t: F.regexp_replace(t, r"[*_`#>\[\]]", "")
    steps = (("exact", lambda t: t), ("whitespace", _folded), ("unicode", lambda t: _folded(_plain(t))), ("markdown", lambda t: _folded(bare(_plain(t)))))
    found = F.when(F.length(F.trim(F.coalesce(quote, F.lit("")))) == 0, "none")
    for name, fold in steps:
        found = found.when(F.contains(fold(source), fold(quote)), name)
    return found.otherwise("none")


def neutral(text: Column) -> Column:
    """Tags of the prompt in a passage lose their brackets."""
    return F.regexp_replace(text, r"(?i)</?\s*(document|context|question|excerpt)s?\b[^>]*>", "")


def with_notice(answer: Column, truncated: Column, notice: str = "\n\n[The answer was cut at the length limit.]") -> Column:
    return F.when(truncated, F.concat(answer, F.lit(notice))).otherwise(answer)
