"""Claims and their quotes: reading a model's claims, finding a quote's place in its source, limits on what is asked."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

CLAIMS = "struct<claims:array<struct<claim:string,quote:string,distractor_note:string>>>"
# Characters that count as plain ones.
_PLAIN = {**dict.fromkeys("‘’‚", "'"), **dict.fromkeys("“”„", '"'), **dict.fromkeys("–—−", "-"), "…": "..."}
_MARKS = frozenset("*_`#>[]")


def claims(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """A row per claim of a model's JSON: from its first brace to its last, fenced or not. Claims without a distractor note are
    dropped, and answers that are no JSON have none."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    found = F.from_json(body, CLAIMS)
    return answers.select("*", F.explode(F.filter(found["claims"], lambda c: F.length(F.trim(F.coalesce(c["distractor_note"], F.lit("")))) > 0)).alias("c")).select(*[c for c in answers.columns], "c.*")


def _fold(text: str, char: Callable[[str], str]) -> tuple[str, list[int]]:
    """The text with each character replaced and white space folded, and where each character came from."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        for x in char(c):
            if x.isspace():
                if not out or out[-1] == " ":
                    continue
                x = " "
            out.append(x)
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


_RUNGS: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("whitespace", lambda c: c),
    ("unicode", lambda c: _PLAIN.get(c, c)),
    ("markdown", lambda c: "" if c in _MARKS else _PLAIN.get(c, c)),
)


def quote_span(quote: str | None, source: str | None) -> tuple[str, int, int]:
    """(rung, start, end): where a quote stands in its source, in code points of the source, by the first rung that finds it."""
    if not quote or not quote.strip() or source is None:
        return "none", -1, -1
    start = source.find(quote)
    if start >= 0:
        return "exact", start, start + len(quote)
    for name, char in _RUNGS:
        wanted, _ = _fold(quote, char)
        text, at = _fold(source, char)
        k = text.find(wanted) if wanted else -1
        if k >= 0:
            return name, at[k], at[k + len(wanted) - 1] + 1
    return "none", -1, -1


_SPAN = T.StructType([T.StructField("rung", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_SPAN)
def _spans(quotes: pd.Series, sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([quote_span(q, s) for q, s in zip(quotes, sources, strict=True)], columns=["rung", "start", "end"])


def located(quote: Column, source: Column) -> Column:
    """A struct of rung, start and end."""
    return _spans(quote, source)


# Characters of a question and results at most, by what is asked.
LIMITS = {"search": (1000, 100), "ask": (2000, 30)}
HISTORY_TURNS, HISTORY_CHARS = 12, 4000


def bounded(kind: str, question: str, top_k: int = 12) -> tuple[str, int]:
    """The question and k, or an error if they are outside the limits."""
    chars, most = LIMITS[kind]
    if not question.strip() or len(question) > chars:
        raise ValueError(f"a question has 1 to {chars} characters")
    if not 1 <= top_k <= most:
        raise ValueError(f"k is 1 to {most}")
    return question, top_k


def history_problem(turns: Column) -> Column:
    """Why a history (array of role, text) can't be used; null if it can."""
    long = F.exists(turns, lambda t: F.length(t["text"]) > HISTORY_CHARS)
    return F.when(F.size(turns) > HISTORY_TURNS, f"more than {HISTORY_TURNS} turns").when(long, f"a turn of more than {HISTORY_CHARS} characters")


def failure_cause(error: Column) -> Column:
    """What kind of failure a scan's message tells: timeout, unavailable, empty_pack, else unknown; null without a failure."""
    found = F.lower(error)
    return F.when(found.rlike(r"time[d ]*out|deadline"), "timeout").when(found.rlike(r"refused|unreachable|not found|503"), "unavailable").when(found.rlike("without rules"), "empty_pack").when(found.isNotNull(), "unknown")


def preflight(prompt: Column, url: Column, hosts: tuple[str, ...], policy: str = "warn") -> Column:
    """Why a prompt may not be sent: an identifier (or any label under "block"), or a host that isn't allowed; null if it may."""
    from ..sources.connectors import allowed_hosts
    from .identifiers import identifying, taxpayer_labels

    labels = taxpayer_labels(prompt)
    stops = F.lit(False) if policy == "off" else F.size(labels if policy == "block" else identifying(labels)) > 0
    return F.when(stops, F.concat(F.lit("labels: "), F.array_join(labels, ","))).when(~allowed_hosts(url, hosts), "host")
