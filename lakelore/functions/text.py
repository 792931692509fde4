"""Text as columns: analysis, titles, HTML, tables, file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The English stop list of PostgreSQL's text search.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now
    """.split()
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers in order, without stop words; null counts as empty."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def lexemes(text: Column) -> Column:
    """Distinct tokens. A text of stop words only has none, so it matches nothing."""
    return F.array_distinct(tokens(text))


def coverage(query: Column, chunk: Column) -> Column:
    """Share of a query's lexemes that a chunk has; 0 if the query has none."""
    return F.coalesce(F.size(F.array_intersect(query, chunk)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def title(parsed: Column, markdown: Column, filename: Column) -> Column:
    """A parser's title, else the first heading of level 1, else the file's name without its extension."""
    heading = F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(filled(parsed), filled(heading), filled(stem))


#: The entities that are decoded, ampersand last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Scripts and styles go, ends of blocks and breaks become line ends, tags go, six entities are decoded, space is folded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|tr|li|h[1-6]|table)>|<br[ \t]*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \n"))


def host(url: Column) -> Column:
    """A URL's host in lower case, null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def download_name(name: Column, default: str = "document") -> Column:
    """Safe for a header: no line ends or quotes, slashes as underscores, 200 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(name, "[\r\n\"]", ""), r"[/\\]", "_")
    return F.coalesce(F.nullif(F.substring(F.trim(plain), 1, 200), F.lit("")), F.lit(default))


def cell(value: Column) -> Column:
    """A cell of a Markdown table: pipes escaped, line ends as spaces."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def markdown_table(headers: Column, rows: Column) -> Column:
    """headers (array of string) and rows (array of those) as a Markdown table; short rows are padded to the headers."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    padded = lambda r: F.transform(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: F.get(r, i))
    return F.when(F.size(headers) > 0, F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, lambda r: line(padded(r)))), "\n")).otherwise("")


def markdown_tables(markdown: Column) -> Column:
    """Tables of a text: every stretch of rows between pipes that follows a header and its rule."""
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^(\|[^\n]*\|[ \t]*\n\|[ \t:|-]*-[ \t:|-]*\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*)$"), F.lit(1))


def html_table_rows(html: Column) -> Column:
    """Cells of an HTML table's rows, their tags taken off."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))


def html_table_to_markdown(html: Column) -> Column:
    """The first row is the header."""
    rows = html_table_rows(html)
    return markdown_table(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))


def email_addresses(header: Column) -> Column:
    """Addresses of a header, in lower case."""
    return F.transform(F.filter(F.split(F.coalesce(header, F.lit("")), ","), lambda a: F.trim(a) != ""), lambda a: F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(a, "<([^>]*)>", 1), F.lit("")), a))))


def is_number(value: Column) -> Column:
    """Whether a cell reads as a number, with thousands separators, a currency sign, a percent sign or brackets for minus."""
    plain = F.regexp_replace(F.trim(value), r"[$,%() ]", "")
    return F.coalesce((plain != "") & F.expr("true") & plain.try_cast("double").isNotNull(), F.lit(False))
