"""Sheets: what kind each is, as columns; separated text as sheets."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

SHEET = "sheet_name string, headers array<string>, rows array<array<string>>"


def _numeric(value: Column) -> Column:
    plain = F.regexp_replace(F.trim(value), r"[,$% ]", "")
    return (~plain.isin("", "-", "+", ".")) & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def _share(n: Column, of: Column) -> Column:
    return F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0))


def sheet_type(headers: Column, rows: Column, formulas: Column) -> Column:
    """financial_model: a fifth of the cells are formulas. narrative: a long cell, or more than three widths. tabular: five rows of
    mostly full width under headers that aren't numbers. freeform: anything else, and an empty sheet."""
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")))
    cells = F.aggregate(filled, F.lit(0), lambda a, n: a + n)
    long = F.exists(rows, lambda r: F.exists(r, lambda c: F.length(c) > 200))
    named = F.filter(headers, lambda h: F.trim(h) != "")
    words = _share(F.size(F.filter(named, lambda h: ~_numeric(h))), F.size(named)) >= 0.8
    full = _share(F.size(F.filter(filled, lambda n: n == F.size(headers))), F.size(rows)) >= 0.75
    return (
        F.when((F.size(rows) == 0) | (cells == 0), "freeform")
        .when(_share(formulas, cells) >= 0.2, "financial_model")
        .when(long | (F.size(F.array_distinct(filled)) > 3), "narrative")
        .when((F.size(rows) >= 5) & (F.size(headers) >= 2) & words & full, "tabular")
        .otherwise("freeform")
    )


def parse_separated(data: bytes, tabs: bool = False) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of comma, tab, semicolon or bar separated text; UTF-8, else Latin-1; short rows are padded."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",\t;|")
    except csv.Error:
        dialect = csv.excel_tab if tabs else csv.excel
    lines = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), dialect)]
    if not lines:
        raise ValueError("no rows")
    headers, *rows = lines
    return headers, [r + [""] * (len(headers) - len(r)) for r in rows]


def separated_files(files: DataFrame) -> DataFrame:
    """path, sheet_name, headers, rows, parse_error of files as the binaryFile reader gives them (path, content)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    headers, rows = parse_separated(content, name.lower().endswith(".tsv"))
                    out.append((path, name.rsplit(".", 1)[0], headers, rows, None))
                except (ValueError, csv.Error) as e:
                    out.append((path, name.rsplit(".", 1)[0], None, None, str(e)))
            text, cells = pa.string(), pa.list_(pa.string())
            kinds = [text, text, cells, pa.list_(cells), text]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "sheet_name", "headers", "rows", "parse_error"])

    return files.select("path", "content").mapInArrow(run, f"path string, {SHEET}, parse_error string")
