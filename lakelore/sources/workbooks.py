"""Workbooks of the zipped XML kind as rows of sheets, read as streams within tasks.

A file comes as the binaryFile reader gives it. Its XML is never held as a tree: shared strings are read once, then each sheet row by row. Cells
stand where their references say; text, numbers, truth values, dates and the stored results of formulas become strings. A file that
can't be read, or whose parts unpack to more than a bound, gives one row that says so.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

from ..functions.sheets import SHEET, sheet_type
from ..functions.text import markdown_table

#: Bytes of a part's XML, at most, and columns of a row, as the format allows.
MOST_BYTES, MOST_COLUMNS = 256 << 20, 16_384
# The format's own numbers of date formats.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Unreadable(ValueError):
    pass


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


class _Bounded(io.RawIOBase):
    """A part of the archive that ends with an error beyond so many bytes, whatever its header says it holds."""

    def __init__(self, file, most: int):
        self.file, self.left = file, most

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        self.left -= len(data)
        if self.left < 0:
            raise Unreadable("a part unpacks to too many bytes")
        into[: len(data)] = data
        return len(data)


def _elements(book: zipfile.ZipFile, name: str, tags: set[str], most: int) -> Iterator[ElementTree.Element]:
    """Elements of a part as each ends, with what they hold, which goes afterwards."""
    with book.open(name) as part:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(io.BufferedReader(_Bounded(part, most), 1 << 16), events=("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _tag(e) in tags:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """The text of a string, its runs joined, without its phonetic hints."""
    return "".join(_text(c) if _tag(c) == "r" else c.text or "" for c in e if _tag(c) in ("t", "r"))


def column(reference: str) -> int:
    """The column of a cell's reference, from 0: A1 is 0, AB7 is 27."""
    out = 0
    for c in re.match("[A-Za-z]+", reference)[0].upper():
        out = out * 26 + ord(c) - 64
    if out > MOST_COLUMNS:
        raise Unreadable("a reference beyond the last column")
    return out - 1


def _is_date(format_: str) -> str | None:
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", format_)
    if re.search(r"\[(h+|m+|s+)\]", plain, re.I):
        return "elapsed"
    return "date" if re.search("[dmhys]", re.sub(r"\[[^\]]*\]", "", plain).split(";")[0], re.I) else None


def _number(value: str, kind: str | None, first: datetime.datetime) -> str:
    if kind is None:
        return str(float(value)) if re.search("[.eE]", value) else str(int(value))
    days = float(value)
    if kind == "elapsed":
        return str(datetime.timedelta(days=days))
    if 0 <= days < 1:
        return (datetime.datetime.min + datetime.timedelta(seconds=round(days * 86400))).time().isoformat()
    at = first + datetime.timedelta(days=days + (first.year == 1899 and days < 60))
    return (at + datetime.timedelta(microseconds=500)).replace(microsecond=0).isoformat()


def read_workbook(content: bytes, most: int = MOST_BYTES) -> list[tuple[str, list[list[str]], int]]:
    """(name, rows, cells with a formula) of each sheet that isn't empty. Trailing rows of blanks are cut."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        parts = set(book.namelist())
        if "xl/workbook.xml" not in parts:
            raise Unreadable("no workbook")
        first, sheets = datetime.datetime(1899, 12, 30), []
        for e in _elements(book, "xl/workbook.xml", {"sheet", "workbookPr"}, most):
            if _tag(e) == "workbookPr":
                first = datetime.datetime(1904, 1, 1) if e.get("date1904") in ("1", "true") else first
            else:
                sheets.append((e.get("name"), next(v for k, v in e.items() if k.endswith("}id"))))
        targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", {"Relationship"}, most)}
        strings = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", {"si"}, most)] if "xl/sharedStrings.xml" in parts else []
        kinds: list[str | None] = []
        if "xl/styles.xml" in parts:
            formats: dict[int, str] = {}
            for e in _elements(book, "xl/styles.xml", {"numFmt", "cellXfs"}, most):
                if _tag(e) == "numFmt":
                    formats[int(e.get("numFmtId"))] = e.get("formatCode") or ""
                else:
                    ids = [int(x.get("numFmtId") or 0) for x in e]
                    kinds = [_is_date(formats[i]) if i in formats else "elapsed" if i == 46 else "date" if i in _DATES else None for i in ids]
        out = []
        for name, at in sheets:
            target = targets.get(at) or ""
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in parts or "worksheets/" not in part:
                continue  # a chart sheet has no cells
            rows, formulas = [], 0
            for row in _elements(book, part, {"row"}, most):
                number = int(row.get("r") or len(rows) + 1)
                if number - len(rows) > 1_048_576:
                    raise Unreadable("a row beyond the last one")
                rows += [[] for _ in range(number - 1 - len(rows))]
                cells: list[str] = []
                for c in row:
                    k = column(c.get("r")) if c.get("r") else len(cells)
                    found = {_tag(x): x for x in c}
                    formulas += "f" in found
                    value, kind = found["v"].text if "v" in found else None, c.get("t") or "n"
                    if kind == "s":
                        text = strings[int(value)] if value is not None else ""
                    elif kind == "inlineStr":
                        text = _text(found["is"]) if "is" in found else ""
                    elif kind == "b":
                        text = "" if value is None else "true" if value == "1" else "false"
                    elif kind == "n" and value is not None:
                        style = int(c.get("s") or 0)
                        text = _number(value, kinds[style] if style < len(kinds) else None, first)
                    else:
                        text = value or ""
                    cells += [""] * (k - len(cells))
                    cells[k:] = [text]
                rows.append(cells)
            while rows and not any(c.strip() for c in rows[-1]):
                rows.pop()
            if rows:
                out.append((name, rows, formulas))
    except Unreadable:
        raise
    except Exception as e:  # whatever a broken file does to the parsers
        raise Unreadable(f"unreadable workbook: {type(e).__name__}: {e}"[:300]) from None
    if not out:
        raise Unreadable("workbook is empty")
    return out


def workbook_sheets(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, position, sheet_name, headers, rows, formulas, sheet_type, markdown, parse_error: a row per sheet of files (path, content).

    The first row is the header; rows are padded to its width and no shorter than their own cells. A file that can't be read gives a row
    with parse_error alone.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        text, cells = pa.string(), pa.list_(pa.string())
        kinds = {"path": text, "position": pa.int32(), "sheet_name": text, "headers": cells, "rows": pa.list_(cells), "formulas": pa.int32(), "parse_error": text}
        for batch in batches:
            for at in range(batch.num_rows):
                path, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                found = []
                try:
                    for k, (name, (headers, *rows), formulas) in enumerate(read_workbook(content or b"", most)):
                        found.append((path, k, name, headers, [r + [""] * (len(headers) - len(r)) for r in rows], formulas, None))
                except Unreadable as e:
                    found.append((path, None, None, None, None, None, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    read = files.select("path", "content").mapInArrow(run, f"path string, position int, {SHEET}, formulas int, parse_error string")
    kind = F.when(F.col("parse_error").isNull(), sheet_type(F.col("headers"), F.col("rows"), F.col("formulas")))
    shown = F.when(F.col("parse_error").isNull(), F.concat(F.lit("# "), "sheet_name", F.lit("\n\n"), markdown_table(F.col("headers"), F.col("rows"))))
    return read.withColumns({"sheet_type": kind, "markdown": shown})


def workbook_documents(sheets: DataFrame) -> DataFrame:
    """path, title, markdown, tables (sheet_name, sheet_type, headers, rows, markdown), parse_error: a row per file. A workbook is one document."""
    table = F.struct("position", "sheet_name", "sheet_type", "headers", "rows", "markdown")
    whole = sheets.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("parse_error").isNull(), table))).alias("tables"), F.max("parse_error").alias("parse_error"))
    name = F.regexp_replace(F.regexp_replace("path", r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    kept = F.transform("tables", lambda t: t.dropFields("position"))
    return whole.select("path", name.alias("title"), F.array_join(F.transform("tables", lambda t: t["markdown"]), "\n\n").alias("markdown"), kept.alias("tables"), "parse_error")
