"""Documents into chunks: by headings and paragraphs, tables by whole rows, all within a budget of tokens.

``chunk_documents`` runs one Arrow pass over its rows: chunks of a document depend on that document alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

_PIECE = re.compile(r"\w+|[^\w\s]")
_FENCE, _HEADING = "```", re.compile(r"(#{1,6})\s+(.+?)\s*$")
_RULE = re.compile(r"\s*\|?\s*:?-{3,}")


class Pieces:
    """The default measure: words and punctuation marks. Another one needs ``count`` and ``tail``."""

    def count(self, text: str) -> int:
        return len(_PIECE.findall(text))

    def tail(self, text: str, n: int) -> str:
        """The last n tokens."""
        starts = [m.start() for m in _PIECE.finditer(text)]
        return text[starts[-n] :] if n < len(starts) else text

    def head(self, text: str, n: int) -> str:
        ends = [m.end() for m in _PIECE.finditer(text)]
        return text[: ends[n - 1]] if n < len(ends) else text


class Bpe(Pieces):
    """Tokens of a byte-level BPE vocabulary: the content of a file of ranks (a token in base64 and its rank a line) and the pattern
    that cuts texts into pieces. The content travels with the measure, about 1 MB, so executors need no file of their own."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def _ids(self, text: str) -> list[int]:
        return _encoding(self.ranks, self.pattern).encode_ordinary(text)

    def _text(self, ids: list[int]) -> str:
        """Bytes of a character that is cut in two are left out."""
        return _encoding(self.ranks, self.pattern).decode(ids, errors="ignore")

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def tail(self, text: str, n: int) -> str:
        ids = self._ids(text)
        return self._text(ids[-n:]) if n < len(ids) else text

    def head(self, text: str, n: int) -> str:
        ids = self._ids(text)
        return self._text(ids[:n]) if n < len(ids) else text


@lru_cache(1)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = dict((base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, ranks.splitlines()))
    return tiktoken.Encoding("measure", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


@dataclass(frozen=True)
class Budget:
    size: int = 800
    overlap: int = 120
    row_overlap: int = 0
    most: int = 1700


@dataclass
class Chunk:
    text: str
    path: list[str] = field(default_factory=list)

    @property
    def hash(self) -> str:
        return hashlib.sha256(("/".join(self.path) + "::" + self.text).encode()).hexdigest()


def _fenced(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Lines, and whether each is within a code fence (its own marks are)."""
    inside = False
    for line in lines:
        mark = line.strip().startswith(_FENCE)
        yield line, inside or mark
        inside ^= mark


def sections(markdown: str) -> list[tuple[list[str], str]]:
    """(headings above, body) of each stretch between headings; headings in code don't count; empty bodies are left out."""
    lines = markdown.split("\n")
    marks = [(i, hit) for i, (line, code) in enumerate(_fenced(lines)) if not code and (hit := _HEADING.match(line))]
    ends = [i for i, _ in marks] + [len(lines)]
    above: dict[int, str] = {}  # the heading of each depth that a line stands under; a new one ends those of its depth and deeper
    out = [([], "\n".join(lines[: ends[0]]).strip())]
    for (i, hit), end in zip(marks, ends[1:], strict=True):
        depth = len(hit[1])
        above = {d: title for d, title in above.items() if d < depth} | {depth: hit[2]}
        out.append((list(above.values()), "\n".join(lines[i + 1 : end]).strip()))
    return [x for x in out if x[1]] or [([], markdown.strip())]


def paragraphs(body: str) -> list[str]:
    """Stretches between blank lines; a code fence is never parted."""
    units: list[list[str]] = [[]]
    for line, code in _fenced(body.split("\n")):
        if line.strip() or code:
            units[-1].append(line)
        elif units[-1]:
            units.append([])
    return [u for lines in units if (u := "\n".join(lines).strip())]


def is_table(unit: str) -> bool:
    lines = [x for x in unit.split("\n") if x.strip()]
    return len(lines) > 2 and all(x.lstrip().startswith("|") for x in lines) and bool(_RULE.match(lines[1]))


def fill(parts: Iterable[tuple[str, int]], room: int) -> Iterator[list[str]]:
    """Greedy: parts (text, tokens) in order, as many as fit into each group; a part that is too large is a group of its own."""
    group, used = [], 0
    for part, n in parts:
        if group and used + n > room:
            yield group
            group, used = [], 0
        group.append(part)
        used += n
    if group:
        yield group


def split_table(table: str, room: int, count: Callable[[str], int]) -> list[str]:
    """Whole rows, each group below the header and its rule."""
    top, rule, *rows = [x for x in table.split("\n") if x.strip()]
    head = f"{top}\n{rule}"
    return ["\n".join([head, *g]) for g in fill(((r, count(r)) for r in rows), room - count(head))]


def split_long(text: str, room: int, count: Callable[[str], int]) -> list[str]:
    """By sentences; a sentence that is too long itself by four characters a token."""
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for sentence in re.findall(r"[^.!?]+[.!?]?\s*|[.!?]+\s*", text) or [text]:
        n = count(sentence)
        if n <= room:
            run.append((sentence, n))
            continue
        out += map("".join, fill(run, room))
        run = []
        out += [sentence[i : i + 4 * room] for i in range(0, len(sentence), 4 * room)]
    return out + list(map("".join, fill(run, room)))


def chunk_markdown(markdown: str, budget: Budget = Budget(), measure: Pieces = Pieces()) -> list[Chunk]:
    """Chunks in order. Sections with fewer than three letters or digits are left out; a chunk begins with its headings; one
    that follows another of its section begins with the last tokens of that one, unless it is a table."""
    chunks = []
    for path, body in sections(markdown):
        if sum(c.isalnum() for c in body) < 3:
            continue
        head = f"# {' › '.join(path)}\n\n" if path else ""
        if measure.count(body) <= budget.size:
            chunks.append(Chunk(head + body, path))
            continue
        bodies: list[str] = []
        run: list[tuple[str, int]] = []
        for unit in paragraphs(body):
            n = measure.count(unit)
            if n <= budget.size:
                run.append((unit, n))
            else:
                bodies += map("\n\n".join, fill(run, budget.size))
                run = []
                bodies += (split_table if is_table(unit) else split_long)(unit, budget.size, measure.count)
        bodies += map("\n\n".join, fill(run, budget.size))
        for before, now in zip([None, *bodies], bodies, strict=False):
            joined = before is not None and budget.overlap > 0 and not is_table(now)
            chunks.append(Chunk(head + (f"{measure.tail(before, budget.overlap)}\n\n{now}" if joined else now), path))
    return chunks


def _cell(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value or "").replace("|", "\\|")).strip()


def _row(cells: list) -> str:
    return "| " + " | ".join(map(_cell, cells)) + " |"


def chunk_table(table: dict, budget: Budget = Budget(), measure: Pieces = Pieces()) -> list[Chunk] | None:
    """Chunks of a sheet, each with its title and header; None for prose and free form, which the Markdown path takes.

    A financial sheet that fits stays whole. Each chunk carries the last ``row_overlap`` rows of the one before; a row that
    doesn't fit beside the header is a chunk of its own.
    """
    if not table.get("headers") or not table.get("rows") or table.get("sheet_type") in ("narrative", "freeform"):
        return None
    name = table.get("sheet_name")
    head = (f"# {name}\n\n" if name else "") + _row(table["headers"]) + "\n| " + " | ".join("---" for _ in table["headers"]) + " |\n"
    rows, path = [_row(r) for r in table["rows"]], [name] if name else []
    if table.get("sheet_type") == "financial_model" and measure.count(head + "\n".join(rows)) <= budget.size:
        return [Chunk(head + "\n".join(rows), path)]
    room, sizes = budget.size - measure.count(head), [measure.count(r) for r in rows]
    groups: list[list[int]] = []
    now: list[int] = []
    for i, n in enumerate(sizes):
        if now and (n > room or sum(sizes[j] for j in now) + n > room):
            groups.append(now)
            now = [] if n > room else now[len(now) - min(budget.row_overlap, len(now)) :]
        now = [*now, i]
        if n > room:
            groups.append(now)
            now = []
    if now:
        groups.append(now)
    return [Chunk(head + "\n".join(rows[i] for i in g), path) for g in groups]


def with_title(chunk: Chunk, title: str, budget: Budget = Budget(), measure: Pieces = Pieces()) -> Chunk:
    """The document's title before the headings of a chunk, unless it is the first of them; then cut to the hard limit."""
    title = " ".join(title.split())
    headings = " › ".join(chunk.path)
    first, _, rest = chunk.text.partition("\n")
    if not title or chunk.path and first == f"# {headings}" and chunk.path[0].strip().lower() == title.lower():
        return chunk
    text = f"# {title} › {headings}\n{rest}" if headings and first == f"# {headings}" else f"# {title}\n\n{chunk.text}"
    return Chunk(measure.head(text, budget.most), chunk.path)


def chunk_one(title: str | None, markdown: str | None, tables: list[dict] | None, budget: Budget = Budget(), measure: Pieces = Pieces()) -> list[Chunk]:
    """A document with typed sheets goes by its tables (one that has no chunks by its Markdown), any other by its Markdown."""
    if any(t.get("sheet_type") for t in tables or []):
        found: list[Chunk] = []
        for t in tables or []:
            some = chunk_table(t, budget, measure)
            found += chunk_markdown(t.get("markdown") or "", budget, measure) if some is None else some
    else:
        found = chunk_markdown(markdown or "", budget, measure)
    return [with_title(Chunk(measure.head(c.text, budget.most), c.path), title or "", budget, measure) for c in found if c.text.strip()]


SCHEMA = "document_id {kind}, ordinal int, hash string, text string, token_count int, heading_path array<string>"


def chunk_documents(documents: DataFrame, budget: Budget = Budget(), measure: Pieces = Pieces()) -> DataFrame:
    """Chunks of ``documents`` (document_id, title, markdown, and tables if there are any): ordinals count from 0 in each.

    Null or empty documents have no chunks.
    """
    kind = dict(documents.dtypes)["document_id"]
    has = "tables" in documents.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for d in batch.to_pylist():
                for i, c in enumerate(chunk_one(d["title"], d["markdown"], d.get("tables"), budget, measure)):
                    rows.append((d["document_id"], i, c.hash, c.text, measure.count(c.text), c.path))
            kinds = [batch.schema.field("document_id").type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
            names = ["document_id", "ordinal", "hash", "text", "token_count", "heading_path"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return documents.select("document_id", F.col("title"), "markdown", *["tables"] * has).mapInArrow(run, SCHEMA.format(kind=kind))
