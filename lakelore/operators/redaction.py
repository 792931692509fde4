"""Scanning texts for identifiers and masking them.

A pack is a list of rules: a pattern, and by name a checksum and words that must stand nearby. A match that fails either is kept
with low confidence and never masked. Scanning that fails leaves null, which every later gate reads as "not to be shown".
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache, reduce

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identifiers import BARE, IDENTIFYING, TAXPAYER_PATTERNS, VOCABULARY, ascii_bounds, taxpayer_labels
from ..sources.commits import Folder


# What a pattern's \\s stands for.
_SPACES = r"\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def compiled(pattern: str) -> regex.Pattern:
    """A pattern as it is meant: letters, digits and word boundaries are ASCII, white space is any. So a number behind an accented letter is found."""
    out, inside = [], False
    for part in regex.findall(r"(?s)\\.|.", pattern):
        if part == r"\s":
            part = _SPACES if inside else f"[{_SPACES}]"
        elif part in ("[", "]"):
            inside = part == "["
        out.append(part)
    return regex.compile("(?a)" + "".join(out))


@lru_cache(1000)
def _pattern(pattern: str) -> regex.Pattern:
    return compiled(pattern)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def aba(value: str) -> bool:
    total = sum(int(d) * w for d, w in zip(value, (3, 7, 1) * 3, strict=False))
    return len(value) == 9 and total > 0 and total % 10 == 0


CHECKS: dict[str, Callable[[str], bool]] = {"luhn": luhn, "aba": aba}
# Fixed value: words that tell an account number.
CONTEXTS = {"account-vocab": r"(?i)\b(account|acct|routing|aba|bank|iban|swift|deposit|wire)\b"}


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    check: str | None = None
    context: str | None = None
    window: int = 60

    def problems(self) -> list[str]:
        """Why the rule can't be used; empty if it can."""
        out = []
        try:
            if compiled(self.pattern).match("") is not None:
                out.append("matches the empty text")
        except regex.error as e:
            out.append(f"no pattern: {e}")
        if self.check not in (None, *CHECKS):
            out.append(f"unknown check {self.check}")
        if self.context not in (None, *CONTEXTS):
            out.append(f"unknown context {self.context}")
        if not 0 <= self.window <= 500:
            out.append("window is 0 to 500")
        return out


# Identifiers of accounting documents.
PACK = (
    Rule("ssn", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    Rule("ssn-unformatted", r"(?i)(?<=\b(?:SSN|SSNs|social\s+security(?:\s+(?:number|no\.?|#))?|TIN|ITIN)\b[\s\S]{0,40}?)\b\d{9}\b"),
    Rule("ein", r"\b\d{2}[-\s]\d{7}\b"),
    Rule("routing", r"\b\d{9}\b", "aba", "account-vocab", 60),
    Rule("card", r"\b(?:\d[ -]?){12,18}\d\b", "luhn"),
)
MASKED = ("ssn", "ein", "routing", "card", "account")
_VOCABULARY, _BARE = compiled(VOCABULARY), compiled(BARE)
#: What every match of PACK and every bare run holds, within a cell: nine digits, at most one dash or white space between two.
_NINE = rf"(?:[0-9][-{_SPACES}]?){{8}}[0-9]"
_MAY_HOLD = re.compile(_NINE)
#: The same, or a grid's separator, as Arrow writes it.
_MAY_RE2 = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _NINE) + r"|[\x1e\x1f]"
#: For patterns of PACK a quicker one, which is found in every match of theirs. What stands before a number is looked for at each place of a text otherwise.
_QUICK = dict(zip([r.pattern for r in PACK[:4]], [re.compile(p) for p in (rf"[0-9]{{3}}[-{_SPACES}][0-9]{{2}}[-{_SPACES}][0-9]{{4}}", "[0-9]{9}", rf"[0-9]{{2}}[-{_SPACES}][0-9]{{7}}", "[0-9]{9}")], strict=True))


def checked(pack: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The pack, or an error: it is empty, ids repeat, or a rule has a problem. Nothing is shown unscanned."""
    if not pack:
        raise ValueError("a pack without rules would let everything through")
    if len({r.id for r in pack}) < len(pack):
        raise ValueError("rule ids repeat")
    for r in pack:
        if found := r.problems():
            raise ValueError(f"{r.id}: {'; '.join(found)}")
    return pack


def fingerprint(pack: tuple[Rule, ...]) -> str:
    """Tells one set of rules from another, whatever it is called."""
    return hashlib.sha256(json.dumps([asdict(r) for r in pack], sort_keys=True).encode()).hexdigest()


#: The version of what a rule may say. A pack names the least one it needs.
CONTRACT = "1.0.0"


@dataclass(frozen=True)
class Pack:
    """Rules as they were read, under their name and version."""

    id: str
    version: str
    rules: tuple[Rule, ...]


def meets(wanted: str, version: str = CONTRACT) -> bool:
    """Whether ``version`` is what a caret range asks for: of its major number, and no older. Ranges of 0.x mean something else and are refused."""
    asked, there = re.fullmatch(r"\^(\d+)\.(\d+)\.(\d+)", wanted.strip()), re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version)
    if asked is None:
        raise ValueError(f"no caret range like ^1.0.0: {wanted!r}")
    if there is None:
        raise ValueError(f"no version: {version!r}")
    least, have = [int(x) for x in asked.groups()], [int(x) for x in there.groups()]
    if least[0] == 0:
        raise ValueError(f"a range of 0.x: {wanted!r}")
    return have[0] == least[0] and have >= least


def read_pack(spark: SparkSession, folder: str, contract: str = CONTRACT) -> Pack:
    """The pack in a folder's pack.json: {"pack": {id, version, requires}, "rules": [{id, pattern, ignore_case, check, context, window}]}.

    An error if there is none, it says anything else, it needs another contract, or a rule can't be used.
    """
    try:
        found = json.loads(Folder(spark, folder).read("pack.json"))
    except Exception as e:  # py4j hands over any Java exception as one kind
        raise ValueError(f"no pack can be read in {folder}: {str(e).splitlines()[0][:200]}") from None
    if not isinstance(found, dict) or set(found) != {"pack", "rules"} or not isinstance(found["pack"], dict) or set(found["pack"]) != {"id", "version", "requires"}:
        raise ValueError("a pack has pack (id, version, requires) and rules")
    if not meets(found["pack"]["requires"], contract):
        raise ValueError(f"{found['pack']['id']} needs contract {found['pack']['requires']}, this is {contract}")
    rules = []
    for r in found["rules"]:
        if not isinstance(r, dict) or not {"id", "pattern"} <= set(r) <= {"id", "pattern", "ignore_case", "check", "context", "window"}:
            raise ValueError(f"not a rule: {r}")
        rules.append(Rule(r["id"], ("(?i)" if r.get("ignore_case") else "") + r["pattern"], r.get("check"), r.get("context"), r.get("window", 60)))
    return Pack(found["pack"]["id"], found["pack"]["version"], checked(tuple(rules)))


@dataclass(frozen=True)
class Match:
    rule: str
    start: int
    end: int
    high: bool
    sample: str


def scan(text: str, pack: tuple[Rule, ...] = PACK) -> list[Match]:
    """All matches by place, in code points."""
    out = []
    for r in pack:
        if (quick := _QUICK.get(r.pattern)) is not None and quick.search(text) is None:
            continue
        for m in _pattern(r.pattern).finditer(text):
            near = text[max(0, m.start() - r.window) : m.end() + r.window]
            high = (r.check is None or CHECKS[r.check](m[0])) and (r.context is None or _pattern(CONTEXTS[r.context]).search(near) is not None)
            sample = m[0][0] + "X" * (len(m[0]) - 2) + m[0][-1] if len(m[0]) > 2 else "X" * len(m[0])
            out.append(Match(r.id, m.start(), m.end(), high, sample))
    return sorted(out, key=lambda m: m.start)


def kind(rule: str) -> str | None:
    base = rule.split("-")[0]
    return base if base in MASKED else None


def redact(text: str, pack: tuple[Rule, ...] = PACK, dense: int = 3) -> tuple[str, dict[str, int]]:
    """The text with its sure matches masked, and counts by kind. Overlapping matches are one, named by the first; touching ones
    stay two. If the text has identifier words and ``dense`` bare nine-digit runs, all that are left are masked."""
    if pack is PACK and _MAY_HOLD.search(text) is None:
        return text, {}
    spans: list[list] = []
    counts: dict[str, int] = {}
    for m in scan(text, pack):
        if not m.high:
            continue
        if (k := kind(m.rule)) is not None:
            counts[k] = counts.get(k, 0) + 1
        if spans and m.start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], m.end)
        else:
            spans.append([m.start, m.end, m.rule])
    out = text
    for start, end, rule in reversed(spans):
        out = f"{out[:start]}[REDACTED-{(kind(rule) or rule).upper()}]{out[end:]}"
    if _VOCABULARY.search(text) and len(_BARE.findall(text)) >= dense:
        out, n = _BARE.subn("[REDACTED-SSN]", out)
        if n:
            counts["ssn"] = counts.get("ssn", 0) + n
    return out, counts


_CELL, _LINE = "\x1f", "\x1e"


def redact_grid(rows: list[list[str]], pack: tuple[Rule, ...] = PACK) -> tuple[list[list[str]], dict[str, int]]:
    """A grid is redacted as one text, so words of one cell tell another's number; its shape must survive, and no cell may hold a separator."""
    if any(mark in (c or "") for r in rows for c in r for mark in (_CELL, _LINE)):
        raise ValueError("a cell holds a separator")
    flat, counts = redact(_LINE.join(_CELL.join(c or "" for c in r) for r in rows), pack)
    out = [r.split(_CELL) for r in flat.split(_LINE)] if rows else []
    if [len(r) or 1 for r in rows] != [len(r) for r in out]:
        raise ValueError("redaction changed the shape of a table")
    return [[None if was is None else c for was, c in zip(before, after, strict=True)] if before else [] for before, after in zip(rows, out, strict=True)], counts


def redact_tables(tables: list[dict], pack: tuple[Rule, ...] = PACK) -> tuple[list[dict], dict[str, int]]:
    """Tables (headers, rows, and any of markdown, caption, sheet_name) masked, and counts by kind. A table's Markdown shows its
    cells once more, so it is masked and not counted."""
    out, counts = [], Counter()
    for t in tables:
        grid, found = redact_grid([t.get("headers") or [], *(t.get("rows") or [])], pack)
        counts.update(found)
        new = dict(t) | {"headers": grid[0] if t.get("headers") is not None else None, "rows": grid[1:] if t.get("rows") is not None else None}
        for name in ("caption", "sheet_name"):
            if t.get(name) is not None:
                new[name], found = redact(t[name], pack)
                counts.update(found)
        if t.get("markdown") is not None:
            new["markdown"] = redact(t["markdown"], pack)[0]
        out.append(new)
    return out, dict(counts)


def redact_document(title: str | None, markdown: str | None, tables: list[dict] | None, pack: tuple[Rule, ...] = PACK) -> tuple[str | None, str | None, list[dict] | None, dict[str, int]]:
    """A document masked as a whole, and counts by kind: those of its title, and of its text or its tables, whichever has more, as a text
    shows its tables."""
    new_title, in_title = (None, {}) if title is None else redact(title, pack)
    new_text, in_text = (None, {}) if markdown is None else redact(markdown, pack)
    new_tables, in_tables = (None, {}) if tables is None else redact_tables(tables, pack)
    kinds = {*in_title, *in_text, *in_tables}
    return new_title, new_text, new_tables, {k: in_title.get(k, 0) + max(in_text.get(k, 0), in_tables.get(k, 0)) for k in kinds}


def _may_hold(column, names: tuple[str, ...] = ("headers", "rows", "markdown", "caption", "sheet_name")) -> np.ndarray:
    """For each value of an Arrow column whether a string in it may hold what PACK masks, or it may be one that can't be redacted at all."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.match_substring_regex(column, _MAY_RE2).fill_null(False).to_numpy(zero_copy_only=False)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        inner, of = column.flatten(), pc.list_parent_indices(column).to_numpy()
        found = _may_hold(inner, names)
        if pa.types.is_nested(inner.type):  # a row or table that is null is an error
            found = found | inner.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros(len(column), bool)
        out[of[found]] = True
        return out
    if pa.types.is_struct(kind):
        fields = [c for f, c in zip(kind, column.flatten(), strict=True) if f.name in names]
        return reduce(np.logical_or, [_may_hold(c, names) for c in fields], np.zeros(len(column), bool))
    return np.ones(len(column), bool)


def redact_documents(documents: DataFrame, pack: tuple[Rule, ...] | Pack = PACK, title: str = "title", markdown: str = "markdown", tables: str | None = None) -> DataFrame:
    """``documents`` with these columns masked; redaction: counts by kind, null if scanning failed; redaction_pack: the pack's fingerprint.

    tables: a column of arrays of structs with headers, rows and any of markdown, caption, sheet_name; what else a struct has is left as it is. The columns of
    a document that failed are null: nothing of it may be shown.
    """
    rules = checked(pack.rules if isinstance(pack, Pack) else pack)
    mark = fingerprint(rules)
    names, masked = list(documents.columns), [c for c in (title, markdown, tables) if c is not None]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        used = PACK if rules == PACK else rules
        for batch in batches:
            # What can't hold anything is passed on as it came, and only the rest turned into Python's objects.
            given = [None if c is None else batch.column(names.index(c)) for c in (title, markdown, tables)]
            hits = [np.zeros(batch.num_rows, bool) if c is None else _may_hold(c) if used is PACK else np.ones(batch.num_rows, bool) for c in given]
            values = [iter([] if c is None else c.filter(pa.array(h)).to_pylist()) for c, h in zip(given, hits, strict=True)]
            done: list[list | None] = [[]] * batch.num_rows
            new: list[list] = [[], [], []]
            places = [np.arange(batch.num_rows) for _ in given]  # of each value: in the batch, or behind it among the new ones
            for i in np.nonzero(hits[0] | hits[1] | hits[2])[0]:
                try:
                    *masked_, counts = redact_document(*[next(v) if h[i] else None for v, h in zip(values, hits, strict=True)], used)
                    done[i] = sorted(counts.items())
                except Exception:  # noqa: BLE001  fail closed, whatever the reason
                    masked_, done[i] = (None, None, None), None
                for j in range(3):
                    if hits[j][i] or done[i] is None:
                        places[j][i] = batch.num_rows + len(new[j])
                        new[j].append(masked_[j])
            by = {c: pa.concat_arrays([given[j], pa.array(new[j], given[j].type)]).take(pa.array(places[j])) if new[j] else given[j] for j, c in enumerate((title, markdown, tables)) if c is not None}
            arrays = [by[c] if c in masked else batch.column(i) for i, c in enumerate(names)]
            arrays += [pa.array(done, pa.map_(pa.string(), pa.int32())), pa.array([mark] * len(done), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "redaction", "redaction_pack"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{schema}, redaction map<string,int>, redaction_pack string")


def to_scan_again(documents: DataFrame, pack: tuple[Rule, ...] | Pack = PACK) -> DataFrame:
    """Documents that were never redacted, or under other rules, or whose scan failed."""
    mark = fingerprint(pack.rules if isinstance(pack, Pack) else pack)
    return documents.where(F.col("redaction").isNull() | ~F.col("redaction_pack").eqNullSafe(F.lit(mark)))


def downloadable(documents: DataFrame) -> DataFrame:
    """Documents whose original may be handed out: it is stored, and scanning found nothing to mask. Nothing is handed out unscanned."""
    masked = F.aggregate(F.map_values("redaction"), F.lit(0), lambda a, n: a + n)
    return documents.where(F.col("storage_key").isNotNull() & F.coalesce(masked == 0, F.lit(False)))


def scan_target(title: Column, markdown: Column, tables: Column) -> Column:
    """What a semantic scan reads: title, text and tables, blanks left out."""
    parts = F.concat(F.array(title, markdown), F.coalesce(tables, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: F.length(F.trim(F.coalesce(p, F.lit("")))) > 0), "\n")


def scan_windows(documents: DataFrame, text: str = "target", chars: int = 8000, most: int = 24) -> DataFrame:
    """document_id, window, text: stretches for a model to judge; an error for a document of more than ``most``."""
    n = F.ceil(F.length(text) / chars)
    ok = F.when(n > most, F.raise_error(F.lit(f"more than {most} windows"))).otherwise(n)
    rows = documents.select("document_id", text, F.explode(F.sequence(F.lit(0), F.greatest(ok - 1, F.lit(0)))).alias("window"))
    return rows.select("document_id", "window", F.substring(F.col(text), F.col("window").cast("int") * chars + 1, F.lit(chars)).alias("text"))


def verdicts(judged: DataFrame) -> DataFrame:
    """document_id, flagged, categories of judged windows (document_id, flagged, categories)."""
    return judged.groupBy("document_id").agg(F.bool_or("flagged").alias("flagged"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))


def generation_screen(passages: DataFrame, policy: str = "warn") -> DataFrame:
    """Passages without those that hold an identifier (any policy but off) or, under "block", any label; with labels."""
    if policy not in ("block", "warn", "off"):
        raise ValueError(policy)
    rows = passages
    if policy != "off":  # only the patterns that decide are looked for here, the others in what stays
        decide = [p for label, p in TAXPAYER_PATTERNS if policy == "block" or label in IDENTIFYING]
        rows = rows.where(~F.coalesce(reduce(Column.__or__, [F.col("text").rlike(ascii_bounds(p)) for p in decide]), F.lit(False)))
    return rows.withColumn("labels", taxpayer_labels(F.col("text")))


def extraction_gate(documents: DataFrame, flags: DataFrame, decisions: DataFrame, signed_off_by: str | None, fingerprint: str | None, expected: str) -> DataFrame:
    """Documents that may be used for extraction: the screen is signed, made of this corpus, and each flag decided one way.

    flags: document_id. decisions: document_id, include. Excluded documents are left out.
    """
    if not signed_off_by:
        raise ValueError("nobody has signed the screen off")
    if fingerprint != expected:
        raise ValueError("the screen was made of another corpus")
    decided = decisions.groupBy("document_id").agg(F.min("include").alias("least"), F.max("include").alias("most"))
    open_ = flags.select("document_id").distinct().join(decided, "document_id", "left").where("least is null or least <> most")
    if not open_.isEmpty():
        raise ValueError("flags are undecided, or decided both ways")
    return documents.join(decided.where("not most").select("document_id"), "document_id", "left_anti")
