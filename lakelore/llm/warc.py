"""Operator 11: WARC archives, written with revisits and read by a reader that salvages.

Writing: each row becomes a record of its own, in files of a bounded size under names of the task's own attempt; only
files of the manifest count, so lost and repeated tasks do no harm. Of rows with equal payloads of ``least`` bytes or more one is
the response, the others are revisits that name it and hold no payload. Equal means of equal SHA-256; digests are
summed up before they are shuffled, and the rows of a hot payload stay in the tasks they are in.

Reading: a record, or the gzip member that holds it, is checked whole: version line, header, length, end mark, the member's own
checksum, digests of block and payload. After a failed check the reader looks for the next place at which a record or member
begins and passes as one, goes on there, and logs the bytes between as a gap. Where a record's frame is whole and only its
content is damaged, the gap is that record alone. A file is one task that holds one record at a time. Within a damaged record whose
end can't be told, an archive that was its payload is taken for what follows: nothing tells them apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import identified, if_few, join_one, settle, shared_dir, shared_fs, worker_memory

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of a record's header, at most, and of what is read from a file at once.
_HEAD, _CHUNK = 64 << 10, 1 << 20
_END = b"\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- writing ------------------------------------------------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(uri: str) -> str:
    """A URI without white space and control characters, which would break a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + _END


def _record_id(row: dict) -> str:
    return str(uuid.UUID(bytes=hashlib.md5(f"{row['file']}:{row['row']}".encode()).digest()))


def page_record(row: dict, page_id: int | None, url: str | None, payload: bytes, first: dict | None, date: str) -> bytes:
    """One page as a response, or as a revisit of ``first`` (page_id, row, url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Target-URI", None if url is None else _safe(url)), ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", _digest(payload)), ("Content-Type", "application/http;msgtype=response"),
    ]
    if first is None:
        return _record("response", _record_id(row), date, fields, http + payload)
    fields += [
        ("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:uuid:{_record_id(first['row'])}>"), ("WARC-Refers-To-Date", date),
        ("WARC-Refers-To-Target-URI", None if first["url"] is None else _safe(first["url"])), ("WARC-Refers-To-Page-ID", first["page_id"]),
    ]
    return _record("revisit", _record_id(row), date, fields, http)


def _firsts(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with first: the row that a revisit refers to, null for responses. Digests travel, and payloads only where revisits are many."""
    keys = rows.where(F.octet_length("payload") >= least).select("__row", "page_id", "url", F.unhex(F.sha2("payload", 256)).alias("key"))
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("__row").alias("row"), "url")).alias("best")
    groups = settle(keys.groupBy("key").agg(F.count("*").alias("n"), best).where("n > 1"))
    found = join_one(keys.select("__row", "key"), groups, ["key"]).where(F.col("best.row") != F.col("__row"))
    revisits = settle(found.select("__row", F.struct("best.page_id", "best.row", "best.url").alias("first")))
    return rows.join(if_few(revisits, 5 + F.coalesce(F.length("first.url"), F.lit(0)) / 8), "__row", "left")


def write(
    pages: DataFrame, out: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, bytes_per_file: int = 64 << 20,
    compress: bool = True, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of ``pages``, payload ``html`` in UTF-8 (null: empty), as files of about ``bytes_per_file`` bytes.

    Returns the manifest: path, n_records (without the warcinfo that begins a file), n_bytes. Of equal payloads of ``least`` bytes or
    more the row with the greatest page_id (null least), then the last such row, is the response. Null page_ids and urls are left out of the
    record and read as null; repeated rows are a record each; a payload of any length lies in one record. No rows: no files, an
    empty manifest. Other columns don't matter, whatever their names.
    """
    spark = pages.sparkSession
    out = out or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, at = shared_fs(out)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = identified(pages, {"page_id": F.col(f"`{page_id}`").cast("long"), "url": F.col(f"`{url}`"), "payload": payload})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, folder = shared_fs(out)
        file, name, n, size = None, "", 0, 0
        pack = (lambda b: zlib.compress(b, 6, 31)) if compress else bytes

        def close() -> pa.RecordBatch:
            nonlocal file
            file.close()
            file = None
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [size]})

        with worker_memory("warc"):
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    for r in batch.slice(at, 100).to_pylist():
                        if file is None:
                            name, n = f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * compress, 0
                            file = own.open_output_stream(name, compression=None)
                            data = pack(_record("warcinfo", str(uuid.uuid4()), date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                            file.write(data)
                            size = len(data)
                        data = pack(page_record(r["__row"], r["page_id"], r["url"], r["payload"], r["first"], date))
                        file.write(data)
                        n, size = n + 1, size + len(data)
                        if size >= bytes_per_file:
                            yield close()
            if file is not None:
                yield close()

    return settle(_firsts(rows, least).mapInArrow(run, "path string, n_records long, n_bytes long"))


# ---- reading ------------------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A failed check. end: where what failed ends, if its frame is whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


@dataclass
class Record:
    """A record and its member's place in the file."""

    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int
    payload_digest: str | None


@dataclass
class Gap:
    """Bytes that no record could be read from."""

    offset: int
    length: int
    reason: str


class Window:
    """A file's bytes by place, of which one chunk is held."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from ``at``, fewer at the end."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, _CHUNK), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, mark: bytes, at: int) -> int | None:
        """The first place of ``mark`` from ``at``."""
        while at < self.size:
            some = self.get(at, _CHUNK)
            if (k := some.find(mark)) >= 0:
                return at + k
            if at + len(some) >= self.size:
                return None
            at += len(some) - len(mark) + 1
        return None


class Held(Window):
    """Bytes in memory in the same form."""

    def __init__(self, data: bytes):
        self.size, self.at, self.held = len(data), 0, data


def _hex(digest: str) -> str | None:
    """A sha1 digest, written in base 32 or 16, in lower-case hex; null for another algorithm."""
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        raise Damaged("digest can't be read") from None


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on with the field before
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("header line without a name")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _checked(fields: dict[str, str], block: bytes) -> tuple[bytes, int, str | None]:
    """payload, its bytes and its digest, if block and payload are those that the header tells."""
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("record without a type or id")
    told = _hex(fields["warc-block-digest"]) if "warc-block-digest" in fields else None
    if told is not None and hashlib.sha1(block).hexdigest() != told:
        raise Damaged("block digest differs")
    told = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
    payload, http = block, b""
    if fields.get("content-type", "").lower().startswith("application/http"):
        k = block.find(_END)
        if k < 0:
            raise Damaged("HTTP header without an end")
        http, payload = block[: k + 4], block[k + 4 :]
    if fields["warc-type"] == "revisit":
        length = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", http)
        return payload, int(length[1]) if length else len(payload), told
    found = hashlib.sha1(payload).hexdigest()
    if told is not None and "warc-truncated" not in fields and found != told:
        raise Damaged("payload digest differs")
    return payload, len(payload), found


def _plain(source: Window, at: int, most: int) -> Record:
    """The record that begins at ``at``."""
    head = source.get(at, _HEAD)
    if not _VERSION.match(head):
        raise Damaged("no version line")
    stop = head.find(_END)
    if stop < 0:
        raise Damaged("header without an end")
    fields = _fields(head[:stop])
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damaged("no content length")
    n, begin = int(fields["content-length"]), at + stop + 4
    end = begin + n + 4
    if end > source.size:
        raise Damaged("record is cut short")
    if source.get(begin + n, 4) != _END:
        raise Damaged("record without an end mark")
    framed = end == source.size or _VERSION.match(source.get(end, 16))
    if n > most:
        raise Damaged(f"record of more than {most} bytes", end if framed else None)
    try:
        return Record(at, end - at, fields, *_checked(fields, source.get(begin, n)))
    except Damaged as e:
        raise Damaged(e.reason, end if framed else None) from None


def _member(source: Window, at: int, most: int, early: bool = False) -> list[Record]:
    """The records of the gzip member that begins at ``at``. early: give up as soon as it doesn't begin with a version line."""
    unpack, parts, size, where = zlib.decompressobj(31), [], 0, at
    while not unpack.eof:
        some = source.get(where, 1 << 16)
        if not some:
            raise Damaged("member is cut short")
        try:
            parts.append(unpack.decompress(some, most + _HEAD - size + 1))
        except zlib.error:
            raise Damaged("member is damaged") from None
        size, where = size + len(parts[-1]), where + len(some)
        if size > most + _HEAD:
            raise Damaged(f"member of more than {most} bytes")
        if early and size >= 16:
            if not _VERSION.match(b"".join(parts)):
                raise Damaged("no version line")
            early = False
    end = where - len(unpack.unused_data)
    data, records, k = Held(b"".join(parts)), [], 0
    try:
        while k < data.size or not records:
            records.append(_plain(data, k, most))
            k += records[-1].length
    except Damaged as e:
        raise Damaged(e.reason, end) from None
    for r in records:
        r.offset, r.length = at, end - at
    return records


def salvage(source: Window, gzip: bool, most: int = 1 << 30) -> Iterator[Record | Gap]:
    """Records and gaps of a file in its order; together their places cover it. most: bytes of a record, at most."""
    mark = b"\x1f\x8b\x08" if gzip else b"WARC/1."
    read = (lambda at, early=False: _member(source, at, most, early)) if gzip else (lambda at, early=False: [_plain(source, at, most)])

    def begins(at: int) -> int:
        """The next place from ``at`` at which a record or member passes, or at least has a whole frame."""
        while (at := source.find(mark, at)) is not None:
            try:
                read(at, True)
                return at
            except Damaged as e:
                if e.end is not None:
                    return at
            at += 1
        return source.size

    at = 0
    while at < source.size:
        try:
            found = read(at)
        except Damaged as e:
            end = e.end or begins(at + 1)
            yield Gap(at, end - at, e.reason)
            at = end
            continue
        yield from found
        at += found[-1].length


_SCHEMA = (
    "path string, offset long, length long, error string, record_id string, record_type string, url string, date string, page_id long, refers_to long, "
    "refers_to_id string, payload_bytes long, payload_digest string"
)


def _row(path: str, x: Record | Gap) -> dict:
    if isinstance(x, Gap):
        return {"path": path, "offset": x.offset, "length": x.length, "error": x.reason}
    f = x.fields
    number = lambda k: int(f[k]) if re.fullmatch(r"-?\d{1,19}", f.get(k, "")) else None
    return {
        "path": path, "offset": x.offset, "length": x.length, "record_id": f["warc-record-id"].strip("<>"), "record_type": f["warc-type"], "url": f.get("warc-target-uri"),
        "date": f.get("warc-date"), "page_id": number("warc-page-id"), "refers_to": number("warc-refers-to-page-id"), "refers_to_id": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
        "payload_bytes": x.payload_bytes, "payload_digest": x.payload_digest, "payload": x.payload,
    }


def read(spark: SparkSession, files: DataFrame, with_payload: bool = False, most: int = 1 << 30) -> DataFrame:
    """A row per record of ``files`` (path; others don't matter), and one per gap: its error says which check failed.

    path, offset, length (of the record or its member in the file), error (null for records), record_id, record_type, url, date,
    page_id, refers_to, refers_to_id, payload_bytes, payload_digest (SHA-1 in hex, of a revisit that of the full payload), and
    payload on request. Whether a file holds gzip members is told by its name or first bytes. No files: no rows; an empty file
    has none; a file named twice is read twice; a null path is an error.
    """
    root = shared_dir(spark)
    schema = _SCHEMA + ", payload binary" * with_payload

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        with worker_memory("warc"):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    own, at = shared_fs(path) if ":" in path.split("/")[0] else (shared_fs(root)[0], path)
                    rows, held = [], 0
                    with own.open_input_file(at) as f:
                        source = Window(f)
                        for x in salvage(source, path.endswith(".gz") or source.get(0, 2) == b"\x1f\x8b", most):
                            rows.append(_row(path, x))
                            held += len(rows[-1].get("payload", b"")) if with_payload else 0
                            if not with_payload:
                                rows[-1].pop("payload", None)
                            if len(rows) >= 2000 or held >= 4 << 20:
                                yield table(rows)
                                rows, held = [], 0
                    if rows:
                        yield table(rows)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(run, schema)


def records(found: DataFrame) -> DataFrame:
    """The records of what read() gives."""
    return found.where("error is null").drop("error")


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: path, offset, length, error."""
    return found.where("error is not null").select("path", "offset", "length", "error")


def digests(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages read back."""
    kept: Column = F.col("record_type").isin("response", "revisit")
    return records(found).where(kept).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
