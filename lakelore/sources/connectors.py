"""Incremental document sources as Spark data sources.

``ChangeFeed`` reads a feed of pages: JSON files ``page-00000.json``, ``page-00001.json``, ... in a folder, as an exporter
lands them. Each page holds ``items``: documents (external_id, title, modified_at, mime_type, content, metadata), tombstones
(external_id, deleted) and oversized ones (external_id, skipped); and, if the exporter tells them, the ``cursor`` it was asked with, the
``next`` one, and whether it is ``done``. A batch read takes the whole feed; a stream takes a number of pages a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Pages of a run, before a continuation takes the next ones; bytes of a document, at most.
PAGES_PER_RUN, MAX_BYTES = 5, 25 << 20
DOCUMENTS = "external_id string, title string, modified_at string, mime_type string, content binary, metadata string, change string, position long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[str]:
    from pyarrow import fs

    own, at = _fs(path)
    return sorted(i.path for i in own.get_file_info(fs.FileSelector(at)) if re.search(r"/page-\d+\.json$", i.path))


def _page(path: str, name: str) -> dict:
    own, _ = _fs(path)
    with own.open_input_stream(name) as f:
        return json.loads(f.read())


def _row(item: dict, limit: int, page: int, place: int) -> tuple:
    content = item.get("content")
    data = content.encode() if content is not None else None
    change = "deleted" if item.get("deleted") else "skipped" if item.get("skipped") or data is not None and len(data) > limit else "upserted"
    keep = change == "upserted"
    return (item["external_id"], item.get("title"), item.get("modified_at"), item.get("mime_type"), data if keep else None, json.dumps(item.get("metadata") or {}, sort_keys=True), change, page << 32 | place)


@dataclass
class _Page(InputPartition):
    name: str
    number: int


class _Batch(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self) -> list[_Page]:
        return [_Page(p, i) for i, p in enumerate(_pages(self.path))] or [_Page("", 0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for i, item in enumerate(_page(self.path, partition.name)["items"] if partition.name else ()):
            yield _row(item, self.limit, partition.number, i)


class _PageNames(SimpleDataSourceStreamReader):
    """Names of the next pages; an offset is the number of pages handed over. Nothing of a page is read here."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names = _pages(self.path)[start["page"] :][: self.most]
        return self.readBetweenOffsets(start, end := {"page": start["page"] + len(names)}), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(name, start["page"] + i) for i, name in enumerate(_pages(self.path)[start["page"] : end["page"]])])


class FeedPages(DataSource):
    """spark.readStream.format("lakelore-feed-pages"): name, page of each landed page; options path, maxPages a batch."""

    @classmethod
    def name(cls) -> str:
        return "lakelore-feed-pages"

    def schema(self) -> str:
        return "name string, page long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _PageNames(self.options["path"], int(self.options.get("maxPages", PAGES_PER_RUN)))


class ChangeFeed(DataSource):
    """spark.read.format("lakelore-feed"): options path, maxBytes (larger documents are skipped)."""

    @classmethod
    def name(cls) -> str:
        return "lakelore-feed"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("maxBytes", MAX_BYTES)))


def stream_feed(spark: SparkSession, path: str, max_pages: int = PAGES_PER_RUN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A streamed feed, ``max_pages`` pages a batch: the rows of ChangeFeed, and per page a row of change "page" behind its others.

    The driver tells the pages' names; each page is read by the task that it is dealt to. The metadata of a "page" row are the page's own: its
    cursor, the next one, whether it is the last, how many items it holds.
    """
    spark.dataSource.register(FeedPages)
    pages = spark.readStream.format(FeedPages.name()).option("path", path).option("maxPages", max_pages).load()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("external_id", pa.string()), ("title", pa.string()), ("modified_at", pa.string()), ("mime_type", pa.string()), ("content", pa.binary()), ("metadata", pa.string()), ("change", pa.string()), ("position", pa.int64())])
        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = _page(path, name)
                about = {k: page.get(k) for k in ("cursor", "next", "done")} | {"items": len(page["items"])}
                rows = [_row(item, max_bytes, number, i) for i, item in enumerate(page["items"])]
                rows.append((None, None, None, None, None, json.dumps(about), "page", number << 32 | 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.repartition(max_pages, "page").mapInArrow(run, DOCUMENTS)


#: Kinds of source and how each is read. Hosted ones land their change feed in files first.
KINDS = ("sharepoint", "gdrive", "gmail", "outlook", "git-markdown", "xml", "custom")


def read_source(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Documents of a source; an unknown kind is an error."""
    if kind in ("sharepoint", "gdrive", "gmail", "outlook"):
        spark.dataSource.register(ChangeFeed)
        return spark.read.format(ChangeFeed.name()).options(path=path, **options).load()
    if kind == "git-markdown":
        return markdown_files(spark, path)
    if kind == "xml":
        return xml_sections(spark, path, options.get("rowTag", "DIV8"))
    if kind == "custom":
        return uploads(spark, path)
    raise ValueError(f"unknown kind of source: {kind}")


def excluded_as_deleted(feed: DataFrame, path: Column) -> DataFrame:
    """Documents under an excluded path leave as deletions, so an earlier copy goes too."""
    from ..operators.ingest import excluded_by

    out = excluded_by(path).isNotNull() & (F.col("change") == "upserted")
    return feed.withColumn("change", F.when(out, "deleted").otherwise(F.col("change"))).withColumn("content", F.when(F.col("change") == "upserted", F.col("content")))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """external_id (path), content, front_matter (map of its plain lines), markdown, hash of every .md file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    text = F.decode("content", "utf-8")
    front = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return files.select(
        F.col("path").alias("external_id"), "content", F.map_from_entries(F.array_distinct(pairs)).alias("front_matter"),
        F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("markdown"), F.sha2("content", 256).alias("hash"),
    )


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """external_id, change (upserted or deleted) between two listings (external_id, hash)."""
    a, b = before.select("external_id", F.col("hash").alias("was")), now.select("external_id", "hash")
    both = a.join(b, "external_id", "full").where(~F.col("was").eqNullSafe(F.col("hash")))
    return both.select("external_id", F.when(F.col("hash").isNull(), "deleted").otherwise("upserted").alias("change"))


def xml_sections(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """external_id (attribute N), title (HEAD), text of each section with that tag."""
    schema = "_N string, HEAD string, P array<string>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    return rows.select(F.col("_N").alias("external_id"), plain(F.col("HEAD")).alias("title"), F.array_join(F.transform(F.coalesce("P", F.array().cast("array<string>")), plain), "\n\n").alias("text"))


def changed_since(rows: DataFrame, modified_at: str, last: str | None) -> DataFrame:
    """Nothing if a document of one part hasn't changed since the last run."""
    return rows.where(F.lit(False)) if last is not None and modified_at <= last else rows


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """external_id, content, size_bytes of staged files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("external_id"), "content", F.col("length").alias("size_bytes"))


def route(name: Column, mime: Column, size: Column, limit: int = 25 << 20) -> Column:
    """Which parser takes a file: spreadsheet, separated, general; or empty, too_large."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    sheet = ending.isin("xlsx", "xls", "xlsm") | mime.rlike("spreadsheetml|ms-excel")
    separated = ending.isin("csv", "tsv") | mime.isin("text/csv", "text/tab-separated-values")
    return F.when(size == 0, "empty").when(size > limit, "too_large").when(separated, "separated").when(sheet, "spreadsheet").otherwise("general")


def storage_key(source_id: Column, document_id: Column, name: Column) -> Column:
    """Where an original is kept: by source, then document; the name made safe."""
    from ..functions.text import download_name

    return F.concat_ws("/", source_id, document_id, download_name(name))


def allowed_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL leads to one of these hosts."""
    from ..functions.text import host

    return F.coalesce(host(url).isin(*[h.lower() for h in hosts]), F.lit(False))
