"""Streams: shipping the audit log, and documents taken in page by page.

Progress is the stream's checkpoint, so rows of one time stamp that come later are not skipped, as they would be by a
watermark in a table. A batch that is run again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, ingest
from ..sources.commits import CommitLog, Folder
from ..sources.connectors import PAGES_PER_RUN, stream_feed


def ship_audit_log(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of a streamed log to ``sink``, oldest first and without texts; at least once, by batch number."""
    columns = [c for c in audit.SHIPPABLE if c in log.columns]

    def ship(batch: DataFrame, n: int) -> None:
        sink(batch.select(*columns).orderBy("created_at", "id"), n)

    return log.writeStream.foreachBatch(ship).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def json_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes batch n to its own folder, so shipping it twice changes nothing; its files, by name, follow the batch's order."""
    return lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}")


class DocumentTable:
    """Documents as a base and what has changed since, all named by a commit log.

    Changes since a base are put together in one folder when there are many of them, and a new base is written once they are half as many
    as its rows; so taking in a feed costs in proportion to it, whatever the size of its batches. Putting together is a commit of its own that
    says how far it reaches: changes that come meanwhile stay valid.
    """

    #: So many folders of changes are put together.
    FRESH = 64

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema, self.log = spark, schema, CommitLog(spark, path)
        self.columns = list(spark.createDataFrame([], schema).columns)

    def version(self, upto: int | None = None) -> int | None:
        """The newest version."""
        return max((v for v in self.log.versions() if upto is None or v <= upto), default=None)

    def _state(self, version: int | None) -> tuple[str | None, int, list[dict]]:
        """The base's folder and rows, and the changes since: folder, rows, and version where all rows have the same."""
        base, rows, changes = None, 0, []
        for e in self.log.entries(version):
            if e.get("snapshot"):
                if not changes and base is None:
                    base, rows, changes = e["base"], e["base_rows"], list(e["changes"])
            else:
                changes.append({"folder": e["folders"][0], "rows": e["rows"], "version": e["version"]})
        return base, rows, changes

    def _rows(self, changes: list[dict]) -> DataFrame:
        """Changes with their versions: those of a fresh folder have the version of its entry."""
        return self.log.rows([c["folder"] for c in changes], f"{self.schema}, deleted boolean", {c["folder"]: c["version"] for c in changes if c.get("version") is not None})

    def read(self, version: int | None = None) -> DataFrame:
        """The documents as of a version: of each the newest change, or the base. A document keeps its lifecycle until it is deleted."""
        folder, _, changes = self._state(version)
        base = self.spark.read.schema(self.schema).parquet(f"{self.log.path}/{folder}") if folder else self.spark.createDataFrame([], self.schema)
        if not changes:
            return base
        key = ["source_id", "external_id"]
        newest = self._rows(changes).groupBy(*key).agg(F.max_by(F.struct("deleted", *[c for c in self.columns if c not in key]), "version").alias("new"), F.bool_or("deleted").alias("was_deleted"), F.min_by("lifecycle_status", "version").alias("first"))
        kept = base.join(newest.select(*key), key, "left_anti")
        before = newest.join(base.select(*key, F.col("lifecycle_status").alias("before")), key, "left").where("not new.deleted")
        lifecycle = F.coalesce(F.when(~F.col("was_deleted"), F.coalesce("before", "first")), F.col("new.lifecycle_status")).alias("lifecycle_status")
        return kept.unionByName(before.select(*[lifecycle if c == "lifecycle_status" else F.col(c) if c in key else F.col(f"new.{c}") for c in self.columns]))

    def append(self, changes: DataFrame, batch: int | None = None, writer: str = "feed", **about: object) -> int | None:
        """Commit changes (the table's columns and deleted, one row per document); the version, or None for a batch that is there already.

        about: more for the log entry.
        """
        if self.log.committed(writer, batch):
            return None
        folder = self.log.write(changes.select(*self.columns, F.col("deleted").cast("boolean").alias("deleted"), F.lit(None).cast("long").alias("version")), "changes")
        version = self.log.commit({"kind": "changes", "folders": [folder], "rows": self._count(folder)} | about, writer, batch)
        _, rows, waiting = self._state(None)
        if 2 * sum(c["rows"] for c in waiting) >= rows:
            self.compact()
        elif sum(c.get("version") is not None for c in waiting) >= self.FRESH:
            self.compact(base=False)
        return version

    def _count(self, folder: str) -> int:
        return self.spark.read.parquet(f"{self.log.path}/{folder}").count()  # from the files' footers

    def compact(self, base: bool = True) -> int | None:
        """Write a new base, or put the changes since the last one together. The version of the commit."""
        upto = self.version()
        if upto is None:
            return None
        folder, rows, changes = self._state(upto)
        if base:
            folder, changes = self.log.write(self.read(upto), "base"), []
            rows = self._count(folder)
        else:
            older = [c for c in changes if c.get("version") is None]
            older, some = ([], changes) if len(older) >= self.FRESH else (older, [c for c in changes if c.get("version") is not None])
            if some:
                new = self.log.write(self._rows(some), "changes")
                older.append({"folder": new, "rows": self._count(new)})
            changes = older
        entry = {"kind": "snapshot", "snapshot": True, "covers": upto, "base": folder, "base_rows": rows, "changes": changes, "batches": self.log.batches(self.log.entries(upto))}
        return self.log.commit(entry | {"folders": [f for f in (folder, *[c["folder"] for c in changes]) if f]})

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> list[str]:
        """Delete what the ``keep`` newest versions don't need; see CommitLog.vacuum."""
        return self.log.vacuum(keep, grace)


class Stalled(RuntimeError):
    """A feed says that there is more, but its cursor stays where it is."""


def advanced(pages: list[dict]) -> bool:
    """Whether a run's pages, in their order, moved the cursor or ended the feed; True where the feed tells no cursors."""
    told = [p for p in pages if p.get("next") is not None or p.get("cursor") is not None]
    return not told or bool(told[-1].get("done")) or told[-1].get("next") != told[0].get("cursor")


def take_in(feed: DataFrame, table: DocumentTable, source_id: str, checkpoint: str, most_runs: int = 100_000, **trigger: object) -> StreamingQuery:
    """Merge a streamed change feed into a table: the last change of a document in a batch counts (by its position in the feed),
    deletions take it out, skipped ones leave what is there.

    A batch is a run of some pages, and the next batch its continuation; by default one run is made (see sync() for all). The offset is kept only once the batch is
    committed, and a batch that runs again is committed once. A run of pages that leaves the cursor where it was, though there is said to be more, fails
    with Stalled, as does one beyond ``most_runs``; its documents are in the table.
    """
    writer: list[str] = []

    def merge(batch: DataFrame, n: int) -> None:
        if not writer:  # the stream's own id: another checkpoint counts its batches anew
            writer.append(json.loads(Folder(table.spark, checkpoint).read("metadata"))["id"])
        text = F.decode("content", "utf-8")
        kept = batch.persist()
        try:
            pages = [json.loads(r.metadata) for r in kept.where("change = 'page'").orderBy("position").select("metadata").collect()]  # one a page of the run
            last = kept.where("change in ('upserted', 'deleted')").groupBy("external_id").agg(F.max_by(F.struct("change", "title", text.alias("markdown")), "position").alias("r"))
            changes = last.select(
                F.lit(source_id).alias("source_id"), "external_id", "r.title", ingest.content_hash(F.col("r.markdown")).alias("content_hash"), "r.markdown",
                F.lit("active").alias("lifecycle_status"), (F.col("r.change") == "deleted").alias("deleted"),
            )
            table.append(changes, n, writer[0], source=source_id, pages=len(pages), items=sum(p.get("items") or 0 for p in pages), done=bool(pages and pages[-1].get("done")))
        finally:
            kept.unpersist()
        if not advanced(pages):
            raise Stalled(f"{source_id}: after {len(pages)} pages the cursor is still {pages[0].get('cursor')}")
        if n >= most_runs:
            raise Stalled(f"{source_id}: more than {most_runs} runs")

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sync(spark: SparkSession, path: str, table: DocumentTable, source_id: str, checkpoint: str, max_pages: int = PAGES_PER_RUN, most_runs: int = 100_000) -> list[dict]:
    """Take a landed feed in, a run of ``max_pages`` pages after another, until no page is left; the log's entries of these runs."""
    last = table.version()
    query = take_in(stream_feed(spark, path, max_pages), table, source_id, checkpoint, most_runs, processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [e for v in table.log.versions() if (last is None or v > last) and (e := table.log.entry(v)).get("source") == source_id]


def tumbling_counts(log: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Questions per endpoint and window of time; rows later than ``late`` are left out."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", width), "endpoint").agg(F.count("*").alias("n"))
