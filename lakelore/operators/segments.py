"""What the stored indexes share: segments of chunks that a commit log names, chunks taken out again, and how a batch is counted."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.commits import CommitLog

#: A table with so many cells is broadcast, if it has been counted.
FEW = 600_000


def if_few(small: DataFrame, cells: int) -> DataFrame:
    """A settled table, to be broadcast to a join if it is counted and small."""
    return F.broadcast(small) if small.count() * cells <= FEW else small


class Segments:
    """Folders of rows, each added by one commit, and ids taken out: those of rows that were added before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def live(self) -> list[dict]:
        """Entries of the segments that count: the newest merge, and what was added since it read the others."""
        entries = self.log.entries()
        return [e for i, e in enumerate(entries) if e["kind"] == "segment" or e["kind"] == "merged" and i == 0]

    def _added(self, rows: DataFrame, name: str, partition_by: tuple[str, ...], writer: str | None, batch: int | None, beside: tuple[str, ...] = (), **about: object) -> int | None:
        """beside: folders that were written for the segment, besides that of ``rows``."""
        folder = self.log.write(rows, name, partition_by)
        return self.log.commit({"kind": "segment", "folders": [folder, *beside], "schema": rows.schema.json()} | about, writer, batch)

    def _merged(self, rows: DataFrame, name: str, partition_by: tuple[str, ...], covers: int, beside: tuple[str, ...] = (), **about: object) -> int | None:
        """rows: those of all segments up to ``covers``, without what was taken out by then."""
        folder = self.log.write(rows, name, partition_by)
        entry = {"kind": "merged", "snapshot": True, "covers": covers, "folders": [folder, *beside], "schema": rows.schema.json(), "batches": self.log.batches(self.log.entries(covers))}
        return self.log.commit(entry | about)

    def removed(self) -> DataFrame | None:
        """chunk_id, upto: rows of chunk_id in segments below that version don't count. None if nothing was taken out."""
        gone = [e for e in self.log.entries() if e["kind"] == "removed"]
        out = None
        for e in gone:
            rows = self.spark.read.parquet(f"{self.log.path}/{e['folders'][0]}").select("chunk_id", F.lit(e["version"]).alias("upto"))
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.groupBy("chunk_id").agg(F.max("upto").alias("upto"))

    def remove(self, chunk_ids: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
        """Take chunks out; a chunk that is added later counts again."""
        if self.log.committed(writer, batch):
            return None
        folder = self.log.write(chunk_ids.select("chunk_id").distinct(), "removed")
        return self.log.commit({"kind": "removed", "folders": [folder]}, writer, batch)

    def still_there(self, rows: DataFrame, version: str = "segment") -> DataFrame:
        """Rows of chunk_id and the version of their segment without those taken out later."""
        gone = self.removed()
        if gone is None:
            return rows
        gone = gone.withColumnRenamed("chunk_id", "__gone")
        return rows.join(gone, (F.col("chunk_id") == F.col("__gone")) & (F.col(version) < F.col("upto")), "left_anti")

    def scan(self, segments: list[dict], columns: list[Column | str], keep: Column | None = None) -> DataFrame:
        """Rows of segments with segment: the version up to which they know what was taken out."""
        out = None
        for e in segments:
            one = self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.log.path}/{e['folders'][0]}")
            one = (one if keep is None else one.where(keep)).select(*columns, F.lit(e.get("covers", e["version"])).cast("long").alias("segment"))
            out = one if out is None else out.unionByName(one)
        return out
