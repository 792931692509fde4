"""Claims of staged uploads that several workers take at once.

Claims are entries of a commit log, each with a folder of the ids it takes. A worker reads the log, picks the oldest uploads that are free
as of it, and commits only if no other entry has come meanwhile; else it picks again. So no upload goes to two workers, and none is lost:
a claim whose lease has run out without being finished is free again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.commits import CommitLog, retried


class Claims:
    """uploads: id, source_id, created_at and more. Times are seconds, from one clock."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 900.0):
        self.spark, self.log, self.lease = spark, CommitLog(spark, path), lease

    def _ids(self, folder: str) -> DataFrame:
        return self.spark.read.schema("id long").parquet(f"{self.log.path}/{folder}")

    def _put(self, ids: DataFrame, kind: str, worker: str, until: float | None, read_at: int) -> DataFrame:
        """Commit ids, unless another entry came meanwhile."""
        facts = {"kind": F.lit(kind), "worker": F.lit(worker), "until": F.lit(until).cast("double"), "version": F.lit(None).cast("long")}
        folder = self.log.write(ids.select("id").withColumns(facts), kind)
        self.log.commit({"kind": kind, "folders": [folder]}, read_at=read_at)
        return self._ids(folder)

    def _taken(self, now: float, upto: int | None = None) -> DataFrame:
        """id, status, worker, until: ingested, or claimed under a lease that holds. Of an upload's claims the last counts."""
        entries = self.log.entries(upto)
        out = self.log.rows([e["folders"][0] for e in entries], "id long, kind string, worker string, until double", {e["folders"][0]: e["version"] for e in entries})
        last = out.groupBy("id").agg(F.max_by(F.struct("worker", "until"), "version").alias("r"), F.bool_or(F.col("kind") == "finished").alias("finished"))
        status = F.when(F.col("finished"), "ingested").when(F.col("r.until") > now, "claimed")
        return last.select("id", status.alias("status"), "r.worker", "r.until").where("status is not null")

    def uploads(self, uploads: DataFrame, now: float) -> DataFrame:
        """``uploads`` with status (pending, claimed or ingested) and worker."""
        return uploads.drop("status", "worker").join(self._taken(now).select("id", "status", "worker"), "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))

    def claim(self, uploads: DataFrame, n: int, worker: str, now: float, source_id: str | None = None) -> DataFrame:
        """Take the n oldest free uploads (of a source): id and the rest of their rows."""
        some = uploads if source_id is None else uploads.where(F.col("source_id") == source_id)

        def attempt() -> DataFrame:
            read_at = max(self.log.versions(), default=-1)
            taken = self._taken(now, read_at)
            return self._put(some.join(taken, "id", "left_anti").orderBy("created_at", "id").limit(n), "claimed", worker, now + self.lease, read_at)

        return uploads.join(retried(attempt), "id", "left_semi")

    def finish(self, ids: DataFrame, worker: str, now: float) -> DataFrame:
        """Mark uploads as ingested: those of ``ids`` whose lease this worker still holds; the others belong to somebody else by now."""

        def attempt() -> DataFrame:
            read_at = max(self.log.versions(), default=-1)
            held = self._taken(now, read_at).where((F.col("status") == "claimed") & (F.col("worker") == worker))
            return self._put(ids.select("id").distinct().join(held, "id", "left_semi"), "finished", worker, None, read_at)

        return retried(attempt)
