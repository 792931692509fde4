"""Retries of failed documents as state of a stream: what ingest.retryable() finds in a whole log, kept up to date batch by batch.

State is keyed by document and small: when it was last resolved, and its newest failures, as many as are needed to give it up. Events may come in
any order and any split into batches, as that is all that the answer depends on. Each change gives a row for a table of the newest
state per document, of which a run reads the documents to take up again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from ..sources.commits import CommitLog, Folder

ATTEMPTS, PER_RUN = 5, 50
_OUT = "source_id string, external_id string, failures int, first_failed long"


def folded(resolved: int | None, failed: list[int], events: list[tuple[str, int]], attempts: int = ATTEMPTS) -> tuple[int | None, list[int]]:
    """The last resolution and the ``attempts`` newest failures after it, oldest first, once more events (action, time) are known."""
    resolved = max([*[t for a, t in events if a in ("ingested", "blocked")], *([] if resolved is None else [resolved])], default=None)
    times = sorted([*failed, *[t for a, t in events if a == "failed"]])
    return resolved, [t for t in times if resolved is None or t > resolved][-attempts:]


class _Bookkeeper(StatefulProcessor):
    def __init__(self, attempts: int, expire_ms: int | None):
        self.attempts, self.expire_ms = attempts, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("document", "resolved long, failed string")

    def _out(self, key, failed: list[int]):
        import pandas as pd

        return pd.DataFrame({"source_id": [key[0]], "external_id": [key[1]], "failures": pd.array([len(failed)], "Int32"), "first_failed": pd.array([failed[0] if failed else None], "Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        was = self.state.get() if self.state.exists() else (None, "[]")
        resolved, failed = None if was[0] is None or pd.isna(was[0]) else int(was[0]), json.loads(was[1])
        for batch in rows:
            resolved, failed = folded(resolved, failed, list(zip(batch["action"], batch["at"].astype("int64"), strict=True)), self.attempts)
        self.state.update((resolved, json.dumps([int(t) for t in failed])))
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield self._out(key, failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.state.clear()
        yield self._out(key, [])

    def close(self) -> None:
        pass


def bookkeeping(log: DataFrame, attempts: int = ATTEMPTS, expire_ms: int | None = None) -> DataFrame:
    """A streamed ingest log (source_id, external_id, action, created_at) as changes: source_id, external_id, failures since the last
    resolution (``attempts`` at most), first_failed (microseconds; of those failures, so it holds where there are fewer).

    expire_ms: the state of a document of which nothing was heard for so long goes, and its failures are forgotten; by default none goes. The
    session's state store must be one that keeps timers and columns: see STATE_STORE.
    """
    events = log.where("action in ('ingested', 'blocked', 'failed')").select("source_id", "external_id", "action", F.unix_micros("created_at").alias("at"))
    mode = "none" if expire_ms is None else "processingTime"
    return events.groupBy("source_id", "external_id").transformWithStateInPandas(_Bookkeeper(attempts, expire_ms), _OUT, "Update", mode)


#: The setting that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RetryTable:
    """The newest state per document: folders of changes that a commit log names, put together when there are many."""

    FRESH = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def _changes(self, upto: int | None = None) -> DataFrame:
        entries = self.log.entries(upto)
        return self.log.rows([e["folders"][0] for e in entries], _OUT, {e["folders"][0]: e["version"] for e in entries if e["kind"] == "changes"})

    def read(self, upto: int | None = None) -> DataFrame:
        """Documents with failures since their last resolution."""
        rest = F.struct("failures", "first_failed", "version")
        newest = self._changes(upto).groupBy("source_id", "external_id").agg(F.max_by(rest, "version").alias("r"))
        return newest.select("source_id", "external_id", "r.*")

    def append(self, changes: DataFrame, batch: int, writer: str) -> int | None:
        if self.log.committed(writer, batch):
            return None
        folder = self.log.write(changes.select("source_id", "external_id", "failures", "first_failed", F.lit(None).cast("long").alias("version")), "changes")
        version = self.log.commit({"kind": "changes", "folders": [folder]}, writer, batch)
        if len(self.log.entries()) > self.FRESH:
            upto = max(self.log.versions())
            folder = self.log.write(self.read(upto).where("failures > 0"), "state")
            self.log.commit({"kind": "state", "snapshot": True, "covers": upto, "folders": [folder], "batches": self.log.batches(self.log.entries(upto))})
        return version

    def due(self, attempts: int = ATTEMPTS, most: int = PER_RUN) -> DataFrame:
        """What a run takes up again, as ingest.retryable() says: source_id, external_id, failures, first_failed."""
        open_ = self.read().where((F.col("failures") > 0) & (F.col("failures") < attempts))
        rows = open_.select("source_id", "external_id", F.col("failures").cast("long").alias("failures"), F.timestamp_micros("first_failed").alias("first_failed"))
        return ingest.longest_failing(rows, most)


def keep_retries(log: DataFrame, table: RetryTable, checkpoint: str, attempts: int = ATTEMPTS, expire_ms: int | None = None, every: str = "10 seconds") -> StreamingQuery:
    """Keep a table of retries up to date with a streamed ingest log. A batch that runs again counts once.

    Without expiry the query takes what there is and ends. With it the query goes on, a batch ``every`` so often, as time itself makes changes.
    """
    writer: list[str] = []

    def put(batch: DataFrame, n: int) -> None:
        if not writer:
            writer.append(json.loads(Folder(table.spark, checkpoint).read("metadata"))["id"])
        table.append(batch, n, writer[0])

    changes = bookkeeping(log, attempts, expire_ms)
    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if expire_ms is None else {"processingTime": every})).start()
