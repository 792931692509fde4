"""State over time: retries as a stream's state, claims of several workers."""

import datetime
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakelore.operators import ingest
from lakelore.operators.claims import Claims
from lakelore.streaming import retries
from lakelore.streaming.retries import RetryTable
from tests.conftest import rows

LOG = "source_id string, external_id string, action string, created_at timestamp, event_id long"
START = datetime.datetime(2024, 1, 1)


def _log(n=400, seed=3):
    rng = random.Random(seed)
    actions = ["failed"] * 6 + ["ingested", "blocked", "skipped"]
    return [(f"s{rng.randrange(3)}", f"d{rng.randrange(25)}", rng.choice(actions), START + datetime.timedelta(minutes=rng.randrange(n)), i) for i in range(n)]


def test_what_is_kept_of_a_document_is_enough():
    """Folding events in any split and order gives what all of them give."""
    rng = random.Random(1)
    for _ in range(500):
        events = [(rng.choice(["failed", "failed", "failed", "ingested", "blocked"]), rng.randrange(30)) for _ in range(rng.randrange(1, 25))]
        at = max((t for a, t in events if a != "failed"), default=-1)
        want = sorted(t for a, t in events if a == "failed" and t > at)
        rng.shuffle(events)
        resolved, failed = None, []
        while events:
            k = rng.randrange(1, 5)
            resolved, failed = retries.folded(resolved, failed, events[:k])
            events = events[k:]
        assert failed == want[-5:] and (len(want) >= 5 or failed == want)


@pytest.fixture
def keyed_state(spark):
    name, provider = retries.STATE_STORE
    was = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield
    spark.conf.set(name, was)


def test_retries_follow_the_log(spark, tmp_path, keyed_state, monkeypatch):
    monkeypatch.setattr(RetryTable, "FRESH", 2)
    log = _log()
    random.Random(2).shuffle(log)  # events come late, too
    table, feed = RetryTable(spark, str(tmp_path / "t")), tmp_path / "log"
    stream = lambda: spark.readStream.schema(LOG).parquet(str(feed))
    for upto, since in ((100, 0), (110, 100), (400, 110)):
        spark.createDataFrame(log[since:upto], LOG).coalesce(1).write.mode("append").parquet(str(feed))
        query = retries.keep_retries(stream(), table, str(tmp_path / "cp"))
        query.awaitTermination(180)
        assert query.exception() is None
        whole = spark.createDataFrame(log[:upto], LOG)
        for most in (50, 3):
            assert rows(table.due(most=most)) == rows(ingest.retryable(whole, most=most))
    before = table.log.versions()
    assert table.append(table.read().limit(1).drop("version"), 0, table.log.entry(before[0])["batches"].popitem()[0]) is None and table.log.versions() == before


def test_state_expires(spark, tmp_path, keyed_state):
    table, feed = RetryTable(spark, str(tmp_path / "t")), tmp_path / "log"
    spark.createDataFrame([("s", "a", "failed", START, 0)], LOG).coalesce(1).write.parquet(str(feed))
    query = retries.keep_retries(spark.readStream.schema(LOG).parquet(str(feed)), table, str(tmp_path / "cp"), expire_ms=1, every="1 second")
    try:
        until = time.monotonic() + 120
        while time.monotonic() < until and not table.read().where("failures = 0").count():
            time.sleep(1)
    finally:
        query.stop()
    assert [(r.external_id, r.failures) for r in table.read().collect()] == [("a", 0)] and table.due().count() == 0
    assert table.read(0).first().failures == 1


def _uploads(spark, n=20):
    return spark.createDataFrame([(i, f"s{i % 2}", START + datetime.timedelta(minutes=n - i)) for i in range(n)], "id long, source_id string, created_at timestamp")


def test_claims_are_the_oldest_and_end(spark, tmp_path):
    uploads, claims = _uploads(spark), Claims(spark, str(tmp_path / "c"), lease=100)
    assert sorted(r.id for r in claims.claim(uploads, 3, "a", now=0).collect()) == [17, 18, 19]
    assert sorted(r.id for r in claims.claim(uploads, 3, "b", now=1, source_id="s0").collect()) == [12, 14, 16]
    assert sorted(r.id for r in claims.finish(uploads.where("id in (18, 19, 16, 1)"), "a", now=50).collect()) == [18, 19]
    state = lambda now: {r.id: r.status for r in claims.uploads(uploads, now).collect()}
    at = state(60)
    assert {i for i, s in at.items() if s == "claimed"} == {12, 14, 16, 17} and {i for i, s in at.items() if s == "ingested"} == {18, 19}
    # a's lease runs out: its upload is free again, and finishing it then doesn't count.
    assert state(100)[17] == "pending" and claims.finish(uploads.where("id = 17"), "a", now=100).count() == 0
    assert [r.id for r in claims.claim(uploads, 1, "b", now=100).collect()] == [17]
    assert claims.finish(uploads.where("id = 17"), "a", now=101).count() == 0 and claims.finish(uploads.where("id = 17"), "b", now=101).count() == 1
    assert len(claims.claim(uploads, 100, "c", now=300).collect()) == 17 and claims.claim(uploads, 100, "d", now=301).count() == 0


def test_two_claimers_never_get_one_upload(spark, tmp_path):
    uploads = _uploads(spark, 30)

    def work(worker):
        claims = Claims(spark, str(tmp_path / "c"))
        return [r.id for _ in range(3) for r in claims.claim(uploads, 4, worker, now=0).collect()]

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(work, "ab"))
    assert sorted(got[0] + got[1]) == list(range(6, 30))  # the 24 oldest, each once
    assert Claims(spark, str(tmp_path / "c")).uploads(uploads, 1).groupBy("status").count().where(F.col("status") == "claimed").first()[1] == 24
