"""One key that most rows have: it is no single task, and results are as without."""

import pytest
from pyspark.sql import functions as F

from lakelore.llm import chat, common, components, langid, ngram_join, quality, syncmers
from tests.conftest import rows


def test_posteriors_of_many_sites_with_a_hot_one(spark, monkeypatch):
    site = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
    scored = common.settle(spark.range(20000, numPartitions=4).select(
        F.col("id").alias("doc_id"), site.alias("host"), F.when(F.col("id") % 3 > 0, F.lit("p")).alias("path"), ((F.col("id") * 37 % 100) / 100).alias("p_low"), ((F.col("id") * 11 % 50) / 100).alias("p_toxic"),
    ))
    want = rows(quality.posteriors(scored).select("doc_id", "low", "toxic", "site_low", "site_toxic"))
    monkeypatch.setattr(common, "FEW", 0)
    found = quality.posteriors(scored)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(want) == 20000 and rows(found.select("doc_id", "low", "toxic", "site_low", "site_toxic")) == want
    assert max(sizes) < 14000 * 0.6  # the rows of hot, path p are 9333, those of hot 14000


def test_a_sample_of_a_language_of_most_rows(spark):
    docs = spark.range(30000, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 50 == 0, "xx").otherwise("yy").alias("lang"))
    usable = docs.where(~langid.held_out()).select("lang", "text", F.xxhash64("doc_id", "text", F.lit("train")).alias("hash")).collect()
    want = sorted((r.lang, r.text) for k in ("xx", "yy") for r in sorted([u for u in usable if u.lang == k], key=lambda u: u.hash)[:40])
    assert sorted((r.lang, r.text) for r in langid.sample(docs, per_lang=40).collect()) == want


def test_spans_of_more_turns_than_any_doubling_before(spark):
    assert 2**chat._DOUBLINGS > 2**31 - 1
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    read = chat.read_chats(chat.format_chats(turns)).first()
    assert read.loss_texts == [str(i) for i in range(1, 3000, 2)]


@pytest.fixture
def dealt(spark):
    """No small tasks are put together, so that a task shows what was dealt to it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_next_documents_of_one_doc_id(spark, dealt):
    key = F.when(F.col("id") % 10 == 0, F.col("id"))  # nine in ten have none
    docs = spark.range(20000, numPartitions=4).select(key.alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = syncmers.with_next(docs, ["text"], rows_each=250)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    after = {int(r.text): int(r.next_text) for r in found.collect()}
    assert len(after) == 20000 and max(sizes) < 6000
    at, walk = 0, []
    for _ in after:
        walk.append(at)
        at = after[at]
    assert at == 0 and len(set(walk)) == 20000  # one ring: with ids in their order, without behind them
    assert walk[:2000] == list(range(0, 20000, 10))


def test_copies_of_one_row_follow_each_other(spark, dealt):
    docs = spark.range(5000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    found = syncmers.with_next(docs, ["text"], rows_each=100)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1500 and not found.where("next_text is null or next_text <> 'a b'").count()


def test_components_of_a_hub(spark):
    star = spark.range(1, 30000, numPartitions=4).select(F.lit(7_000_000).cast("long").alias("a"), "id")
    links = star.union(spark.createDataFrame([(50_000, 50_001), (50_001, 2)], "a long, b long")).toDF("a", "b")
    got = rows(components.components(links).where("root <> 1"))
    assert got == [] and components.components(links).count() == 30002


def test_a_family_of_near_copies_is_one_component(spark, dealt, monkeypatch):
    """4000 texts, each with a change of its own of one text."""
    base = [f"w{i}" for i in range(300)]
    text = F.concat(F.lit(" ".join(base[:150]) + " changed"), F.col("id").cast("string"), F.lit(" " + " ".join(base[150:])))
    docs = common.settle(spark.range(4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, " ".join(base)).otherwise(text).alias("text")))
    monkeypatch.setattr(common, "FEW", 0)
    found = ngram_join.near_duplicates(docs)
    assert found.where("component_id <> 0").count() == 0 and found.where("stays").count() == 1


def test_pairs_of_a_hub_are_dealt(spark, dealt, monkeypatch):
    sets = {0: list(range(100)), **{i: [*range(99), 1000 + i] for i in range(1, 3001)}}
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s)) for i, s in sets.items()], "doc_id long, text string")
    work = common.Scratch(spark)
    given = common.identified(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")})
    profile = work.settle(ngram_join._profile(given))
    shared = work.broadcast(ngram_join._rarity(profile.where("counts is not null").select("part", "slot", "counts"), work))
    each = profile.where("file is not null").select(F.struct("file", "row").alias("__row"), "n", "id", "short")
    nodes = work.settle(each.groupBy("short", "id").agg(F.min("__row").alias("__row")))
    hub = ngram_join._short(ngram_join._digest(ngram_join.shingles(" ".join(f"w{x}" for x in sets[0]))))
    pairs = work.settle(nodes.where(F.col("short") != hub).select(F.least("short", F.lit(hub)).alias("x"), F.greatest("short", F.lit(hub)).alias("y")))
    for few in (common.FEW, 0):
        monkeypatch.setattr(common, "FEW", few)
        links = ngram_join._links(pairs, nodes, given, 80, shared, work)
        sizes = [r["count"] for r in links.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 1000  # a link is written by the task that compared its sets
    work.drop()


@pytest.mark.parametrize("often", [ngram_join._CLASSES - 1, 4, 0])
def test_prefixes_are_dealt_once(spark, monkeypatch, often):
    written, settle = [], common.Scratch.settle
    monkeypatch.setattr(common.Scratch, "settle", lambda self, df: written.append(df.columns) or settle(self, df))
    monkeypatch.setattr(ngram_join, "_OFTEN", often, raising=False)
    # Six families of five, four of which have an own word; each text thrice, and texts that share a passage only.
    texts = [" ".join([*[f"f{k}w{i}" for i in range(60)], *([f"own{m}"] if m else [])]) for k in range(6) for m in range(5)] * 3
    texts += [" ".join([*[f"f0w{i}" for i in range(20)], *[f"p{k}w{i}" for i in range(40)]]) for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: 5 * (i % 30 // 5) if i < 90 else i for i in range(99)}
    # Only if there are frequent tokens are prefixes written, to be read for rare and for frequent ones.
    assert (["token", "short", "n", "pos"] in written) == (often <= 4)
