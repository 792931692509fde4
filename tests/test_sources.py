import json

from pyspark.sql import functions as F

from lakelore.sources import connectors as K
from lakelore.sources.cursor import Cursor, CursorError
from lakelore.streaming import feeds
from tests.conftest import rows

import pytest

TABLE = "source_id string, external_id string, title string, content_hash string, markdown string, lifecycle_status string"


def _page(folder, n, items):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{n:05d}.json").write_text(json.dumps({"items": items}))


def _doc(i, text="t", **more):
    return {"external_id": f"d{i}", "title": f"T{i}", "content": text} | more


def test_cursor():
    c = Cursor("x", lambda d: {"page": int(d["page"])}, {"page": 0})
    assert c.decode(c.encode({"page": 3})) == {"page": 3} and c.decode("???") == {"page": 0} and c.decode(None) == {"page": 0}
    with pytest.raises(CursorError):
        c.decode("???", strict=True)


def test_feed_batch(spark, tmp_path):
    _page(tmp_path / "f", 0, [_doc(1), {"external_id": "d2", "deleted": True}, _doc(3, "x" * 50)])
    got = K.read_source(spark, "sharepoint", str(tmp_path / "f"), maxBytes="40")
    assert {r.external_id: r.change for r in got.collect()} == {"d1": "upserted", "d2": "deleted", "d3": "skipped"}
    with pytest.raises(ValueError):
        K.read_source(spark, "nope", "x")


def test_stream_merges_and_never_skips(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "table")
    _page(feed, 0, [_doc(i) for i in range(3)])
    _page(feed, 1, [_doc(i) for i in range(3, 5)])
    table = feeds.DocumentTable(spark, out, TABLE)

    def run():
        query = feeds.take_in(K.stream_feed(spark, str(feed), max_pages=1), table, "s", str(tmp_path / "cp"))
        query.awaitTermination(120)
        query.stop()

    run()
    run()
    assert {r.external_id for r in table.read().collect()} == {f"d{i}" for i in range(5)}
    _page(feed, 2, [{"external_id": "d1", "deleted": True}, _doc(2, "new")])
    run()
    got = {r.external_id: r.markdown for r in table.read().collect()}
    assert got == {"d0": "t", "d2": "new", "d3": "t", "d4": "t"}
    # The last change of a document counts, wherever its rows were dealt to; a version stays readable.
    _page(feed, 3, [_doc(9, "first"), {"external_id": "d9", "deleted": True}, _doc(9, "last"), _doc(3, "x"), {"external_id": "d3", "deleted": True}])
    run()
    run()
    assert {r.external_id: r.markdown for r in table.read().collect()} == {"d0": "t", "d2": "new", "d4": "t", "d9": "last"}
    assert {r.external_id for r in table.read(0).collect()} == {"d0", "d1", "d2"}


def test_table_writes_what_changes(spark, tmp_path):
    """Many small batches: a base is written when changes reach half of the last one, other versions hold their changes alone."""
    table = feeds.DocumentTable(spark, str(tmp_path / "t"), TABLE)
    row = lambda i, text, deleted=False, status="active": ("s", f"d{i}", "T", text, text, status, deleted)
    schema = f"{TABLE}, deleted boolean"
    state = {f"d{i}": "old" for i in range(100, 140)}
    table.append(spark.createDataFrame([row(i, "old") for i in range(100, 140)], schema), 0)
    for n in range(1, 12):
        some = {i: (f"v{n}", i % 5 == 4 and n > 3) for i in range(n, n + 3)}
        table.append(spark.createDataFrame([row(i, t, d) for i, (t, d) in some.items()], schema), n)
        for i, (t, d) in some.items():
            state.pop(f"d{i}", None) if d else state.update({f"d{i}": t})
        assert {r.external_id: r.markdown for r in table.read().collect()} == state
    bases = {table.log.entry(v)["base"] for v in table.log.versions() if table.log.entry(v).get("snapshot")}
    assert 1 < len(bases) < 5
    table.append(spark.createDataFrame([row(100, "w", status="withdrawn"), row(50, "w", status="withdrawn")], schema), 12)
    table.append(spark.createDataFrame([row(100, "again"), row(50, "new")], schema), 13)
    assert {r.external_id: r.lifecycle_status for r in table.read().where("external_id in ('d100', 'd50')").collect()} == {"d100": "active", "d50": "withdrawn"}


def _rows(spark, some, batch):
    return spark.createDataFrame([("s", i, "T", t, t, "active", t is None) for i, t in some.items()], f"{TABLE}, deleted boolean")


def _texts(table, version=None):
    return {r.external_id: r.markdown for r in table.read(version).collect()}


def test_a_batch_counts_once(spark, tmp_path):
    """Each batch is replayed, and one of another writer under the same number isn't taken for it."""
    table = feeds.DocumentTable(spark, str(tmp_path / "t"), TABLE)
    for n, some in enumerate([{"a": "1", "b": "1"}, {"a": "2"}, {"b": None}]):
        assert table.append(_rows(spark, some, n), n) is not None
        for old in range(n + 1):
            assert table.append(_rows(spark, {"a": "replayed", "z": "replayed"}, old), old) is None
    assert _texts(table) == {"a": "2"}
    assert table.append(_rows(spark, {"c": "1"}, 0), 0, "another") is not None
    assert _texts(table) == {"a": "2", "c": "1"}


def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = feeds.DocumentTable(spark, str(tmp_path / "t"), TABLE)
    table.append(_rows(spark, {"a": "1", "b": "1", "c": "1"}, 0), 0)
    before = table.version()
    with monkeypatch.context() as m:
        m.setattr(table.log, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        for action in (lambda: table.append(_rows(spark, {"a": "2"}, 1), 1), table.compact):
            with pytest.raises(KeyboardInterrupt):
                action()
    again = feeds.DocumentTable(spark, str(tmp_path / "t"), TABLE)
    assert again.version() == before and _texts(again) == {"a": "1", "b": "1", "c": "1"}
    again.append(_rows(spark, {"a": "2"}, 1), 1)
    assert _texts(again) == {"a": "2", "b": "1", "c": "1"}
    assert not again.vacuum(keep=100)  # young folders stay: their writer may still be at work
    assert len(again.vacuum(keep=100, grace=0)) == 2 and _texts(again) == {"a": "2", "b": "1", "c": "1"}


def test_changes_come_while_a_base_is_made(spark, tmp_path, monkeypatch):
    """Another writer commits, and readers read, between a base's write and its commit."""
    path = str(tmp_path / "t")
    table, other = feeds.DocumentTable(spark, path, TABLE), feeds.DocumentTable(spark, path, TABLE)
    monkeypatch.setattr(feeds.DocumentTable, "FRESH", 3)
    table.append(_rows(spark, {f"d{i}": "0" for i in range(40)}, 0), 0)
    table.append(_rows(spark, {"d1": "1"}, 1), 1)
    commit, seen = table.log.commit, []

    def late(entry, *a, **k):
        if entry["kind"] == "snapshot" and not seen:
            seen.append(_texts(other)["d1"])
            other.append(_rows(spark, {"d1": "late", "d2": None}, 0), 0, "other")
            seen.append(_texts(other)["d1"])
        return commit(entry, *a, **k)

    monkeypatch.setattr(table.log, "commit", late)
    table.compact()
    assert seen == ["1", "late"]
    for t in (table, other):
        got = _texts(t)
        assert got["d1"] == "late" and "d2" not in got and len(got) == 39
    for n in range(2, 6):  # folders of changes are put together without a base
        table.append(_rows(spark, {"d3": f"v{n}"}, n), n)
    assert _texts(table)["d3"] == "v5" and any(len(table.log.entry(v)["changes"]) for v in table.log.versions() if table.log.entry(v).get("snapshot"))
    old = table.log.versions()[-3]
    was = _texts(table, old)
    assert table.vacuum(keep=3, grace=0) and _texts(table, old) == was and _texts(table)["d1"] == "late"
    assert table.append(_rows(spark, {"d3": "replayed"}, 1), 1) is None  # known although its entry is gone


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")

    def write(w):
        table = feeds.DocumentTable(spark, path, TABLE)
        return [table.append(_rows(spark, {f"{w}-{n}": "x"}, n), n, w) for n in range(4)]

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(write, "abc"))
    table = feeds.DocumentTable(spark, path, TABLE)
    assert len({v for vs in got for v in vs}) == 12 and set(_texts(table)) == {f"{w}-{n}" for w in "abc" for n in range(4)}


def test_a_feed_in_runs_of_pages(spark, tmp_path):
    feed, table = tmp_path / "feed", feeds.DocumentTable(spark, str(tmp_path / "t"), TABLE)
    feed.mkdir()

    def land(n, items, **more):
        (feed / f"page-{n:05d}.json").write_text(json.dumps({"items": items} | more))

    def run():
        return feeds.sync(spark, str(feed), table, "s", str(tmp_path / "cp"), max_pages=2)

    for n in range(5):
        land(n, [_doc(f"{n}-{i}") for i in range(3)], cursor=f"c{n}", next=f"c{n + 1}", done=n == 4)
    runs = run()
    assert [(e["pages"], e["items"], e["done"]) for e in runs] == [(2, 6, False), (2, 6, False), (1, 3, True)]  # continuations
    assert len(_texts(table)) == 15 and run() == []
    # The exporter hands out the same cursor again and again.
    for n in (5, 6):
        land(n, [_doc("again", str(n))], cursor="c5", next="c5", done=False)
    for _ in range(2):  # a restart runs the batch again and stops again; its documents are in the table once
        with pytest.raises(Exception, match="cursor is still c5"):
            run()
        assert _texts(table)["dagain"] == "6" and len(_texts(table)) == 16
    land(6, [_doc("again", "mended")], cursor="c6", next="c7", done=True)
    run()
    with pytest.raises(Exception, match="more than 0 runs"):
        query = feeds.take_in(K.stream_feed(spark, str(feed)), table, "s", str(tmp_path / "cp2"), most_runs=0)
        query.awaitTermination(120)


def test_the_driver_reads_names_only(tmp_path):
    (tmp_path / "page-00000.json").write_text("no json at all")
    (tmp_path / "page-00001.json").write_text("")
    reader = K._PageNames(str(tmp_path), 5)
    rows, end = reader.read(reader.initialOffset())
    assert [(n[-15:], p) for n, p in rows] == [("page-00000.json", 0), ("page-00001.json", 1)] and end == {"page": 2}
    assert list(reader.readBetweenOffsets({"page": 1}, end)) == [(str(tmp_path / "page-00001.json"), 1)] and list(reader.read(end)[0]) == []


def test_audit_shipping_leaves_texts_out(spark, tmp_path):
    log = spark.range(5).select("id", F.lit("search").alias("endpoint"), F.lit("secret").alias("question_text"), F.timestamp_seconds("id").alias("created_at"))
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = feeds.ship_audit_log(stream, feeds.json_sink(str(tmp_path / "sink")), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "sink"))
    assert got.count() == 5 and "question_text" not in got.columns


def test_markdown_files_and_changes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Hello\ntags: x\n---\n# Body\n")
    got = K.markdown_files(spark, str(tmp_path)).first()
    assert got.front_matter == {"title": "Hello", "tags": "x"} and got.markdown == "# Body\n"
    listing = lambda *x: spark.createDataFrame(x, "external_id string, hash string")
    assert rows(K.changes(listing(("a", "1"), ("b", "1"), ("c", "1")), listing(("a", "1"), ("b", "2"), ("d", "1")))) == [("deleted", "c"), ("upserted", "b"), ("upserted", "d")]


def test_xml_sections(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<R><DIV8 N="4.1"><HEAD>One</HEAD><P>a</P><P>b  c</P></DIV8><DIV8 N="4.2"><HEAD>Two</HEAD></DIV8></R>')
    assert rows(K.xml_sections(spark, str(tmp_path / "x.xml"), "DIV8")) == [("4.1", "a\n\nb c", "One"), ("4.2", "", "Two")]


def test_routes_and_exclusion(spark):
    files = spark.createDataFrame([("a.CSV", "", 1), ("b.xlsx", "", 1), ("c.pdf", "", 1), ("d.csv", "", 0), ("e.csv", "", 1 << 30)], "n string, m string, s long")
    assert [r.x for r in files.select(K.route(F.col("n"), F.col("m"), F.col("s")).alias("x")).collect()] == ["separated", "spreadsheet", "general", "empty", "too_large"]
    feed = spark.createDataFrame([("a", "x/Engagement Letter/y", b"1", "upserted"), ("b", "ok", b"1", "upserted")], "external_id string, path string, content binary, change string")
    assert {r.external_id: (r.change, r.content) for r in K.excluded_as_deleted(feed, F.col("path")).collect()} == {"a": ("deleted", None), "b": ("upserted", bytearray(b"1"))}
