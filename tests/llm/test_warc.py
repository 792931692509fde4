import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lakelore.llm import warc

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "copied " * 200


def _pages():
    rows = [(i, f"http://h/{i}", f"<p>{i} " + "word " * (i * 7 % 400)) for i in range(40)]
    rows += [(100 + i, "http://h/copy", BIG) for i in range(5)] + [(200, None, None), (201, "u", ""), (None, "u", BIG), (None, "u", "no id"), (7, "u", BIG), (7, "u", BIG)]
    rows += [(300, "a b\r\nWARC-Type: x", "é漢😀" * 400), (301, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (302, "u", "tiny"), (303, "u", "tiny"), (304, "u", "z" * 300_000)]
    return rows


def _plain(rows):
    """What op 11 is to give, from its wording."""
    out, groups = [], {}
    for k, (i, _, h) in enumerate(rows):
        data = (h or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append((i is not None, i, k))
        out.append([i, len(data), hashlib.sha1(data).hexdigest(), "response", None])
    for members in groups.values():
        # Rows of one page_id are alike: which of them is the response doesn't show in the rows.
        top = max(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        for _, _, k in members:
            if k != top[2]:
                out[k][3:] = ["revisit", top[1]]
    return sorted(map(tuple, out), key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_pages_round_trip(spark, compress):
    rows = _pages()
    pages = spark.createDataFrame(rows, PAGES).withColumns({"key": F.lit("clash"), "first": F.lit(1), "best": F.lit(2), "n": F.lit(3), "payload": F.lit("x")}).repartition(3)
    manifest = warc.write(pages, compress=compress, bytes_per_file=2_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    found = warc.read(spark, manifest, with_payload=True).cache()
    assert warc.gaps(found).isEmpty()
    assert _got(warc.digests(found)) == _plain(rows)
    read = found.where("record_type = 'response'").collect()
    texts = {i: (h or "").encode() for i, _, h in rows if i not in (None, 7)}
    assert all(bytes(r.payload) == texts[r.page_id] for r in read if r.page_id in texts)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes for r in read)
    revisits = found.where("record_type = 'revisit'").collect()
    named = {r.record_id: r.page_id for r in read}
    assert revisits and all(named[r.refers_to_id] == r.refers_to and len(r.payload) == 0 for r in revisits)
    assert {r.url for r in read if r.page_id in (200, 300)} == {None, "a%20b%0D%0AWARC-Type:%20x"}


def test_no_pages(spark):
    manifest = warc.write(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read(spark, manifest).count() == 0


def test_a_hot_payload_is_split(spark):
    """A third of all rows hold one payload: its rows stay in the tasks they are in."""
    pages = spark.range(9000, numPartitions=6).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(BIG)).otherwise(F.concat(F.col("id").cast("string"), F.lit(BIG))).alias("html"))
    found = warc.read(spark, warc.write(pages))
    hot = found.where("refers_to = 8997").groupBy("path").count()
    assert hot.count() > 2 and hot.agg(F.max("count")).first()[0] < 1500
    got = warc.digests(found)
    assert got.where("record_type = 'revisit'").count() == 2999 and got.where("refers_to = 8997").count() == 2999


# ---- salvage ------------------------------------------------------------------------------------------------------------


def _record(i, payload, kind="response"):
    return warc.page_record({"file": 1, "row": i}, i, f"http://h/{i}", payload, None, "2000-01-01T00:00:00Z")


def _read(data, gz, most=1 << 30):
    found = list(warc.salvage(warc.Window(_File(data)), gz, most))
    at = 0
    for x in found:  # records and gaps cover the file
        assert x.offset == at or isinstance(x, warc.Record)
        at = x.offset + x.length
    assert at == len(data)
    return [warc._row("", x)["page_id"] for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def _archive(gz, n=8, size=3000):
    rng = random.Random(5)
    parts = [_record(i, bytes(rng.randrange(256) for _ in range(size))) for i in range(n)]
    return [gzip.compress(p) if gz else p for p in parts]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("what", ["byte", "start", "cut", "lost", "junk", "end", "length"])
def test_later_records_are_recovered(gz, what):
    parts = _archive(gz)
    bad = {3}
    hurt = bytearray(parts[3])
    if what == "byte":
        hurt[len(hurt) // 2] ^= 0x55
    elif what == "start":
        hurt[:12] = b"x" * 12
    elif what == "cut":
        hurt = hurt[: len(hurt) // 2]
    elif what == "lost":
        hurt = hurt[40:]
    elif what == "junk":
        hurt, bad = b"noise \x1f\x8b\x08\x00 WARC/1.1\r\n" * 5000 + hurt, set()
    elif what == "end":
        hurt[-6:] = b"??????"
    else:
        hurt = bytearray(parts[3].replace(b"Content-Length: 3", b"Content-Length: 9")) if not gz else hurt[:-9]
    data = b"".join([*parts[:3], bytes(hurt), *parts[4:]])
    got, gaps = _read(data, gz)
    assert got == [i for i in range(8) if i not in bad]
    begin = sum(map(len, parts[:3]))
    covered = sum(g.length for g in gaps)
    assert min(g.offset for g in gaps) == begin and covered == (len(hurt) if bad else len(hurt) - len(parts[3])) and all(g.reason for g in gaps)


@pytest.mark.parametrize("gz", [True, False])
def test_any_single_damage_costs_one_record(gz):
    parts = _archive(gz, n=5, size=400)
    rng = random.Random(3)
    for _ in range(300):
        data = bytearray(b"".join(parts))
        at = rng.randrange(len(data))
        data[at] ^= 1 << rng.randrange(8)
        hit = next(k for k in range(5) if at < sum(map(len, parts[: k + 1])))
        got, gaps = _read(bytes(data), gz)
        # A flipped bit that no check covers (a field's value, a gzip header's time) leaves its record; any other costs it alone.
        assert [i for i in got if i in range(5) and i != hit] == [i for i in range(5) if i != hit] and len(gaps) <= 1 + (not gz)


def test_a_damaged_block_is_a_gap_of_its_own(spark):
    """Its frame is whole, so an archive that is its payload isn't read as what follows."""
    inner = b"".join(_archive(False, n=2, size=50))
    outer = bytearray(_record(50, inner))
    outer[-10] ^= 1
    data = _record(49, b"a") + bytes(outer) + _record(51, b"b")
    got, gaps = _read(data, False)
    assert got == [49, 51] and [g.reason for g in gaps] == ["block digest differs"] and gaps[0].length == len(outer)


def test_ends_and_limits():
    parts = _archive(False, n=3)
    assert _read(b"", False) == ([], [])
    assert _read(b"no archive at all", False)[0] == [] and len(_read(b"no archive at all", True)[1]) == 1
    assert _read(b"".join(parts)[:-1], False)[0] == [0, 1]
    got, gaps = _read(b"".join([parts[0], _record(9, b"y" * 20000), parts[2]]), False, most=10_000)
    assert got == [0, 2] and "more than" in gaps[0].reason
    two = gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2])  # two records of one member
    assert _read(two, True)[0] == [0, 1, 2]
    base16 = parts[0].replace(warc._digest(parts[0].split(b"\r\n\r\n", 2)[2][:-4]).encode(), b"sha1:" + hashlib.sha1(parts[0].split(b"\r\n\r\n", 2)[2][:-4]).hexdigest().encode())
    assert _read(base16, False)[0] == [0] or base16 == parts[0]


def test_gaps_are_logged_by_file(spark, tmp_path):
    parts = _archive(True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[:4]) + b"??" + b"".join(parts[4:])[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n), 1) for n in ("a.warc.gz", "b.warc.gz", "c.warc")], "path string, offset int")
    found = warc.read(spark, files)
    assert warc.records(found).count() == 15
    log = {(r.path[-9:], r.offset, r.length): r.error for r in warc.gaps(found).collect()}
    first = sum(map(len, parts[:4]))
    assert log == {("b.warc.gz", first, 2): log[("b.warc.gz", first, 2)], ("b.warc.gz", first + 2 + sum(map(len, parts[4:7])), len(parts[7]) - 30): "member is cut short"}
