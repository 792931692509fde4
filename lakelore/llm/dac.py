"""Operator 9: token files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level
j + 1 the next chunk of those ids that go on after level j. A bitmap per level says which ids go on, and
a rank directory (set bits before every block of 512) turns a position into its place one level down.
So any id is read from one chunk per level, without decoding its neighbours.

File: magic, then little-endian u64 counts (documents, ids, levels), the document ids (i64) with a
validity bitmap, the documents' first positions (u64, one more than documents), then per level: u64
count, the chunks (u8), the bitmap (bits from low to high) and the rank directory (u64 per block).

Writing: documents are dealt by ranges of doc_id, sorted in their task and encoded there, so ids never
travel. A task writes files of a bounded number of ids under names of its own attempt and returns them
as rows of a manifest; only files of the manifest count, so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import filled, settle, shared_dir, shared_fs, worker_memory
from .words import encoder, vocabulary

MAGIC = b"LKDAC\x001\n"
BLOCK = 512


def pack(ids: np.ndarray, doc_ids: list, firsts: np.ndarray) -> bytes:
    """One file's bytes: ids of all its documents, the documents' ids and first positions."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 0xFF
        levels.append((rest & 0xFF).astype("u1"))
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u8") if len(more) else np.zeros(0, "<u8")
        ranks = np.concatenate([np.zeros(1, "<u8"), np.cumsum(blocks, dtype="<u8")])
        levels[-1] = (levels[-1], np.packbits(more, bitorder="little"), ranks)
        if not more.any():
            break
        rest = rest[more] >> 8
    known = np.array([d is not None for d in doc_ids], bool)
    out = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known, bitorder="little").tobytes(), firsts.astype("<u8").tobytes()]
    for chunks, bitmap, ranks in levels:
        out += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(out)


class DacFile:
    """Reads a file's bytes: any id by position, any stretch of ids, or a document's."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.data, self.at = data, 8
        n_docs, self.n_ids, n_levels = (int(x) for x in self._take("<u8", 3))
        ids = self._take("<i8", n_docs)
        known = np.unpackbits(self._take("u1", (n_docs + 7) // 8), bitorder="little")[:n_docs]
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.firsts = self._take("<u8", n_docs + 1).astype("i8")
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            chunks, bitmap = self._take("u1", n), self._take("u1", (n + 7) // 8)
            self.levels.append((chunks, bitmap, self._take("<u8", (n + BLOCK - 1) // BLOCK + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        inside = np.unpackbits(bitmap[block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            out |= int(chunks[i]) << 8 * level
            if not bitmap[i // 8] >> i % 8 & 1:
                return out
            i, level = self._rank(level, i), level + 1

    def stretch(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b: at each level a stretch again, as ranks of neighbours are neighbours."""
        out, where = np.zeros(b - a, "<u4"), np.arange(b - a)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype("<u4") << np.uint32(8 * level)
            more = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            if not len(where):
                break
            a = self._rank(level, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.stretch(int(self.firsts[k]), int(self.firsts[k + 1]))


def write(docs: DataFrame, path: str, out: str | None = None, end_id: int = 1, ids_per_file: int = 4_000_000) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` and write files in ascending doc_id order.

    Returns the manifest: part, seq, path, n_docs, n_ids, start (ids before the file). Null doc_ids come
    first; rows of one doc_id in order of their text, repeated rows each. No rows: no files, an empty manifest. A text of any
    length lies in one file; other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/dac-{uuid.uuid4().hex}"
    fs, at = shared_fs(out)
    fs.create_dir(at, recursive=True)
    shared = vocabulary(spark, path)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        own, folder = shared_fs(out)
        ids, docs_, firsts, n = [], [], [0], 0

        def flush():
            nonlocal ids, docs_, firsts, n, seq
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex[:12]}.dac"
            with own.open_output_stream(name) as f:
                f.write(pack(np.frombuffer(b"".join(ids), "<u4"), docs_, np.array(firsts)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "n_docs": [len(docs_)], "n_ids": [n]})
            ids, docs_, firsts, n, seq = [], [], [0], 0, seq + 1
            return row

        with worker_memory("words") as memory:
            code = encoder(shared, memory)
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    got = code.encode(t.as_py()) + end
                    n += len(got) // 4
                    ids.append(got)
                    docs_.append(d)
                    firsts.append(n)
                    if n >= ids_per_file:
                        yield flush()
            if docs_:
                yield flush()

    dealt = docs.select("doc_id", filled(F.col("text")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = settle(dealt.mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long"))
    # What lies before a file: all files of earlier tasks, of which there is one row each, and the earlier files of its own.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = manifest.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return manifest.withColumn("within", within).join(before, "part").select(*manifest.columns, (F.col("before") + F.col("within")).alias("start"))


def read(spark: SparkSession, manifest: DataFrame, out: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows of the files: doc_id, start, n_tokens, ids_crc32 (unsigned, of little-endian ids), ids on request.

    A row per document of the manifest's files, repeated ones each; null doc_ids as they were written; an empty manifest gives no rows. A file is read
    whole by its task, so a very long document takes its task's memory; other columns of the manifest don't matter.
    """
    root = out or shared_dir(spark)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, _ = shared_fs(root)
        with worker_memory("dac"):
            for batch in batches:
                for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                    with own.open_input_stream(name) as f:
                        file = DacFile(f.read())
                    step = 2000
                    for a in range(0, len(file.doc_ids), step):
                        some = range(a, min(a + step, len(file.doc_ids)))
                        ids = [file.document(k) for k in some]
                        rows = {
                            "doc_id": pa.array([file.doc_ids[k] for k in some], pa.int64()),
                            "start": pa.array([start + int(file.firsts[k]) for k in some], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        }
                        if with_ids:
                            rows["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(rows)

    files = max(1, manifest.count())
    dealt = manifest.select("path", "start").repartition(files, "path")  # a file holds some MB, so a task for each is no burden
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
