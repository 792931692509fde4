"""Operator 6: vector bin packing of examples into sequences, by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens. An
open sequence takes the item whose demand vector has the largest dot product with what is left of the
three limits, each as a share of its limit, among the items that fit. If none fits whole, the item with
the largest product is cut so that its first piece fills what is left. Items wait in a window of bounded
size; an input task packs its own rows, so ids never travel and a lost task is just run again with the
same result. A sequence that nothing is left to fill (the last of a task, or one out of segments or loss)
is cut at powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import filled, worker_memory
from .words import encoder, vocabulary


class Packer:
    """Feeds items in, gets sequences out: lists of (key, first, length) with key as it was given."""

    def __init__(self, tokens: int = 4096, segments: int = 64, loss: int | None = None, window: int = 1024, most: int = 1 << 20):
        """window, most: items and tokens that wait, at most, before sequences are made of them."""
        if min(tokens, segments, loss if loss is not None else 1, window, most) < 1:
            raise ValueError("limits are positive")
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.window, self.most, self.waiting, self.held = window, most, [], 0

    def add(self, key, length: int, loss_from: int = 0) -> list:
        """An item; its tokens from position ``loss_from`` on bear loss. Returns the sequences now complete."""
        out, at = [], 0
        while length - at >= self.limits[0] <= self.limits[2]:  # whole sequences of one item, where loss can't bind
            out += self._cut([(key, at, int(self.limits[0]))])
            at += int(self.limits[0])
        if length > at:
            self.waiting.append((key, at, length, loss_from))
            self.held += length - at
        return out + (self._pack(False) if len(self.waiting) >= self.window or self.held >= self.most else [])

    def end(self) -> list:
        return self._pack(True)

    def _pack(self, last: bool) -> list:
        """Sequences of what waits, until few tokens and no more than half a window of items are left (or nothing)."""
        items, out = self.waiting, []
        first = np.array([x[1] for x in items], float)
        size = np.array([x[2] - x[1] for x in items], float)
        free = np.array([max(0, x[3] - x[1]) for x in items], float)  # tokens before the loss begins
        demand = lambda k=slice(None): np.array([size[k], np.minimum(1.0, size[k]), np.maximum(0.0, size[k] - free[k])])
        need = demand()
        while (total := need[0].sum()) > 0 and (last or total >= 4 * self.limits[0] or 2 * np.count_nonzero(size) > self.window):
            left, taken = self.limits.copy(), []
            while left[0] >= 1 and left[1] >= 1:
                product = (left / self.limits**2) @ need
                part = np.minimum(np.minimum(size, left[0]), free + left[2])  # what could be taken of each
                fits = np.where((part >= 1) & (part == size), product, -1.0)
                if fits.max(initial=-1.0) < 0:
                    fits = np.where(part >= 1, product, -1.0)
                k = int(fits.argmax())
                if fits[k] < 0:
                    break
                now = part[k]
                taken.append((items[k][0], int(first[k]), int(now)))
                left -= [now, 1, max(0.0, now - free[k])]
                first[k] += now
                size[k] -= now
                free[k] = max(0.0, free[k] - now)
                need[:, k] = demand(k)
            out += self._cut(taken)
        self.waiting = [(x[0], int(first[i]), x[2], x[3]) for i, x in enumerate(items) if size[i] > 0]
        self.held = int(size.sum())
        return out

    def _cut(self, taken: list) -> list:
        """One full sequence, or sequences of powers of two."""
        total = sum(n for _, _, n in taken)
        if total == self.limits[0]:
            return [taken]
        out, pieces = [], list(reversed(taken))
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            sequence = []
            while size:
                key, at, n = pieces.pop()
                now = min(n, size)
                sequence.append((key, at, now))
                size -= now
                if n > now:
                    pieces.append((key, at + now, n - now))
            out.append(sequence)
        return out


def pack(
    docs: DataFrame, path: str, end_id: int = 2, tokens: int = 4096, segments: int = 64, loss: int | None = None,
    context: str | None = None, window: int = 1024, with_ids: bool = False,
) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id``, and pack every id into exactly one sequence.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and ids
    (binary, little-endian unsigned 32-bit) on request. ``context`` names a column with the part of the text, from its
    beginning up to white space, that bears no loss (null or no column: all tokens do); ``loss`` is the limit of a sequence's
    loss-bearing tokens (None: as many as tokens). Null doc_ids and repeated rows are packed like any other; an empty table
    gives no rows; a text of any length is cut over as many sequences as it needs; other columns don't matter, whatever
    their names.
    """
    shared = vocabulary(docs.sparkSession, path)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        packer = Packer(tokens, segments, loss, window)
        sequence, kept, rows, held = TaskContext.get().partitionId() << 32, {}, {n: [] for n in names}, 0

        def emit(sequences):
            nonlocal sequence, held
            for s in sequences:
                offset = 0
                for key, at, n in s:
                    doc, ids, left, free = kept[key]
                    piece = ids[4 * at : 4 * (at + n)]
                    row = [doc, at, n, zlib.crc32(piece), len(ids) // 4, sequence, offset, max(0, at + n - max(at, free))] + [piece] * with_ids
                    for name, v in zip(names, row, strict=True):
                        rows[name].append(v)
                    held += 1 + len(piece) * with_ids // 1000
                    offset += n
                    kept[key][2] = left - n
                    if left == n:
                        del kept[key]
                sequence += 1

        def full(least):
            nonlocal held
            if held > least:
                kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
                batch = pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds, strict=True)], names=names)
                for n in names:
                    rows[n] = []
                held = 0
                yield batch

        with worker_memory("words") as memory:
            code, key = encoder(shared, memory), 0
            for batch in batches:
                for d, t, c in zip(*batch.columns, strict=True):
                    ids = code.encode(t.as_py()) + end
                    free = len(code.encode(c.as_py())) // 4 if c.is_valid else 0
                    key += 1
                    kept[key] = [d.as_py(), ids, len(ids) // 4, free]
                    emit(packer.add(key, len(ids) // 4, free))
                    yield from full(5000)
            emit(packer.end())
            yield from full(0)

    before = F.col(f"`{context}`") if context else F.lit(None).cast("string")
    source = docs.select("doc_id", filled(F.col("text")).alias("text"), before.alias("context"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids binary" * with_ids)


def first_line(text):
    """The first line of a text of several, as its context; null if there is none."""
    return F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", 1))
