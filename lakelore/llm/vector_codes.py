"""Operator 12: vector codes by integer Lloyd rounds with Hamerly's bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook. A state table keeps, per row and part,
the entry it is assigned to, an upper bound on the distance to it and one lower bound on the distance to the second nearest. When
entries move, the upper bound grows by the move of its own entry and the lower one shrinks by the greatest move of the
others. A part keeps its entry without any scan while its upper bound is strictly below the lower one, or below half the distance
from its entry to the nearest other entry; else the exact distance to its entry is tried as the upper bound, and else all
entries are scanned in exact integers, ties to the lower index. Bounds are rounded outward, so where they hold the entry is
nearest without a tie, and codes are those of full scans.

A round reads the state of the one before and writes its own; each task also adds up its parts by entry, and these sums, a
row per entry and task, are added up on executors. The driver holds codebooks only. A state goes once the next is settled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_one, settle, worker_memory
from .lattice import added, exact, joined_sha256, partials, sound, squared, to_integers


def _above(x: np.ndarray) -> np.ndarray:
    """The next 32-bit float above."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


@dataclass
class Codebooks:
    """entries: parts x entries x width, integers; own: how far each entry has moved; other: how far any other has; half:
    half the distance to the nearest other entry. The last three as bounds, rounded outward."""

    entries: np.ndarray
    own: np.ndarray
    other: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Codebooks:
        parts, k, _ = entries.shape
        move = np.zeros((parts, k))
        if before is not None:
            a, b = exact(entries, before)
            move = np.nextafter(np.sqrt(((a - b) ** 2).sum(2).astype(float)), np.inf)
        other, half = np.zeros((parts, k)), np.full((parts, k), np.inf)
        for j in range(k if k > 1 else 0):
            rest = [i for i in range(k) if i != j]
            other[:, j] = move[:, rest].max(1)
            a, b = exact(entries[:, rest], entries[:, j : j + 1])
            half[:, j] = np.sqrt(((a - b) ** 2).sum(2).min(1).astype(float)) / 2 * (1 - 1e-12)
        return cls(entries, move, other, half)


@dataclass
class State:
    """Per row and part: the entry, and the two bounds (32-bit floats)."""

    codes: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0


def assign(points: np.ndarray, books: Codebooks, state: State | None = None) -> State:
    """points: rows x parts x width. The nearest entry of each part. state: of the round before, whose entries moved to these."""
    rows, parts, _ = points.shape
    out = State(np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.float32), np.full((rows, parts), np.inf, np.float32))
    for p in range(parts):
        x, book = exact(points[:, p], books.entries[p])
        todo = np.arange(rows)
        if state is not None:
            code = state.codes[:, p]
            upper = _above(state.upper[:, p].astype(float) + books.own[p][code])
            lower = _below(state.lower[:, p].astype(float) - books.other[p][code])
            safe = np.maximum(lower, books.half[p][code])
            out.codes[:, p], out.upper[:, p], out.lower[:, p] = code, upper, lower
            todo = np.flatnonzero(~(upper < safe))
            upper = _above(np.sqrt(((x[todo] - book[code[todo]]) ** 2).sum(1).astype(float)))
            out.upper[todo, p] = upper
            todo = todo[~(upper < safe[todo])]
        if len(todo):
            d = squared(x[todo], book)
            best = d.argmin(1)
            at = np.arange(len(todo))
            out.codes[todo, p], out.upper[todo, p] = best, _above(np.sqrt(d[at, best].astype(float)))
            if d.shape[1] > 1:
                d = d.astype(float)
                d[at, best] = np.inf
                out.lower[todo, p] = _below(np.sqrt(d.min(1)))
            out.scanned += len(todo)
    return out


def _moved(books: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each entry becomes its parts' componentwise floor(sum / count); unused entries stay."""
    out = books.copy()
    for slot, (n, total) in sums.items():
        out[slot // books.shape[1], slot % books.shape[1]] = [x // n for x in total]
    return out


_STATE = "vec_id long, label string, q array<int>, codes binary, upper array<float>, lower array<float>, slot int, n long, sums array<bigint>"


def codes(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as text, code, error of each row; the codebooks, parts x entries x width).

    Rows whose vector is null or has a null or non-finite component are left out. A vector has as many components as that of least
    vec_id (a multiple of ``parts``, or it is an error); rows of another length, and empty vectors, have no code in these books and are left out
    too. Codebooks start as the parts of the ``entries`` rows of least vec_id (null last, rows of one vec_id in order of their
    vectors), all rows if there are fewer. Repeated rows count each. No rows: no codes, no codebooks. Components whose squared distances
    don't fit 64 bits are an error. Other columns don't matter, whatever their names.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    named = F.lit(None).cast("string") if label is None else F.col(f"`{label}`").cast("string")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), named.alias("label"), F.col(f"`{embedding}`").alias("v")).where(sound(F.col("v")) & (F.size("v") > 0))
    order = (F.col("vec_id").asc_nulls_last(), "v")
    least = rows.orderBy(*order).limit(1).collect()
    width = len(least[0].v) if least else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} parts")
    rows = rows.where(F.size("v") == width)
    first = np.array([[int(np.floor(float(x) * scale)) for x in r.v] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = Codebooks.of(first.reshape(-1, parts, width // parts).transpose(1, 0, 2)) if len(first) else None
    if books is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, width // parts), np.int64)

    def step(source: DataFrame, books: Codebooks, work: Scratch, last: bool) -> DataFrame:
        shared = work.broadcast(books)
        fresh = "v" in source.columns

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            books, total = shared.value, {}
            k = books.entries.shape[1]
            with worker_memory("vector_codes"):
                for whole in batches:
                    for begin in range(0, whole.num_rows, 4096):
                        batch = whole.slice(begin, 4096)
                        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                        if fresh:
                            q, state = to_integers(column["v"], scale, width), None
                        else:
                            flat = lambda n, t: column[n].flatten().to_numpy(zero_copy_only=False).astype(t)  # noqa: B023,E731
                            q = flat("q", np.int64).reshape(-1, width)
                            codes = np.frombuffer(b"".join(column["codes"].to_pylist()), np.uint8).reshape(-1, parts)
                            state = State(codes, flat("upper", np.float32).reshape(-1, parts), flat("lower", np.float32).reshape(-1, parts))
                        x = q.reshape(-1, parts, width // parts)
                        new = assign(x, books, state)
                        if last:
                            nearest = books.entries[np.arange(parts)[None, :], new.codes]
                            error = ((x - nearest) ** 2).sum((1, 2))
                            yield pa.RecordBatch.from_arrays([column["vec_id"], column["label"], pa.array([c.tobytes().hex() for c in new.codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
                            continue
                        for p in range(parts):
                            for s, (n, sums) in partials(new.codes[:, p].astype(int) + p * k, x[:, p]).items():
                                m, before = total.get(s, (0, 0))
                                total[s] = (m + n, before + sums)
                        rows = len(q)
                        lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1).astype(t)))  # noqa: B023,E731
                        yield pa.RecordBatch.from_arrays(
                            [column["vec_id"], column["label"], lists(q, np.int32), pa.array([c.tobytes() for c in new.codes], pa.binary()), lists(new.upper, np.float32), lists(new.lower, np.float32), *[pa.nulls(rows, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]],
                            names=names,
                        )
                if total:
                    n = len(total)
                    empty = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(list(total), pa.int32()), pa.array([c for c, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], names=names)

        names = [c.strip().split(" ")[0] for c in _STATE.split(",")]
        return source.mapInArrow(run, "vec_id long, label string, code string, error long" if last else _STATE)

    source, before = rows.select("vec_id", "label", "v"), None
    for _ in range(rounds):
        work = Scratch(spark)
        state = work.settle(step(source, books, work, False))
        moved = _moved(books.entries, added(state.where("slot is not null").select("slot", "n", "sums")))
        if before is not None:
            before.drop()
        before, source = work, state.where("slot is null").drop("slot", "n", "sums")
        still = (moved == books.entries).all()
        books = Codebooks.of(moved, books.entries)
        if still:  # every further round would find the same
            break
    work = Scratch(spark)
    found = settle(step(source, books, work, True))
    work.drop()
    if before is not None:
        before.drop()
    return found, books.entries


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256; options and odd rows as in codes().

    label_error: the errors of all rows of one label, null labels together; rows of a hot label stay in the tasks they are in.
    """
    found, books = codes(vectors, vec_id, embedding, label, **options)
    keyed = found.select("vec_id", "code", "error", F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit("")).alias("label"))
    sums = settle(keyed.groupBy("no_label", "label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    out = join_one(keyed, sums, ["no_label", "label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(joined_sha256(books.reshape(-1))).alias("codebooks_sha256"))


def decode(found: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """``found`` with approximation: the vector that a code stands for, each component at the middle of its step."""
    entries = [[[(int(x) + 0.5) / scale for x in e] for e in part] for part in books.tolist()]
    table = F.from_json(F.lit(str(entries)), "array<array<array<double>>>")
    part = lambda p: F.get(F.get(table, F.lit(p)), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int"))
    return found.withColumn("approximation", F.flatten(F.array(*[part(p) for p in range(books.shape[0])])))
