"""Vectors as integers: which count, exact squared distances, and sums of any size. Shared by the operators on vectors."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there, and none of its components is null, NaN or infinite."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def to_integers(column, scale: int, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` components as floor(scale * x), rows x width.

    Squared distances must fit 64 bits: a component of more than about 2**30 / sqrt(width) as an integer is an error.
    """
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * scale)
    if x.size and np.abs(x).max() > _most(width, 62):
        raise ValueError("a component is too large: squared distances would not fit 64 bits")
    return x.astype(np.int64)


def _most(width: int, bits: int) -> float:
    """Components up to this have squared distances below 2**bits."""
    return (2.0**bits / (4 * max(width, 1))) ** 0.5


def exact(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats, which is faster, if all sums of products are then integers below 2**52; else as 64-bit integers."""
    most = max((int(np.abs(a).max()) for a in (points, book) if a.size), default=0)
    kind = np.float64 if most <= _most(points.shape[-1], 52) else np.int64
    return points.astype(kind), book.astype(kind)


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries, of what exact() gives."""
    return (points * points).sum(1)[:, None] - 2 * (points @ book.T) + (book * book).sum(1)[None, :]


def added(partial: DataFrame, slot: str = "slot") -> dict[int, tuple[int, list[int]]]:
    """slot: (n, sums) of rows of slot, n, sums (array) from many tasks; added up on executors, as decimals, so at any size.

    The driver gets a row for each slot and component: as many as all centroids have components, whatever the input.
    """
    wide = partial.select(slot, "n", F.posexplode("sums").alias("at", "x"))
    total = wide.groupBy(slot, "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in total.collect():
        out.setdefault(r[slot], (int(r["n"]), {}))[1][r["at"]] = int(Decimal(r["x"]))
    return {s: (n, [x[i] for i in range(len(x))]) for s, (n, x) in out.items()}


def partials(slots: np.ndarray, points: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """slot: (n, sums) of a task's own rows."""
    order = np.argsort(slots, kind="stable")
    found, begins = np.unique(slots[order], return_index=True)
    sums = np.add.reduceat(points[order], begins, axis=0) if len(found) else points[:0]
    counts = np.diff([*begins, len(slots)])
    return {int(s): (int(n), x) for s, n, x in zip(found, counts, sums, strict=True)}


def joined_sha256(numbers) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in numbers).encode()).hexdigest()
