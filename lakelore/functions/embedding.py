"""Embeddings: the deterministic hashing embedder, normalisation, checks."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

PROVIDER, MODEL = "local", "hashed-words-768"


def finite(vector: Column) -> Column:
    """Whether all of a vector is finite."""
    return ~F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))


def normalised(vector: Column) -> Column:
    """Of length 1; an error for a vector of zeros or with a value that isn't finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(~finite(vector), F.raise_error(F.lit("vector is not finite"))).when(norm == 0, F.raise_error(F.lit("vector is all zeros"))).otherwise(
        F.transform(wide, lambda x: x / norm)
    )


@lru_cache(100_000)
def _slots(word: str, dimensions: int) -> tuple[int, int, float]:
    """Fixed algorithm: a word's SHA-256 gives, from its first 8 bytes as two big-endian numbers, two places, and from the ninth
    byte the sign at the second: plus if even."""
    d = hashlib.sha256(word.encode()).digest()
    return int.from_bytes(d[:4], "big") % dimensions, int.from_bytes(d[4:8], "big") % dimensions, 1.0 - 2.0 * (d[8] & 1)


def embed_words(text: str, dimensions: int):
    """Fixed algorithm: each run of two or more of a-z0-9 in the lower-cased text adds 1 at its first place and 1 with its sign at its second; then length 1 (no
    word: zeros)."""
    import numpy as np

    found = [(*_slots(w, dimensions), n) for w, n in Counter(re.findall("[a-z0-9]{2,}", text.lower())).items()]
    first, second, sign, n = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4
    out = np.bincount(first, n, dimensions) + np.bincount(second, sign * n, dimensions)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def embed(rows: DataFrame, text: str = "text", dimensions: int = 768) -> DataFrame:
    """``rows`` with embedding (array of float), embedding_provider and embedding_model; null text is embedded as empty."""
    names = list(rows.columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):  # some MB of vectors at a time
                some = batch.slice(at, 2000)
                vectors = np.array([embed_words(t.as_py() or "", dimensions) for t in some.column(names.index(text))], np.float32).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * dimensions), pa.array(vectors))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>").withColumns({"embedding_provider": F.lit(PROVIDER), "embedding_model": F.lit(MODEL)})
