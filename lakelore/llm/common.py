"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white-space characters of the contracts, as a Java character class.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session has none (unit tests in local mode) a folder under the warehouse is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there.

    A written table survives lost executors, is compressed, and can be column-pruned, unlike a
    checkpointed RDD. Names never clash.
    """
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lakelore-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


class Scratch:
    """Tables and broadcasts of one piece of work, which go once its result is settled elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def settle(self, df: DataFrame) -> DataFrame:
        out, at = _written(df)
        self.paths.append(at)
        return out

    def broadcast(self, value):
        out = self.spark.sparkContext.broadcast(value)
        self.shared.append(out)
        return out

    def drop(self) -> None:
        """Nothing that is still to be read may depend on these."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for at in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        for b in self.shared:
            b.destroy()
        self.paths, self.shared = [], []
        _released()


#: What operators keep in a Python worker from task to task, by operator.
_KEPT: dict[str, dict] = {}


@contextmanager
def worker_memory(operator: str) -> Iterator[dict]:
    """A task's part in its Python worker's memory: what the operator keeps there from task to task, a dict.

    What other operators kept goes first, and what the task has freed goes back to the system at its end, so a worker
    that serves one operator after another never holds more than one of them needs.
    """
    for other in [k for k in _KEPT if k != operator]:
        del _KEPT[other]
    _released()
    try:
        yield _KEPT.setdefault(operator, {})
    finally:
        _released()


def _released() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filled(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def shared_fs(uri: str):
    """(pyarrow file system, path) of a URI or plain path, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct (file, row) that names each row and stays the same whenever the rows are read again.

    ``name`` is one that no column has (see free_name): a column of the user's is never taken for a row's id. Rows of files
    have their file and place in it; any other rows are written to the shared folder first, as a number given on the fly could
    change when a lost part is computed anew. Repeated rows stay apart.
    """
    from pyspark.errors import AnalysisException

    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}")
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", at.alias(name))
    except AnalysisException:
        return settle(docs).select("*", at.alias(name))


def identified(docs: DataFrame, columns: dict[str, Column], row: str | None = None) -> DataFrame:
    """__row and ``columns`` (name: expression) of each row. row: a column made by with_row_id(), else one is made here."""
    at = row or free_name(docs, "__row")
    source = docs if row else with_row_id(docs, at)
    return source.select(F.col(f"`{at}`").alias("__row"), *[c.alias(n) for n, c in columns.items()])


def join_one(big: DataFrame, small: DataFrame, keys: list[str], count: str = "n", share: int = 1000) -> DataFrame:
    """Inner join with a settled table of one row per key, of which ``count`` says how many rows of ``big`` have the key.

    Keys that more than a ``share``-th of all rows have, ``share`` at most, are broadcast, so the rows of a hot key stay in
    the tasks they are in. The others are dealt by key, at any size (a hint says so): such a table grows with the data, and a
    plan that broadcasts it while it is small would tell nothing of how it runs when it is not.
    """
    total, most = small.agg(F.sum(count), F.max(count)).first()
    least = max((total or 0) / share, 1000)
    if (most or 0) <= least:
        return big.join(small.drop(count).hint("merge"), keys)
    hot = small.where(F.col(count) > least).drop(count)
    dealt = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(count) <= least).drop(count).hint("merge"), keys)
    return big.join(F.broadcast(hot), keys).unionByName(dealt)


#: Cells of a table, at most, with which it is broadcast to a join: some MB.
FEW = 600_000


def if_few(small: DataFrame, each: Column | int = 3) -> DataFrame:
    """A settled table, to be broadcast if it is counted and small; ``each``: cells of a row. Else the join deals both sides by key."""
    cells = small.agg(F.sum(each if isinstance(each, Column) else F.lit(each))).first()[0] or 0
    return F.broadcast(small) if cells <= FEW else small


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name
