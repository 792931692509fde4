"""Vectors by content and model: what has one is never computed again, and which model is searched changes at once.

A vector belongs to a chunk's hash under a model, so equal chunks share it and an unchanged chunk keeps it. A run computes those that a
model lacks and commits them; the model that searches see is an entry of the log, so a new model is filled while the old one answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.commits import CommitLog


class EmbeddingStore:
    """chunks: chunk_hash, text and more. embed: rows with text to rows with embedding."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def _vectors(self, provider: str, model: str, vectors: bool = True) -> DataFrame:
        """chunk_hash and embedding under a model, once each."""
        live: list[dict] = []
        for e in self.log.entries():
            if e.get("model") != model or e.get("provider") != provider:
                continue
            if e["kind"] == "pruned":
                live = [x for x in live if x["version"] > e["covers"]]
            if e["kind"] in ("vectors", "pruned"):
                live.append(e)
        folders = [f"{self.log.path}/{e['folders'][0]}" for e in live]
        schema = "chunk_hash string, embedding array<float>"
        stored = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        if not vectors:
            return stored.select("chunk_hash").distinct()
        # Two runs at once may both have made a vector: the same one.
        return stored.groupBy("chunk_hash").agg(F.min("embedding").alias("embedding")) if len(folders) > 1 else stored.select("chunk_hash", "embedding")

    def missing(self, chunks: DataFrame, provider: str, model: str) -> DataFrame:
        """chunk_hash, text of different chunks that have no vector under a model."""
        different = chunks.groupBy("chunk_hash").agg(F.min("text").alias("text"))
        return different.join(self._vectors(provider, model, vectors=False), "chunk_hash", "left_anti")

    def refresh(self, chunks: DataFrame, provider: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Compute and commit what a model lacks; how many vectors that were."""
        made = embed(self.missing(chunks, provider, model)).select("chunk_hash", F.col("embedding").cast("array<float>").alias("embedding"))
        folder = self.log.write(made, "vectors")
        n = self.spark.read.parquet(f"{self.log.path}/{folder}").count()  # from the files' footers
        if n:
            self.log.commit({"kind": "vectors", "provider": provider, "model": model, "folders": [folder]})
        return n

    def activate(self, provider: str, model: str) -> int | None:
        """From now on searches see this model."""
        return self.log.commit({"kind": "active", "provider": provider, "model": model, "folders": []})

    def active(self) -> tuple[str, str] | None:
        named = [(e["provider"], e["model"]) for e in self.log.entries() if e["kind"] == "active"]
        return named[-1] if named else None

    def embedded(self, chunks: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
        """``chunks`` with embedding, embedding_provider and embedding_model of a model, the active one by default; null where a chunk has no vector yet."""
        if model is None:
            provider, model = self.active() or (None, None)
        rows = chunks.drop("embedding", "embedding_provider", "embedding_model")
        if model is None:
            return rows.withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_provider": F.lit(None).cast("string"), "embedding_model": F.lit(None).cast("string")})
        found = rows.join(self._vectors(provider, model), "chunk_hash", "left")
        has = F.col("embedding").isNotNull()
        return found.withColumns({"embedding_provider": F.when(has, F.lit(provider)), "embedding_model": F.when(has, F.lit(model))})

    def prune(self, chunks: DataFrame, provider: str, model: str) -> int | None:
        """Keep the vectors of a model that some chunk still has; what is added meanwhile stays."""
        covers = max(self.log.versions(), default=-1)
        kept = self._vectors(provider, model).join(chunks.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
        folder = self.log.write(kept, "vectors")
        return self.log.commit({"kind": "pruned", "provider": provider, "model": model, "covers": covers, "folders": [folder]})
