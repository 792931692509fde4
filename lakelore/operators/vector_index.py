"""A stored index of vectors: chunks dealt into lists by the nearest centroid, of which a query reads a few.

Centroids are trained once, on a bounded sample. A list lies in a folder of its own, in blocks of about ``BLOCK`` chunks; a list that
holds much of the corpus has many blocks, so it is many tasks. A query goes to the lists whose centroids are nearest to it, and there with the other
queries of a block: each block of a list is multiplied with each block of queries that asks for the list. A batch of many queries is dealt into groups that ask for
much the same lists, and these meet shelves of lists (retrieval.top_of_pairs). Scores are those of
retrieval.dense_top(), which stays the exact way; what is approximate is which lists are read.

How many lists a query reads is measured, not guessed: when centroids are trained, the nearest neighbours of some sampled chunks among the others are looked
for, and enough lists are read to hold ``RECALL`` of them. Where vectors fall into groups that are a few lists, where they don't it is many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.embedding import finite
from ..session import settled
from . import retrieval
from .segments import Segments

#: Chunks of a block and queries of a block, about; rows to train on and lists, at most.
BLOCK, QUERIES, SAMPLE, LISTS = 1024, 256, 16_384, 1024
#: Sampled chunks whose neighbours are looked for, among so many others, and the share of these neighbours that must be found.
ASKED, AMONG, RECALL = 256, 4096, 0.95
#: Bytes of a batch's query vectors, each as often as it reads a list, with which they are broadcast.
FEW_BYTES = 16 << 20


def ef_search(pool: int, configured: int = 100) -> int:
    """Candidates that a search weighs: as configured, or the pool if that is more, between 40 and 1000."""
    return sorted((40, max(configured, pool), 1000))[1]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def probes_for(some: np.ndarray, centroids: np.ndarray, k: int = 10) -> int:
    """The fewest lists, nearest first, in which ``RECALL`` of the k nearest others of some vectors lie."""
    x, c = _unit(some), _unit(centroids)
    asked = x[:ASKED]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf  # itself
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    lists = (x @ c.T).argmax(1)[found]
    return int(np.quantile(np.take_along_axis(place, lists, axis=1), RECALL, method="higher")) + 1


class VectorIndex(Segments):
    """Chunks (chunk_id, source_id, embedding) under a folder. Null vectors, vectors of zeros, of another length than the centroids or with components that aren't
    finite match nothing and are left out."""

    def train(self, chunks: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> int | None:
        """Train centroids on ``sample`` chunks at most, those of least hash; ``lists``: else the root of the chunks' number, ``LISTS`` at most."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        good = chunks.where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select("chunk_id", "embedding")
        rows = settled(good.orderBy(F.xxhash64("chunk_id")).limit(sample))
        total = good.count()
        lists = lists or max(1, min(LISTS, int(total**0.5), rows.count()))
        model = KMeans(k=lists, maxIter=10, seed=seed, distanceMeasure="cosine", featuresCol="v").fit(rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
        centroids = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        folder = self.log.write(self.spark.createDataFrame(centroids, "list int, centroid array<double>").coalesce(1), "centroids")
        some = np.array([r.embedding for r in rows.limit(AMONG).collect()], float)
        return self.log.commit({"kind": "centroids", "folders": [folder], "centroids": folder, "probes": probes_for(some, np.array([c for _, c in centroids]))})

    def _centroids(self) -> np.ndarray:
        named = [e["centroids"] for e in self.log.entries() if "centroids" in e]
        if not named:
            raise ValueError("no centroids: train first")
        rows = self.spark.read.parquet(f"{self.log.path}/{named[-1]}").orderBy("list").collect()  # LISTS at most
        return np.array([r.centroid for r in rows])

    def _about(self) -> dict:
        """What each entry repeats of the centroids: their folder, and how many lists a query reads."""
        return [{k: e[k] for k in ("centroids", "probes")} for e in self.log.entries() if "centroids" in e][-1]

    def _listed(self, chunks: DataFrame) -> DataFrame:
        """chunks with list."""
        shared = self.spark.sparkContext.broadcast(_unit(self._centroids()))
        rows = chunks.where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select("chunk_id", "source_id", F.col("embedding").cast("array<float>").alias("embedding"))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            c = shared.value
            for batch in batches:
                batch = batch.filter(pa.array([len(v) == c.shape[1] for v in batch.column(2)], pa.bool_()))
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((_unit(x) @ c.T).argmax(1), pa.int32())], names=[*batch.schema.names, "list"])

        return rows.mapInArrow(run, f"chunk_id {dict(rows.dtypes)['chunk_id']}, source_id string, embedding array<float>, list int")

    def _blocks(self, listed: DataFrame) -> DataFrame:
        listed = settled(listed)
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a list
        rows = listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")))
        found = rows.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "source_id", "embedding"))).alias("rows"))
        field = lambda n: F.transform("rows", lambda r: r[n])
        blocks = found.select("list", "block", field("chunk_id").alias("ids"), field("source_id").alias("sources"), F.flatten(field("embedding")).alias("vectors"))
        return blocks.repartitionByRange("list", "block").sortWithinPartitions("list", "block")

    def add(self, chunks: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
        """Index chunks as a segment of its own; its version, or None for a batch that is there already."""
        if self.log.committed(writer, batch):
            return None
        return self._added(self._blocks(self._listed(chunks)), "lists", ("list",), writer, batch, **self._about())

    def remove(self, chunk_ids: DataFrame, writer: str | None = None, batch: int | None = None) -> int | None:
        """Take chunks out, by the blocks that hold them; a chunk that is added later counts again."""
        if self.log.committed(writer, batch):
            return None
        live = self.live()
        if not live:
            return None
        places = self.scan(live, ["list", "block", F.explode("ids").alias("chunk_id")]).join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        folder = self.log.write(places, "removed")
        return self.log.commit({"kind": "removed", "folders": [folder]}, writer, batch)

    def _live_blocks(self, columns: list[str], lists: list[int] | None = None) -> DataFrame:
        """Blocks with segment and gone: ids in them that were taken out."""
        blocks = self.scan(self.live(), ["list", "block", *columns], None if lists is None else F.col("list").isin(lists))
        folders = [f"{self.log.path}/{e['folders'][0]}" for e in self.log.entries() if e["kind"] == "removed"]
        if not folders:
            return blocks.withColumn("gone", F.expr("cast(null as array<bigint>)"))
        gone = self.spark.read.parquet(*folders).groupBy("segment", "list", "block").agg(F.collect_set("chunk_id").alias("gone"))
        return blocks.join(gone, ["segment", "list", "block"], "left")

    def merge(self) -> int | None:
        """Put all segments together, without what was taken out. What is added meanwhile stays a segment."""
        covers = max(self.log.versions(), default=-1)
        if not self.live():
            return None
        return self._merged(self._blocks(self._live_chunks()), "lists", ("list",), covers, **self._about())

    def _live_chunks(self, lists: list[int] | None = None) -> DataFrame:
        """chunk_id, source_id, embedding, list of what counts."""
        width = self._centroids().shape[1]
        rows = self._live_blocks(["ids", "sources", "vectors"], lists).select("list", "gone", F.posexplode("ids").alias("at", "chunk_id"), "sources", "vectors")
        rows = rows.where(~F.coalesce(F.array_contains("gone", F.col("chunk_id")), F.lit(False)))
        return rows.select("chunk_id", F.get("sources", F.col("at")).alias("source_id"), F.slice("vectors", F.col("at") * width + 1, F.lit(width)).alias("embedding"), "list")

    def _asked(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
        """query_id, scope, embedding, lists, reads: each query with the lists that it reads, nearest first, and as bits by number."""
        sizes = {r[0]: r[1] for r in self.scan(self.live(), ["list", F.size("ids").alias("n")]).groupBy("list").agg(F.sum("n")).collect()}  # a row a list
        centroids = _unit(self._centroids())
        shared = self.spark.sparkContext.broadcast((centroids, np.array([sizes.get(i, 0) for i in range(len(centroids))])))
        wanted, least, usual = ef_search(k), probes, self._about()["probes"]

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            c, n = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    q = np.array(some.column(2).to_pylist(), float).reshape(some.num_rows, -1)
                    if not np.isfinite(q).all():
                        raise ValueError("query vector is not finite")
                    if q.shape[1] != c.shape[1]:
                        raise ValueError(f"a query vector has {q.shape[1]} components, the index {c.shape[1]}")
                    order = np.argsort(-(_unit(q) @ c.T), axis=1, kind="stable")
                    enough = (np.cumsum(n[order], axis=1) < wanted).sum(1) + 1
                    take = np.minimum(np.maximum(enough, usual) if least is None else np.full(len(q), least), len(c))
                    lists, reads = [order[i, : take[i]] for i in range(len(q))], np.zeros(order.shape, bool)
                    for i, read in enumerate(lists):
                        reads[i, read] = True
                    bits = [r.tobytes() for r in np.packbits(reads, axis=1)]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(bits, pa.binary())], names=["query_id", "scope", "embedding", "lists", "reads"])

        rows = queries.where(F.col("embedding").isNotNull()).select("query_id", "scope", F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, scope array<string>, embedding array<double>, lists array<int>, reads binary").where(F.exists("embedding", lambda x: x != 0))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
        """query_id, chunk_id, score, rank, as retrieval.dense_top() gives them for the chunks of the lists that are read.

        probes: lists of a query; else as many as were measured to be enough, or more if those hold fewer than ef_search(k) chunks. A query vector that isn't finite, or of
        another length, is an error.
        """
        schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id long, score double"
        if not self.live():
            return retrieval.ranked(self.spark.createDataFrame([], schema), k)
        asked = settled(self._asked(queries, k, probes))
        if (asked.agg(F.sum(F.size("lists").cast("long") * F.size("embedding") * 8)).first()[0] or 0) > FEW_BYTES:
            return retrieval.top_of_pairs(asked, self._live_chunks(), k, digits)
        each = asked.select("query_id", "scope", "embedding", F.explode("lists").alias("list"))
        per_list = each.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
        lists = sorted(r["list"] for r in per_list.collect())  # a row a list
        groups = each.join(F.broadcast(per_list), "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        one = F.sort_array(F.collect_list(F.struct("query_id", "scope", "embedding")))
        field = lambda n: F.transform("rows", lambda r: r[n])
        groups = groups.groupBy("list", "group").agg(one.alias("rows")).select("list", field("query_id").alias("asked"), field("scope").alias("scopes"), F.flatten(field("embedding")).alias("wanted"))
        blocks = self._live_blocks(["ids", "sources", "vectors"], lists)
        pairs = blocks.join(F.broadcast(groups), "list")
        kind = dict(blocks.select(F.explode("ids").alias("x")).dtypes)["x"]

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            def part(column, i: int, kind) -> np.ndarray:
                """A row's list as numbers, without a Python object for each."""
                begin, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
                return column.values[begin:end].to_numpy(zero_copy_only=False).astype(kind)

            for batch in batches:
                ids_, sources, vectors, asked_, scopes_, wanted, gone = batch.columns
                for i in range(batch.num_rows):
                    ids, names = np.array(ids_[i].as_py()), asked_[i].as_py()
                    x, q = part(vectors, i, float).reshape(len(ids), -1), part(wanted, i, float).reshape(len(names), -1)
                    sources_of = sources[i].as_py()
                    if gone[i].as_py():
                        left = ~np.isin(ids, gone[i].as_py())
                        ids, x, sources_of = ids[left], x[left], [s for s, there in zip(sources_of, left, strict=True) if there]
                    nearest = retrieval.Nearest(q, [None if a is None else frozenset(a) for a in scopes_[i].as_py()], k, digits)
                    nearest.add(x, ids, sources_of)
                    best = nearest.best
                    if len(best.query):
                        yield pa.RecordBatch.from_pydict({"query_id": [names[j] for j in best.query], "chunk_id": best.chunk.tolist(), "score": best.score})

        hits = pairs.select("ids", "sources", "vectors", "asked", "scopes", "wanted", "gone").mapInArrow(run, schema.replace("chunk_id long", f"chunk_id {kind}"))
        return retrieval.ranked(hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found, recall of hit lists (query_id, chunk_id) against exact ones."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
