"""Batches of queries against chunks: exact vector top-k, lexical top-k, and their fusion under a mandatory scope.

``queries``: query_id, text, embedding, and scope (array of source ids; null: unrestricted, empty: nothing).
``chunks``: chunk_id, document_id, source_id, text, embedding, lifecycle_status, embedding_provider, embedding_model.
Mandatory filters (scope, lifecycle, model) come before any limit, so what may not be seen takes no place in a pool.
Equal scores are ordered by chunk_id. Texts are analysed as English (stop words left out, Porter2 stems) unless ``analyse`` says
otherwise; queries and chunks must be analysed alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.english import english_tokens, stems
from ..session import settled
from .segments import if_few

#: Bytes of query vectors, at most, that are sent to every task at once; more queries are dealt to tasks in groups.
QUERY_BYTES = 4 << 20
#: Queries of a group and chunks of a shelf, fewer if they have more bytes as doubles than ``GROUP_BYTES``, a shelf four times that; shelves that a task meets with a group.
GROUP, SHELF, GROUP_BYTES, STRIPE = 2048, 4096, 1 << 20, 16
#: Scores, and exact scores, that a task holds at once.
CELLS, EXACT = 1 << 20, 1 << 16
#: Text to its tokens in order.
Analysis = Callable[[Column], Column]


@dataclass(frozen=True)
class Fusion:
    """Limits and weights of a fused search."""

    top_k: int = 12
    multiplier: int = 8
    most: int = 1000
    dense: float = 0.7
    sparse: float = 0.3
    k: int = 60
    missing: int = 1_000_000

    @property
    def pool(self) -> int:
        """Candidates per arm."""
        return max(self.top_k, min(self.top_k * self.multiplier, self.most))


def visible(chunks: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Active chunks of one embedding model."""
    out = chunks.where("lifecycle_status = 'active'")
    if provider is not None:
        out = out.where(F.col("embedding_provider") == provider)
    return out.where(F.col("embedding_model") == model) if model is not None else out


def in_scope(scope: Column, source_id: Column) -> Column:
    """Null scope: all; empty: none."""
    return scope.isNull() | F.coalesce(F.array_contains(scope, source_id), F.lit(False))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best k per query; Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best chunks of each query among those seen so far, by score, then chunk_id."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.query, self.chunk, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        """Scored chunks: a query's number, a chunk's id and a score each."""
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        chunk = chunk if self.chunk is None else np.concatenate([self.chunk, chunk])
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        begins = np.searchsorted(query, np.arange(self.queries))
        place = np.arange(len(query)) - begins[query]
        kept = place < self.k
        self.query, self.chunk, self.score = query[kept], chunk[kept], score[kept]
        last = place[kept] == self.k - 1
        self.least[self.query[last]] = self.score[last]


class Nearest:
    """The k nearest chunks of each query of a block, exactly, by block after block of chunks.

    Unit vectors are multiplied as 32-bit floats, ``CELLS`` of the products at once; only those that may be among a query's best, whatever the products' error,
    are scored in full. Vectors of zeros, and those that aren't finite, match nothing.
    """

    def __init__(self, vectors: np.ndarray, scopes: list[frozenset | None], k: int, digits: int):
        self.vectors, self.scopes, self.k, self.digits = vectors, scopes, k, digits
        self.norm, self.best = np.linalg.norm(vectors, axis=1), Best(len(vectors), k)
        self.unit = (vectors / np.where(self.norm > 0, self.norm, 1)[:, None]).astype(np.float32)
        self.free = all(s is None for s in scopes)
        # Of width + 2 roundings by 2 ** -24 of numbers of at most 1, for two products, and of scores to so many digits.
        self.slack = 10.0**-digits + (vectors.shape[1] + 8) * 2.0**-23

    def add(self, x: np.ndarray, ids: np.ndarray, sources: list, queries: np.ndarray | None = None) -> None:
        """x: vectors of chunks, one a row; queries: the numbers of those that meet them, else all."""
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        if not good.all():
            x, ids, norm, sources = x[good], ids[good], norm[good], [s for s, g in zip(sources, good, strict=True) if g]
        queries = np.arange(len(self.vectors)) if queries is None else queries
        queries = queries[self.norm[queries] > 0]
        unit = (x / norm[:, None]).astype(np.float32)
        for i in range(0, len(queries), GROUP):
            some = queries[i : i + GROUP]
            step = max(1, CELLS // len(some))
            for j in range(0, len(x), step):
                of = slice(j, j + step)
                near = self.unit[some] @ unit[of].T
                if not self.free:
                    near[~scoped([self.scopes[q] for q in some], sources[of])] = -np.inf
                self._those(some, near, x[of], norm[of], ids[of])

    def _those(self, some: np.ndarray, near: np.ndarray, x: np.ndarray, norm: np.ndarray, ids: np.ndarray) -> None:
        least = self.best.least[some] - self.slack
        fresh = np.isneginf(least)
        if near.shape[1] > self.k and fresh.any():  # of this block alone, none below its k-th best counts
            least[fresh] = np.partition(near[fresh], -self.k, axis=1)[:, -self.k] - self.slack
        query, at = np.nonzero((near >= least.astype(np.float32)[:, None]) & (near > -np.inf))
        for i in range(0, len(query), EXACT):
            q, c = some[query[i : i + EXACT]], at[i : i + EXACT]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.round(np.einsum("ij,ij->i", self.vectors[q], x[c]) / (self.norm[q] * norm[c]), self.digits) + 0.0
            counts = np.isfinite(score) & (score >= self.best.least[q])
            if counts.any():
                self.best.add(q[counts], ids[c[counts]], score[counts])


def scoped(scopes: list[frozenset | None], sources: list) -> np.ndarray:
    """queries x chunks: whether a query may see a chunk; each different scope meets each different source once."""
    kinds = {s: i for i, s in enumerate(dict.fromkeys(scopes))}
    places = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen = np.array([[scope is None or source in scope for source in places] for scope in kinds]).reshape(len(kinds), len(places))
    return seen[np.array([kinds[s] for s in scopes])][:, np.array([places[s] for s in sources])]


def dense_top(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score (cosine similarity, rounded), rank: the k nearest chunks in scope, exactly.

    Few queries (``QUERY_BYTES``) are sent to all tasks by way of the driver, and a task keeps k rows per query; any number more is dealt to tasks (see
    ``top_of_pairs``). A query vector that isn't finite is an error; vectors of zeros, and chunks of another length or with nulls,
    match nothing.
    """
    spark = chunks.sparkSession
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    asked = queries.where("embedding is not null").select("query_id", "scope", F.col("embedding").cast("array<double>").alias("embedding"))
    source = chunks.where("embedding is not null").select("chunk_id", "source_id", "embedding")
    rows = iter(asked.toLocalIterator())
    if (first := next(rows, None)) is None:
        return ranked(spark.createDataFrame([], schema), k)
    some = [first, *islice(rows, max(1, QUERY_BYTES // (8 * max(1, len(first.embedding)))) - 1)]
    if next(rows, None) is not None or len({len(r.embedding) for r in some}) > 1:
        finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        asked = asked.withColumn("embedding", F.when(finite, F.col("embedding")).otherwise(F.raise_error(F.lit("query vector is not finite")).cast("array<double>")))
        asked = asked.withColumns({"lists": F.array(F.lit(0)), "reads": F.lit(None).cast("binary")})
        whole = source.where(~F.exists("embedding", lambda x: x.isNull())).select(F.lit(0).alias("list"), "*")
        return top_of_pairs(asked, whole, k, digits)
    matrix = np.array([r.embedding for r in some], float)
    if not np.isfinite(matrix).all():
        raise ValueError("query vector is not finite")
    shared = spark.sparkContext.broadcast(([r.query_id for r in some], matrix, [None if r.scope is None else frozenset(r.scope) for r in some]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, q, scopes = shared.value
        nearest, types = Nearest(q, scopes, k, digits), None
        for batch in batches:
            types = batch.schema.field(0).type
            good = pa.array([len(v) == q.shape[1] and not v.values.null_count for v in batch.column(2)], pa.bool_())
            batch = batch.filter(good)
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            nearest.add(x, np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist())
        best = nearest.best
        if len(best.query):
            columns = [pa.array([ids[i] for i in best.query]), pa.array(best.chunk.tolist(), types), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    return ranked(source.mapInArrow(run, schema), k)


def _dealt(rows: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Settled rows with ``name``: which of the runs of about ``size`` they are in, by list, then by a hash of ``key``; and how many there are."""
    counts = rows.groupBy("list").count().orderBy("list").collect()  # a row a list
    begins = accumulate((r["count"] for r in counts), initial=0)
    places = rows.sparkSession.createDataFrame([(r["list"], b, r["count"]) for r, b in zip(counts, begins, strict=False)], "list int, __begin long, __n long")
    at = F.floor((F.col("__begin") + F.pmod(F.xxhash64(key), F.col("__n"))) / size).cast("int")
    return rows.join(F.broadcast(places), "list").withColumn(name, at).drop("__begin", "__n"), max(1, -(-sum(r["count"] for r in counts) // size))


def top_of_pairs(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank of dense_top() for any number of queries: groups of queries meet shelves of chunks.

    queries: query_id, scope, embedding (doubles), lists (array of int), reads (binary: a bit for each list by number, null: all). chunks: list, chunk_id,
    source_id, embedding; a query meets the chunks of its lists. A task holds a group and ``STRIPE`` shelves, and gives k rows a query of the group. Queries whose first
    list is the same, and chunks of a list, lie together, so a group that needs nothing of a shelf isn't sent there.
    """
    kind, named = dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {named}, chunk_id {kind}, score double"
    asked = settled(queries.select(F.col("lists")[0].cast("int").alias("list"), "query_id", "scope", "embedding", "lists", "reads"))
    rows = settled(chunks.select(F.col("list").cast("int").alias("list"), "chunk_id", "source_id", "embedding"))
    width = max(1, asked.agg(F.max(F.size("embedding"))).first()[0] or 0)
    fit = lambda most, n: max(1, min(most, n * GROUP_BYTES // (8 * width)))
    asked, groups = _dealt(asked, "query_id", fit(GROUP, 1), "group")
    rows, shelves = _dealt(rows, "chunk_id", fit(SHELF, 4), "shelf")
    field = lambda n: F.transform("rows", lambda r: r[n])
    one = F.collect_list(F.struct("query_id", "scope", "embedding", "reads"))
    left = asked.groupBy("group", F.size("embedding").alias("width")).agg(one.alias("rows"), F.array_distinct(F.flatten(F.collect_set("lists"))).alias("lists"))
    left = left.select("group", "width", "lists", field("query_id").alias("asked"), field("scope").alias("scopes"), F.flatten(field("embedding")).alias("wanted"), field("reads").alias("reads"))
    one = F.sort_array(F.collect_list(F.struct("list", "chunk_id", "source_id", "embedding")))
    right = rows.groupBy("shelf", F.size("embedding").alias("long")).agg(one.alias("rows"))
    right = right.select("shelf", "long", field("list").alias("of"), field("chunk_id").alias("ids"), field("source_id").alias("sources"), F.flatten(field("embedding")).alias("vectors"))
    left = left.repartitionById(groups, F.col("group"))
    right = right.repartitionById(-(-shelves // STRIPE), F.floor(F.col("shelf") / STRIPE).cast("int"))
    met = (F.col("width") == F.col("long")) & F.arrays_overlap("lists", F.array_distinct("of"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), met).select("group", "width", "asked", "scopes", "wanted", "reads", "of", "ids", "sources", "vectors")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def part(column, i: int) -> np.ndarray:
            """A row's list as numbers, without a Python object for each."""
            begin, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
            return column.values[begin:end].to_numpy(zero_copy_only=False)

        def found(names: list, nearest: Nearest) -> Iterator:
            best = nearest.best
            if len(best.query):
                yield pa.RecordBatch.from_pydict({"query_id": [names[j] for j in best.query], "chunk_id": best.chunk.tolist(), "score": best.score})

        at, names, nearest, reads = None, [], None, None
        for batch in batches:
            group_, width_, asked_, scopes_, wanted, reads_, of_, ids_, sources, vectors = batch.columns
            for i in range(batch.num_rows):
                this = (group_[i].as_py(), width_[i].as_py())
                if this != at:
                    if nearest is not None:
                        yield from found(names, nearest)
                    at, names = this, asked_[i].as_py()
                    scopes = [None if a is None else frozenset(a) for a in scopes_[i].as_py()]
                    nearest = Nearest(part(wanted, i).astype(float).reshape(len(names), -1), scopes, k, digits)
                    bits = reads_[i].as_py()
                    reads = None if bits[0] is None else np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(names), -1), axis=1).astype(bool)
                ids, of, x, names_of = np.array(ids_[i].as_py()), part(of_, i), part(vectors, i).astype(float).reshape(len(of_[i]), -1), sources[i].as_py()
                cuts = [0, *(np.nonzero(np.diff(of))[0] + 1), len(of)]
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    meet = None if reads is None else np.nonzero(reads[:, of[begin]])[0]
                    nearest.add(x[begin:end], ids[begin:end], names_of[begin:end], meet)
        if nearest is not None:
            yield from found(names, nearest)

    return ranked(pairs.mapInArrow(run, schema), k)


def postings(chunks: DataFrame, analyse: Analysis = english_tokens, wanted: DataFrame | None = None) -> DataFrame:
    """lexeme, chunk_id, source_id, places: how often a chunk has each token. Where many batches are asked, keep a LexicalIndex.

    wanted: only these lexemes (one column), as one batch of queries needs; the others go before anything is grouped. English
    stems are found once for each different word, not for each place of it.
    """
    plain = T.tokens if analyse is english_tokens else analyse
    words = chunks.select("chunk_id", "source_id", F.explode(plain(F.col("text"))).alias("lexeme"))
    if analyse is english_tokens:
        known = stems(words.select("lexeme").distinct())
        known = settled(known if wanted is None else known.join(wanted.withColumnRenamed("lexeme", "stem"), "stem", "left_semi"))
        words = words.join(if_few(known, 2), "lexeme").withColumn("lexeme", F.col("stem"))
    elif wanted is not None:
        words = words.join(wanted, "lexeme", "left_semi")
    return words.groupBy("lexeme", "chunk_id", "source_id").agg(F.count("*").alias("places"))


def asked_lexemes(queries: DataFrame, analyse: Analysis = english_tokens) -> DataFrame:
    """query_id, scope, lexeme: each query's different lexemes; a query of stop words alone has none and matches nothing."""
    return queries.select("query_id", "scope", F.explode(F.array_distinct(analyse(F.col("text")))).alias("lexeme"))


def sparse_top(queries: DataFrame, posted: DataFrame, k: int, analyse: Analysis = english_tokens) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks with any of a query's lexemes, by a tenth of the places they match."""
    hits = posted.join(asked_lexemes(queries, analyse), "lexeme").where(in_scope(F.col("scope"), F.col("source_id")))
    return ranked(hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum("places") * 0.1, 6).alias("score")), k)


def fuse(dense: DataFrame, sparse: DataFrame, options: Fusion) -> DataFrame:
    """Reciprocal rank fusion of two ranked hit lists, by a full outer join; a list that lacks a chunk ranks it last."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    part = lambda w, rank: F.lit(w) / (options.k + F.coalesce(rank, F.lit(options.missing)))
    return d.join(s, ["query_id", "chunk_id"], "full").select(
        "query_id", "chunk_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        (part(options.dense, "dense_rank") + part(options.sparse, "sparse_rank")).alias("rrf"),
    )


def best_per_query(fused: DataFrame, k: int) -> DataFrame:
    """The best k by fused score, with rank and score: the fused score as a share of the query's best."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "chunk_id")
    top = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    most = F.max("rrf").over(Window.partitionBy("query_id"))
    return top.withColumn("score", F.round(F.col("rrf") / F.greatest(most, F.lit(1e-9)), 6))


def hybrid(
    queries: DataFrame, chunks: DataFrame, options: Fusion | None = None, keep: Column | None = None, optional: str = "pre", model: tuple[str, str] | None = None,
    analyse: Analysis = english_tokens, posted: DataFrame | None = None, lexical: Callable[[DataFrame, int], DataFrame] | None = None, near: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Fused search: query_id, rank, chunk_id, document_id, source_id, score, dense_score, sparse_score, keyword_coverage.

    ``keep`` is an optional filter over columns of ``chunks``. optional="pre" applies it before the pools are cut (whole
    results); "post" applies it to the fused pools, and for queries left with fewer than top_k rows again to the largest pools.
    ``posted``: stored postings of the chunks that may be seen, analysed alike; else the batch's lexemes are posted here.
    ``lexical`` and ``near``: the search of a LexicalIndex or VectorIndex of the chunks that may be seen, in place of scans; not with
    an optional filter before the pools.
    """
    options = options or Fusion()
    seen = visible(chunks, *(model or ()))
    if keep is not None and optional == "pre":
        if lexical is not None or near is not None:
            raise ValueError("an index knows no optional filter: use optional='post'")
        seen = seen.where(keep)
        posted = None if posted is None else posted.join(seen.select("chunk_id"), "chunk_id", "left_semi")

    def search(some: DataFrame, pool: int) -> DataFrame:
        if lexical is not None:
            words = lexical(some, pool)
        else:
            words = sparse_top(some, posted if posted is not None else postings(seen, analyse, asked_lexemes(some, analyse).select("lexeme").distinct()), pool, analyse)
        fused = fuse(near(some, pool) if near is not None else dense_top(some, seen, pool), words, options)
        if keep is not None and optional == "post":
            fused = fused.join(seen.where(keep).select("chunk_id"), "chunk_id", "left_semi")
        return best_per_query(fused, options.top_k)

    top = search(queries, options.pool)
    if keep is not None and optional == "post" and options.pool < options.most:
        top = settled(top)
        enough = top.groupBy("query_id").count().where(F.col("count") >= options.top_k).select("query_id")
        short = queries.join(enough, "query_id", "left_anti")
        if short.limit(1).count():
            top = top.join(enough, "query_id", "left_semi").unionByName(search(short, options.most))
    # Coverage analyses the texts found, not those of all chunks; a semi join goes below the joins that chunks are made of, so no other text is moved.
    top = settled(top)
    hits = if_few(settled(top.select("chunk_id").distinct()), 1)
    asked = queries.select("query_id", F.array_distinct(analyse(F.col("text"))).alias("asked"))
    texts = chunks.select("chunk_id", "document_id", "source_id", "text").join(hits, "chunk_id", "left_semi")
    found = top.join(texts, "chunk_id").join(asked, "query_id")
    found = found.withColumn("has", F.array_distinct(analyse(F.col("text"))))
    return found.select(
        "query_id", "rank", "chunk_id", "document_id", "source_id", "score", "dense_score", "sparse_score", F.round(T.coverage(F.col("asked"), F.col("has")), 6).alias("keyword_coverage")
    )


def json_filter(json: Column, wanted: dict[str, list[str]]) -> Column:
    """Keys are all needed, one value of each suffices. A value matches a string, number or boolean of the same text."""
    if len(wanted) > 20 or any(len(k) > 64 or not 1 <= len(v) <= 50 or any(len(x) > 256 for x in v) for k, v in wanted.items()):
        raise ValueError("a filter has 20 keys of 64 characters at most, with 1 to 50 values of 256")
    out = F.lit(True)
    for key, values in wanted.items():
        found = F.get_json_object(json, f"$['{key}']")
        out = out & F.coalesce(found.isin(values), F.lit(False))
    return out


def passes_floor(dense: Column, coverage: Column, sparse: Column, least: float = 0.5, least_coverage: float = 0.5) -> Column:
    """Near enough by vector, or covering half of the query's words (any match at all where coverage is unknown)."""
    return (dense >= least) | F.coalesce(coverage >= least_coverage, sparse > 0)


def top_relevance(results: DataFrame) -> DataFrame:
    """query_id, top_score: the best finite dense score; null if there is none."""
    finite = F.when(~F.isnan("dense_score") & (F.abs("dense_score") < float("inf")), F.col("dense_score"))
    return results.groupBy("query_id").agg(F.max(finite).alias("top_score"))


def rerank(results: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order by an external score (query_id, chunk_id, rerank_score); rows without one keep their order behind those with one."""
    joined = results.join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank", "chunk_id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
