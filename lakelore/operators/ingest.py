"""Tables in, tables out: merges, deletions, the outcome of each document, the bookkeeping of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GOVERNANCE = ("content_type", "owner_id", "lifecycle_status")


def content_hash(markdown: Column) -> Column:
    return F.sha2(F.concat(F.lit("v2\n"), F.coalesce(markdown, F.lit(""))), 256)


def chunk_hash(headings: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.array_join(headings, "/"), F.lit("::"), text), 256)


def upsert(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("source_id", "external_id")) -> DataFrame:
    """The merged table, with content_changed: new, or another hash (null is a value). Columns of governance keep what they have."""
    a, b = current.alias("a"), incoming.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    new, old = F.col("b.content_hash").isNotNull(), F.col("a.content_hash")
    columns = []
    for c in dict.fromkeys([*current.columns, *incoming.columns]):
        if c in keys:
            columns.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c not in incoming.columns or c in GOVERNANCE and c in current.columns:
            columns.append((F.coalesce(f"a.{c}", f"b.{c}") if c in incoming.columns else F.col(f"a.{c}")).alias(c))
        elif c not in current.columns:
            columns.append(F.col(f"b.{c}").alias(c))
        else:
            columns.append(F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*columns, (new & ~old.eqNullSafe(F.col("b.content_hash"))).alias("content_changed"))


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the documents in ``new`` are replaced as a whole."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def delete_documents(documents: DataFrame, deletions: DataFrame) -> DataFrame:
    """Documents without those named by source_id and external_id."""
    return documents.join(deletions.select("source_id", "external_id").distinct(), ["source_id", "external_id"], "left_anti")


def purge_source(source_id: str, sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of the three tables without a source, and the storage keys of its originals."""
    gone = documents.where(F.col("source_id") == source_id)
    keys = gone.where("storage_key is not null").select("storage_key")
    left = chunks.join(gone.select("document_id"), "document_id", "left_anti")
    return sources.where(F.col("source_id") != source_id), documents.where(~F.col("source_id").eqNullSafe(F.lit(source_id))), left, keys


def set_storage(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """documents with storage_key as in ``stored`` (document_id, storage_key; null clears it), and previous_storage_key."""
    new = stored.select("document_id", F.col("storage_key").alias("__key"), F.lit(True).alias("__set"))
    joined = documents.join(new, "document_id", "left").withColumn("previous_storage_key", F.when(F.col("__set"), F.col("storage_key")))
    return joined.withColumn("storage_key", F.when(F.col("__set"), F.col("__key")).otherwise(F.col("storage_key"))).drop("__key", "__set")


def move_cursors(sources: DataFrame, moved: DataFrame) -> DataFrame:
    """sources with cursor, last_synced_at and updated_at of ``moved`` (source_id, cursor, synced_at) where it has them."""
    joined = sources.join(moved.withColumnsRenamed({"cursor": "__cursor"}), "source_id", "left")
    return joined.withColumns({
        "cursor": F.coalesce("__cursor", "cursor"), "last_synced_at": F.coalesce("synced_at", "last_synced_at"), "updated_at": F.coalesce("synced_at", "updated_at"),
    }).drop("__cursor", "synced_at")


def invalidate(documents: DataFrame, which: Column) -> DataFrame:
    """An empty hash makes the next run take a document as changed."""
    return documents.withColumn("content_hash", F.when(which, "").otherwise(F.col("content_hash")))


def claim_uploads(pending: DataFrame, n: int) -> DataFrame:
    """The n oldest uploads that are pending, as ingested. Where several claim at once, see claims.Claims."""
    return pending.where("status = 'pending'").orderBy("created_at", "id").limit(n).withColumn("status", F.lit("ingested"))


def job_counters(deltas: DataFrame) -> DataFrame:
    """Totals per job of a log of counter changes."""
    names = [c for c in deltas.columns if c != "job_id"]
    return deltas.groupBy("job_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in names])


def source_class(data_class: Column) -> Column:
    """A for general and sop, B for research, D for client confidential; anything else is an error."""
    known = F.when(data_class.isin("general", "sop"), "A").when(data_class == "research", "B").when(data_class == "client_confidential", "D")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown data class: "), F.coalesce(data_class, F.lit("null")))))


def document_class(source: Column, identifiers: Column, excluded_path: Column, flagged: Column) -> Column:
    """A struct: doc_class (never below the source's; D with an identifier, C with a path or verdict), quarantined, reasons."""
    by_identifier = F.size(F.array_intersect(identifiers, F.array(*map(F.lit, ("ssn", "ein", "routing", "card"))))) > 0
    base = F.coalesce(source, F.lit("D"))
    klass = F.greatest(base, F.when(by_identifier, "D").when(excluded_path | flagged, "C").otherwise("A"))
    reasons = F.array_compact(F.array(
        F.when(base.isin("C", "D"), F.concat(F.lit("source:"), base)), F.when(by_identifier, F.concat(F.lit("identifiers:"), F.array_join(F.array_sort(identifiers), ","))),
        F.when(excluded_path, F.lit("path")), F.when(flagged, F.lit("semantic")),
    ))
    return F.struct(klass.alias("doc_class"), klass.isin("C", "D").alias("quarantined"), reasons.alias("reasons"))


#: Fragments of paths that are never taken in, in the order in which they are looked for.
EXCLUDED_PATHS = (
    "client service package files",
    "client package pricing",
    "billing & production analysis",
    "billing and production analysis",
    "billing analysis",
    "production time analysis",
    "engagement letter",
    "/va disability",
)


def excluded_by(path: Column, fragments: tuple[str, ...] = EXCLUDED_PATHS) -> Column:
    """The first fragment that a path holds, in any case; null if none."""
    lowered, found = F.lower(path), F.lit(None).cast("string")
    for f in reversed(fragments):
        found = F.when(F.contains(lowered, F.lit(f.lower())), f).otherwise(found)
    return found


def outcomes(documents: DataFrame) -> DataFrame:
    """``documents`` with status and cause, each document leaving by the first gate that stops it.

    Columns: source_class, path, parse_error, redaction (null: it failed, so nothing of the document may be seen), quarantined,
    content_changed, embedded. Every row stays: counters and logs are made of the same table.
    """
    reason = excluded_by(F.col("path"))
    gates = (
        ("blocked", F.col("source_class").isin("C", "D"), F.lit("class")),
        ("blocked", reason.isNotNull(), F.concat(F.lit("path: "), reason)),
        ("failed", F.col("parse_error").isNotNull(), F.col("parse_error")),
        ("quarantined", F.col("redaction").isNull(), F.lit("scan failed")),
        ("quarantined", F.col("quarantined"), F.lit("class")),
        ("unchanged", ~F.col("content_changed") & F.col("embedded"), F.lit(None).cast("string")),
    )
    status, cause = F.lit("indexed"), F.lit(None).cast("string")
    for name, test, why in reversed(gates):
        hit = F.coalesce(test, F.lit(False))
        status, cause = F.when(hit, name).otherwise(status), F.when(hit, why).otherwise(cause)
    return documents.withColumns({"status": status, "cause": cause})


def run_counters(outcome: DataFrame) -> DataFrame:
    """source_id and the number of documents by outcome."""
    names = ("skipped", "blocked", "quarantined", "failed", "unchanged", "indexed")
    return outcome.groupBy("source_id").agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def gate_quarantines(log: DataFrame, newest: int = 20) -> DataFrame:
    """Per source the ``newest`` documents blocked because a gate failed: source_id, external_id, latest_reason, attempts, last_at."""
    hits = log.where("action = 'blocked' and rejection_reason like 'gate:%'")
    groups = hits.groupBy("source_id", "external_id").agg(
        F.max_by("rejection_reason", F.struct("created_at", "event_id")).alias("latest_reason"), F.count("*").alias("attempts"), F.max("created_at").alias("last_at")
    )
    return _first(groups, newest, F.desc("last_at"), "external_id")


def retryable(log: DataFrame, attempts: int = 5, most: int = 50) -> DataFrame:
    """Per source the ``most`` documents longest failing: source_id, external_id, failures, first_failed.

    Failures count since the document was last ingested or blocked; at ``attempts`` of them it is given up.
    """
    key = ["source_id", "external_id"]
    resolved = log.where("action in ('ingested', 'blocked')").groupBy(*key).agg(F.max("created_at").alias("at"))
    failed = log.where("action = 'failed'").join(resolved, key, "left").where("at is null or created_at > at")
    groups = failed.groupBy(*key).agg(F.count("*").alias("failures"), F.min("created_at").alias("first_failed"))
    return longest_failing(groups.where(F.col("failures") < attempts), most)


def longest_failing(failing: DataFrame, most: int) -> DataFrame:
    """Per source the ``most`` documents that have failed for longest."""
    return _first(failing, most, "first_failed", "external_id")


def _first(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    return numbered.where(F.col("__n") <= n).drop("__n")


def orphans(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored objects (storage_key, its first part the source) of no live source. An empty list of sources is an error, not a sweep."""
    if sources.isEmpty():
        raise ValueError("no live source: refusing to sweep")
    prefix = F.substring_index("storage_key", "/", 1)
    return objects.withColumn("source_id", prefix).join(sources.select("source_id"), "source_id", "left_anti")


def without_chunks(documents: DataFrame, chunks: DataFrame, model: str | None = None) -> DataFrame:
    """Documents that have no chunk (of a model)."""
    some = chunks if model is None else chunks.where(F.col("embedding_model") == model)
    return documents.join(some.select("document_id"), "document_id", "left_anti")


def page(documents: DataFrame, after: object | None, n: int, source_id: str | None = None, with_text: bool = False, key: str = "document_id") -> DataFrame:
    """The next n documents by key."""
    out = documents if source_id is None else documents.where(F.col("source_id") == source_id)
    if after is not None:
        out = out.where(F.col(key) > after)
    return (out if with_text else out.drop("markdown", "text")).orderBy(key).limit(n)


def versioned(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents by newest version only: last write wins by at, then seq."""
    every = current.unionByName(incoming, allowMissingColumns=True)
    order = Window.partitionBy("source_id", "external_id").orderBy(F.desc("at"), F.desc("seq"))
    return every.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def attempts_report(documents: DataFrame, which: Column) -> DataFrame:
    """How many documents a forced run would take up again: total, and those that ``which`` picks."""
    return documents.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(which).alias("to_reset"))
