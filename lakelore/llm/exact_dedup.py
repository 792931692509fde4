"""Operator 2: exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. Distinct blocks are sorted and get
integer names, their ranks; then adjacent pairs of names are sorted and named again, and again, until one name is left. Two
texts are equal iff they have as many blocks and the same last name: equal names at any level mean equal
text, as a name is given to one distinct block or pair only. Ranks don't depend on how rows are dealt to tasks.

Blocks travel once, for naming; after that a block is looked up by a 64-bit hash. Naming compares the
blocks themselves: a hash that two different blocks share is found there (its least and greatest block
differ) and those blocks are then looked up by their text. Every step aggregates before it shuffles or
joins a table with one row per key; rows of a hot key stay where they are, so a group of copies with a third
of all rows meets in no task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ASCII_SPACE, Scratch, filled, identified, join_one, settle


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(filled(text), ASCII_SPACE + "+", "")


def _named(distinct: DataFrame, work: Scratch, *keys: str) -> DataFrame:
    """Distinct rows with their rank from 0 in order of ``keys`` as name: a place in a sorted stretch, and what all stretches before it hold."""
    order = 2**33 - 1  # of the number Spark makes, the low bits count the rows of a task
    dealt = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = work.settle(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(order)).alias("at")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # one row per stretch
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("name", F.col("before") + F.col("at")).drop("part", "at", "before")


def identities(rows: DataFrame, text: str = "text", block: int = 1024, hash_bits: int = 64) -> DataFrame:
    """For rows of __row, doc_id and a text: __row, doc_id, n_chars, text_sha256, n_blocks, name. (n_blocks, name) is
    the identity of a text. hash_bits below 64 is for tests: it makes hashes collide.
    """
    work = Scratch(rows.sparkSession)
    plain = rows.select("__row", "doc_id", F.length(filled(F.col(text))).alias("n_chars"), normalised(F.col(text)).alias("plain"))
    cut = F.regexp_extract_all("plain", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    hashed = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(b)

    # Level 0: sort the blocks into names.
    blocks = plain.select("__row", F.posexplode(cut).alias("pos", "block")).withColumn("hash", hashed(F.col("block")))
    least = blocks.groupBy("hash").agg(F.min("block").alias("block"), F.max("block").alias("most"), F.count("*").alias("n"))
    names = work.settle(_named(least.select("hash", (F.col("block") != F.col("most")).alias("shared"), "n"), work, "hash"))
    per_row = settle(plain.select("__row", "doc_id", "n_chars", F.sha2("plain", 256).alias("text_sha256"), F.transform(cut, hashed).alias("keys")).withColumn("n_blocks", F.size("keys")))
    level = per_row.select("__row", "n_blocks", F.posexplode("keys").alias("pos", "hash"))
    level = join_one(level, names.where("not shared").select("hash", "name", "n"), ["hash"]).select("__row", "n_blocks", "pos", "name")
    if names.where("shared").limit(1).count():
        # Hashes that two blocks share: n * n / 2**65 of n blocks, unless someone makes them; their blocks are named by their text.
        doubtful = work.settle(blocks.join(names.where("shared").select("hash"), "hash", "left_semi"))
        texts = work.settle(_named(doubtful.groupBy("hash", "block").agg(F.count("*").alias("n")), work, "hash", "block"))
        found = join_one(doubtful, texts, ["hash", "block"]).select("__row", "pos", (-1 - F.col("name")).alias("name"))
        level = level.unionByName(found.join(per_row.select("__row", "n_blocks"), "__row").select("__row", "n_blocks", "pos", "name"))
    level = work.settle(level)

    # Then name pairs until every text has one name.
    longest = per_row.agg(F.max("n_blocks")).first()[0] or 0
    last = [per_row.where("n_blocks = 0").select("__row", F.lit(0).cast("long").alias("name"))]
    width = F.col("n_blocks")  # names a text still has
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        last.append(level.where(width == 1).select("__row", "name"))
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))  # noqa: B023,E731
        pairs = work.settle(
            level.where(width > 1)
            .groupBy("__row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(side(0).alias("a"), side(1).alias("b"))
            .withColumn("b", F.coalesce("b", F.lit(-(2**62))))
        )
        of_pair = work.settle(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), work, "a", "b"))
        level = join_one(pairs, of_pair, ["a", "b"])
        level = work.settle(level.select("__row", F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), F.col("half").alias("pos"), "name"))
    last.append(level.where(width == 1).select("__row", "name"))
    names_of = last[0]
    for more in last[1:]:
        names_of = names_of.unionByName(more)
    out = settle(per_row.drop("keys").join(names_of, "__row"))
    work.drop()
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 1024, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts, the one with the most code points stays, then the smallest doc_id
    (null last), then the first row. Null and empty texts, and texts of white space only, are equal to each other; a very long
    text is a row per block. An empty table gives no rows; other columns of ``docs`` don't matter, whatever their names.
    """
    rows = identified(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`")})
    found = identities(rows, "text", block, hash_bits)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row")))
    groups = settle(found.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")).withColumn("n", F.col("group_size")))
    return join_one(found, groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("best.row")).alias("kept"), "text_sha256"
    )
