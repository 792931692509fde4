"""A corpus pipeline: raw documents to packed sequences of ids.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelore.llm import langid, ngram_join, passage_dedup, quality
from lakelore.llm.common import free_name, if_few, settle, with_row_id
from lakelore.llm.queries import packed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_WORD = r"text rlike '[^\\x20\\x09-\\x0D]'"


def _those(docs: DataFrame, judged: Callable[[DataFrame, str], DataFrame], stays: str) -> DataFrame:
    """The rows of ``docs`` but those that ``judged`` (given them and the name of their row ids) does not mark by ``stays``."""
    row = free_name(docs, "__row")
    rows = with_row_id(docs, row)
    gone = settle(judged(rows, row).where(f"not {stays}").select(row))
    return rows.join(if_few(gone), row, "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or a text) go; an unknown lang is filled in with the one found, if any was learned.

    Repeated rows stay, each judged by its text alone; a text of any length is read whole; an empty table gives no rows; columns
    beyond those of ``documents`` are left out, whatever their names.
    """
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs.select(*COLUMNS))).where(F.col("text").rlike(r"\p{L}"))
    return found.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(langid.UNDETERMINED)))).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic or of low quality go.

    Null and empty texts are judged by their site; null sources and langs are sites of their own; repeated rows are judged each;
    a probability just at the threshold stays; an empty table gives no rows; other columns are left out, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _those(docs.select(*COLUMNS), lambda rows, row: quality.classify(rows, labels, row=row), "kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of 50 words or more are deleted: runs of lines first, then passages within lines. Documents of which nothing is left go.

    Of equal runs the one of least doc_id stays (null first), then the earlier row, then the earlier place; repeated rows are copies.
    Null and empty texts stay as they are; an empty table gives no rows; other columns are left out, whatever their names.
    """
    left = passage_dedup.dedup(docs.select(*COLUMNS))
    return left.where(f"removed_words = 0 or {_WORD}").withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that of least doc_id (null last), of repeated rows the first.

    Texts without a word, null ones included, are linked with nothing and stay; an empty table gives no rows; other columns are
    left out, whatever their names.
    """
    return _those(docs.select(*COLUMNS), lambda rows, row: ngram_join.near_duplicates(rows, row=row), "stays")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids, 64 pieces and 4032 loss-bearing ids.

    Null and empty texts are one id each; repeated rows and null doc_ids are packed like any other; an empty table gives no rows;
    other columns are left out, whatever their names.
    """
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", clean),
    ("line_dedup", lines),
    ("near_duplicates", near),
    ("packing", pack),
]

#: No SQL can say what a trained model decides; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
