"""A corpus from documents to token files, in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphzone.llm import decontam, langid, mixing, neardup, tokens
from glyphzone.llm.common import materialize, new_path
from glyphzone.llm.queries import END_ID, table, vocabulary_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language stays undetermined: without text or without a letter. Learns from all that have a language.

    Repeated rows are judged alike; where no row has a language, all go; an empty table stays empty.
    """
    return langid.identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (0.8 and more), the one with the smallest doc_id.

    Of rows with one doc_id each is judged by its own text, and equal ones are one. Rows without a doc_id stay, as do those
    without text; an empty table stays empty; other columns, whatever their names, come along.
    """
    kept = neardup.near_duplicates(docs, num=80, den=100).where("kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.struct("*").alias("row"))
    one = rows.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return one.union(rows.where("doc_id is null")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which passages of the benchmark make up a twentieth or more.

    Null and empty texts are clean and stay; repeated rows are judged alike; an empty benchmark or table drops nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until sources have their target weights, in training order (of files and of rows in them).

    A null or empty text has no words and is never taken; null sources are one source; documents without a doc_id stand
    by their texts; equal rows count as documents of their own; an empty table stays empty.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files, which stay in a folder corpus-tokens-* of the shared one; gives each document's place, length and checksum in them.

    The files are in doc_id order, null ids last; beside them stays a table `order`, which says in training order where each
    document is. A null text is the end id alone; repeated rows are written again; an empty table gives no file.
    """
    return tokens.tokenize(docs, vocabulary_file(), END_ID, keep=new_path(spark, "corpus-tokens"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokenize)]

#: SQL can express neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again: the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
