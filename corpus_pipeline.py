"""A training-data pipeline over the table documents: each stage is one operator of plumbline.llm.

Every stage takes documents with any further columns, of any names, and passes them on (the last one gives tokens). An
empty table gives an empty table. What a stage does with nulls, ties and repeated rows its function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, ngram_join, quality_rules, sentence_pieces
from plumbline.llm.common import table
from plumbline.sources.folders import new_folder, remove

#: Near duplicates: five words and a similarity of 0.8.
SHINGLE_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The rules are learned from the labelled documents among docs.

    A null, empty or very short text goes. Repeated rows are kept or go together, a null doc_id has no label.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts, n_chars follows; a text of which nothing is left goes.

    Of rows with equal doc_id and text one counts as first; null ids come before all others. A null text, or one without
    a word, that loses no line stays as it is.
    """
    cut = line_dedup.dedup_lines(docs)
    left = (F.col("removed_lines") == 0) | (F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r")) != "")
    n_chars = F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast("long")
    return cut.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one of least doc_id.

    Rows that share this doc_id all stay, as do rows without words, with a null text or with a null doc_id.
    """
    return ngram_join.first_of_each(docs, SHINGLE_WORDS, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in as many copies (none to three) as the targets of their sources ask for.

    A null source is one of its own, the last; a null text has no words; repeated rows are documents of their own; ties
    of size stand by doc_id. A source without words comes to nothing.
    """
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix. A null or empty text has none; repeated rows are alike, null ids stay."""
    return sentence_pieces.encode_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("sentence_pieces", pieces)]

#: SQL can't express the learned rules and the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents.

    Each stage but the last is written once to the shared folder and read again by the next; a stage's files are deleted
    when the next one is written. Those of the last but one stay, as the result reads them.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if held:
            remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
