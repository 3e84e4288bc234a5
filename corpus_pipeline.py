"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Every stage but the last returns the columns of documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.llm import lines, packing, quality, simhash, substring
from cellsight.llm.common import settle

#: SQL can't express the fingerprints and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go. Null and empty texts fail the rules; every row is judged for itself."""
    return quality.keep(_columns(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source are taken out; a document stays even if nothing of it does. Null texts stay null, with no characters counted."""
    return _columns(lines.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near-duplicates: fingerprints within three bits, then five-word shingles at 0.8.

    Rows that share an id stay or go together. All texts without words are alike and one of them stays.
    """
    return _columns(simhash.keep_dissimilar(settle(simhash.keep_one(docs), "distinct")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has too are taken out; texts that lose none stay as they are.

    Every row keeps its own text, also where ids repeat or are null (rows without an id lose nothing).
    """
    return _columns(substring.drop_repeats(_columns(docs)).withColumn("n_chars", F.char_length("text").cast("long")))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_boilerplate), ("near_duplicates", one_of_each), ("substrings", drop_repeats), ("packing", pack_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
