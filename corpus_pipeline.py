"""Corpus pipeline: documents in, a clean and weighted mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftguard.llm.common import saved, table
from siftguard.llm.decontamination import remove_contaminated
from siftguard.llm.language_id import keep_identified
from siftguard.llm.mixing import mixed_documents
from siftguard.llm.near_duplicates import keep_one_of_each
from siftguard.llm.secret_scan import redact_secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, null and empty texts among them; every other text has a most likely language and stays.

    All columns stay as they are, whatever their names. Repeated rows share their fate; an empty table stays empty.
    """
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Texts without words are in no group and stay, and so do rows without an id; of rows that share the kept id all stay.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs; rows are judged by their own text, also where ids repeat or are missing.

    Texts without words stay; with an empty benchmark all stay.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, null and empty texts as they are, and ``n_chars`` follows the new text."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents to the target weights: one row per document and epoch, with the tokens taken as ``epoch`` and ``take_tokens``.

    Those two replace columns of the same names. Documents without tokens come along with whatever their place selects; an empty table gives none.
    """
    return mixed_documents(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate),
          ("secret_scan", redact), ("mixing", mix)]

#: A trained classifier and sketches are not expressible in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a stored table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
