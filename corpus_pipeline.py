"""From raw documents to packed training sequences: five stages, each of
which works on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet under the shared checkpoint folder and read again. All but
the last return the columns of ``documents``; the last returns the packed
pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.common import scratch, stored, table
from logweave.llm.line_dedup import line_filter
from logweave.llm.mixing import mixed_documents
from logweave.llm.near_dup import near_filter
from logweave.llm.packing import pack
from logweave.llm.quality_rules import quality_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that are probably bad, go."""
    return quality_filter(docs, COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; ``n_chars`` follows."""
    return line_filter(docs, COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the
    smallest hash of id and text. Documents without an id take part, and of
    rows equal in id and text one stays."""
    return near_filter(docs, COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row for each document and pass."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix", mix), ("packing", packing)]

#: Tokens, sketches and pseudorandom draws have no SQL; the tests run the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
