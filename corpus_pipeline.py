"""A corpus from documents: quality rules, exact dedup, near dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents; what a stage returns is written as Parquet and is the next one's docs.
In every stage a null text counts as empty, a null id, language or source is one of its own, texts of any length are read whole,
rows that repeat are rows like any other, an empty table gives an empty one, and columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.llm.common import settle, table
from echoloom.llm.exact_dedup import drop_exact
from echoloom.llm.mixing import mixed_rows
from echoloom.llm.near_dedup import drop_near
from echoloom.llm.packing import pack_documents
from echoloom.llm.quality import drop_bad


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or leave their language's band of perplexity go; one on the band's edge stays."""
    return drop_bad(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays, one of them if it repeats."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest id of each group stays, each of its rows if it repeats. Texts without words stay."""
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is taken n times is n rows; one without words is taken as its draw says."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; rows that repeat an id are packed each for itself."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The stages on perplexity and on tokens cannot be said in SQL; tests/llm holds each stage against a plain version on its own input
#: (of perplexity the base rules and the operator's own verdicts).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
