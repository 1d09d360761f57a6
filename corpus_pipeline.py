"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents. Documents that the quality rules reject go; of each group of
near-duplicates the document of least doc_id stays; contaminated documents go; the mix repeats or drops documents;
the last stage writes token ids and returns the digests of what it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm.common import cut, table
from runledger.llm.decontaminate import without_contaminated
from runledger.llm.near_dedup import deduplicated
from runledger.llm.quality_rules import accepted
from runledger.llm.source_mix import mixed
from runledger.llm.token_store import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five words and 0.8: 40 bands of 5 rows miss a pair at that similarity with probability (1 - 0.8**5)**40, 1.3e-7
    return deduplicated(docs, percent=80, width=5, bands=40, rows=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stored(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_store", token_store),
]

#: Learned rules, exact components and token ids have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
