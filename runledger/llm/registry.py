"""Queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, license_scan, line_dedup, warc_audit
from .common import shared_dir, table
from .decontaminate import judged
from .near_dedup import near_duplicates
from .quality_rules import quality
from .source_mix import taken
from .suffix_dedup import without_repeats
from .token_store import stored


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both replicas are written as WARC files, one of them decayed, and hashed as they are read back."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc_audit.write_warc(warc_audit.archive(table(spark, sf_dir, "pages")), folder, a=F.col("r"), b=warc_audit.decayed())
    return warc_audit.audit(*(warc_audit.index_of(spark, f"{folder}/replica={name}") for name in "ab"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", html_extract.host().alias("host"), line_dedup.visible_lines().alias("lines"))
    return line_dedup.digest(line_dedup.without_boilerplate(rows))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.document_paths(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))


_ALL = (op1_near_dedup, op2_warc_audit, op3_html_extract, op4_line_dedup, op5_quality_rules, op6_source_mix, op7_suffix_dedup, op8_license_scan, op9_decontamination, op10_token_store)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op2_warc_audit": warc_audit.SQL, "op4_line_dedup": line_dedup.SQL}
