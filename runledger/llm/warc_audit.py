"""Merkle fixity audit of WARC replicas.

Records are hashed; a leaf is the digest of the records that begin in one RANGE of offsets of a file, and FANOUT nodes
make a node of the next level, up to one root a file. Two replicas are compared root by root; only the children of nodes
that differ are compared next, down to the records themselves. Every node is made of at most FANOUT children or one
range, so no group grows with the archive."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean

RANGE, FANOUT = 1 << 16, 16
RECORDS_A_FILE = 500
_HEAD = "WARC/1.0\r\n"
_MAGIC, _LENGTH = _HEAD.encode(), re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", re.I)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "offset", "length", "head", "body", "intact", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            rows: list[tuple] = []
            size, at = 0, data.find(_MAGIC)
            while at >= 0:
                begin = data.find(b"\r\n\r\n", at)
                head = data[at : begin if begin >= 0 else len(data)]
                length = _LENGTH.search(head)
                if begin < 0 or length is None:  # a damaged head: go on at the next record
                    begin, after = len(head) + at, data.find(_MAGIC, at + len(_MAGIC))
                    after = stop = after if after >= 0 else len(data)
                    intact = False
                else:
                    begin += 4
                    stop = begin + int(length[1])
                    after = min(stop + 4, len(data))
                    intact = stop <= len(data)
                body = data[begin : min(stop, len(data))]
                rows.append((path, at, after - at, head.decode("utf-8", "replace"), body, intact, hashlib.sha256(data[at:after]).hexdigest()))
                size += len(body)
                if size > 4 << 20:
                    yield packed(rows)
                    rows, size = [], 0
                at = data.find(_MAGIC, after)
            if rows:
                yield packed(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, head, body, intact, digest of the records of WARC files, gzipped ones included.

    A record ends where its Content-Length says, whatever its body holds; what follows a damaged stretch is found at the
    next record's first bytes. intact is false where a head names no length or the file ends early."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(lean(_records), "file string, offset long, length long, head string, body binary, intact boolean, digest string")


def record(url: Column, body: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    parts = (F.lit(_HEAD + "WARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    return F.concat(*parts)


def archive(pages: DataFrame, files: int = RECORDS_A_FILE) -> DataFrame:
    """file, page_id, r: records of archives that hold the pages in page_id order, some hundred a file. Pages without an id
    are spread over files of their own, below 0."""
    spread = -1 - F.pmod(F.xxhash64(F.col("url"), F.col("html")), F.lit(4096))
    file = F.coalesce(F.floor(F.col("page_id").cast("bigint") / files), spread).cast("bigint")
    return pages.select(file.alias("file"), F.col("page_id").cast("bigint").alias("page_id"), record(F.col("url"), F.col("html")).alias("r"))


def decayed() -> Column:
    """Records of archive() in which bytes have decayed, by page_id: one in 97 has one wrong byte, one in 389 is blank."""
    wrong = F.concat(F.substring("r", 1, 20), F.lit("?"), F.expr("substring(r, 22)"))
    return F.when(F.col("page_id") % 389 == 7, F.repeat(F.lit("\0"), F.octet_length("r"))).when(F.col("page_id") % 97 == 5, wrong).otherwise(F.col("r"))


def write_warc(archives: DataFrame, path: str, **replicas: Column) -> None:
    """Writes a gzipped WARC file for each number in file, a record after the other by page_id, to replica=<name> under the
    path for each replica, given by its records. Pages are shuffled once for all replicas."""
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("replica"), F.substring(r, F.lit(1), F.length(r) - 4).alias("body")) for name, r in replicas.items())))  # the writer ends each record
    rows = archives.repartition("file").select("file", "page_id", "r", each).sortWithinPartitions("replica", "file", "page_id", "r")
    rows.select("replica", "file", "body").write.partitionBy("replica", "file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, digest of the records of a written archive: of the bytes that are read back."""
    number = F.regexp_extract("file", r"file=(-?\d+)", 1).cast("bigint")
    return read_warc(spark, path).select(number.alias("file"), "offset", "length", "digest")


def levels(records: DataFrame) -> list[DataFrame]:
    """Tables (file, node, hash) from the leaves to the roots."""
    text = F.format_string("%d:%d:%s", "offset", "length", "digest")
    leaf = records.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.array_sort(F.collect_list(F.struct("offset", "length", text.alias("text")))).alias("all"))
    level = cut(leaf.select("file", "node", F.sha2(F.array_join("all.text", ";").cast("binary"), 256).alias("hash")))
    out = [level]
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        up = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("all"))
        joined = F.array_join(F.transform("all", lambda x: F.format_string("%d:%s", x["node"], x["hash"])), ";")
        level = cut(up.select("file", F.col("up").alias("node"), F.sha2(joined.cast("binary"), 256).alias("hash")))
        out.append(level)
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), ["file", "node"], "full_outer")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, offset, length, status of the records on which two replicas, tables (file, offset, length, digest), differ.

    status: corrupt (both have a record there, with different bytes), missing (only the left) or extra (only the right).
    Records repeated in one replica at one offset count once each. Null files and offsets are left out. Empty replicas
    make every record of the other missing or extra."""
    columns = ["file", "offset", "length", "digest"]
    left, right = (cut(t.select(*columns).where("file is not null and offset is not null")) for t in (left, right))
    trees = [levels(t) for t in (left, right)]
    high = max(map(len, trees))
    for tree in trees:  # a tree with fewer levels: its root goes on alone
        while len(tree) < high:
            top = tree[-1]
            tree.append(cut(top.select("file", "node", F.sha2(F.format_string("%d:%s", "node", "hash").cast("binary"), 256).alias("hash"))))
    wrong = _differ(trees[0][-1], trees[1][-1])
    for k in range(high - 2, -1, -1):
        wrong = cut(wrong.withColumnRenamed("node", "up"))
        a, b = (t[k].withColumn("up", F.floor(F.col("node") / FANOUT)).join(wrong, ["file", "up"], "left_semi").drop("up") for t in trees)
        wrong = _differ(a, b)
    wrong = cut(wrong)
    a, b = (t.withColumn("node", F.floor(F.col("offset") / RANGE)).join(wrong, ["file", "node"], "left_semi").drop("node") for t in (left, right))
    both = a.toDF("file", "offset", "length_a", "digest_a").join(b.toDF("file", "offset", "length_b", "digest_b"), ["file", "offset"], "full_outer")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").when((F.col("digest_a") != F.col("digest_b")) | (F.col("length_a") != F.col("length_b")), "corrupt")
    return both.select("file", "offset", F.coalesce("length_a", "length_b").alias("length"), status.alias("status")).where("status is not null")


SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 500 AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
      || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
i AS (SELECT page_id, file, CAST(octet_length(encode(r)) AS BIGINT) AS length, sha256(r) AS digest FROM r),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM i)
SELECT file, "offset", length, CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'corrupt' END AS status FROM o WHERE page_id % 389 = 7 OR page_id % 97 = 5
"""
