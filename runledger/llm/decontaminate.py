"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 words of the benchmark items (an item of fewer words is one pattern); symbols are
words, blocks are pairs of words. A shift table moves the scan past positions at which no pattern can end; where the
shift is 0, the bucket of the suffix block and the prefix block selects patterns, and direct comparison confirms.
Patterns of one length share tables. A benchmark of more than BLOCK_WINDOWS windows is searched in blocks of about
that size, a pass over the documents for each, so that no task and no driver ever holds more patterns than that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, lean, packed

WINDOW = 13
BLOCK_WINDOWS = 200_000
#: Bytes that end words become blanks, A-Z become a-z; 0-9, a-z and all bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<start:long,end:long>>"


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Tables:
    """Shift and bucket tables of the patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], int, int]]]] = {}

    def add(self, words: list[bytes], at: int, item: int) -> None:
        b = self.block
        for end in range(at + b, at + self.length + 1):
            key, left = tuple(words[end - b : end]), at + self.length - end
            if left < self.shift.get(key, self.far):
                self.shift[key] = left
        last = at + self.length
        self.buckets.setdefault(tuple(words[last - b : last]), {}).setdefault(tuple(words[at : at + b]), []).append((words, at, item))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, item) of each occurrence."""
        n, length, b, far, shift = len(words), self.length, self.block, self.far, self.shift.get
        end = length - 1
        while end < n:
            suffix = (words[end - 1], words[end]) if b == 2 else (words[end],)
            step = shift(suffix, far)
            if step:
                end += step
                continue
            first = end - length + 1
            for pattern, at, item in self.buckets[suffix].get(tuple(words[first : first + b]), ()):
                if pattern[at : at + length] == words[first : end + 1]:
                    yield first, item
            end += 1


def build(items: list[tuple[int, str]], window: int = WINDOW) -> tuple[list[Tables], list[int]]:
    """Tables by pattern length, and the item_ids that patterns refer to by position."""
    tables: dict[int, Tables] = {}
    for number, (_, text) in enumerate(items):
        words = fold_words(text)
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if length else 0):
            tables.setdefault(length, Tables(length)).add(words, at, number)
    return [tables[k] for k in sorted(tables)], [i for i, _ in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], window: int) -> Iterator[pa.RecordBatch]:
    tables, ids = build(items, window)
    kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))
    for batch in batches:
        out: tuple[list, ...] = ([], [], [])
        for text in batch.column("text"):
            words = fold_words(text.as_py())
            hits, seen = [], set()
            for t in tables:
                for first, item in t.search(words):
                    hits.append((first, first + t.length))
                    seen.add(ids[item])
            out[0].append(len(words))
            out[1].append([{"start": a, "end": b} for a, b in merged(hits)])
            out[2].append(sorted(x for x in seen if x is not None))
        arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key_text"), *arrays], ["doc_id", "key_text", "n_words", "spans", "items"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans that several blocks found in a text."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in found])] for found in batch.column("spans").to_pylist()]
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field("spans"), pa.array(spans, batch.schema.field("spans").type))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, key_text (a fingerprint of the text), n_words, spans (of hit words, end excluded, merged), items (sorted
    item_ids that occur) of every row of docs.

    Null and empty texts have no words; items without words have no pattern. Items with a null id hit words but are
    not listed. Repeated items and documents are judged alike. Other columns are ignored. No text is shuffled."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    about = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(about / block_windows))
    schema = f"doc_id long, key_text long, n_words long, spans {SPANS}, items array<long>"
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("key_text"), text.alias("text"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def searched(k: int) -> DataFrame:
        part = [(r.item_id, r.text) for r in items.where(block == k).collect()]  # about block_windows words
        return rows.mapInArrow(lean(lambda it: _search(it, part, window)), schema)

    if blocks == 1:
        return searched(0)
    # One pass a block, each written before the next begins, so neither the driver nor a task holds two of them.
    hits = cut(searched(0))
    base = hits.select("doc_id", "key_text", "n_words")
    hits = hits.where("size(spans) > 0")
    for k in range(1, blocks):
        hits = hits.union(cut(searched(k).where("size(spans) > 0")))
    hits = hits.select("doc_id", "key_text", "spans", "items")
    all_ = hits.groupBy("doc_id", "key_text").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    all_ = cut(all_.mapInArrow(lean(_joined), all_.schema)).toDF("hit_id", "hit_text", "spans", "items")
    all_ = F.broadcast(all_) if all_.count() <= BROADCAST_ROWS // 20 else all_
    out = base.join(all_, base["doc_id"].eqNullSafe(all_["hit_id"]) & (base["key_text"] == all_["hit_text"]), "left")
    none = [F.array().cast(SPANS), F.array().cast("array<bigint>")]
    return out.select("doc_id", "key_text", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with counts, digest of the items and the verdict: at least a twentieth of the words hit.

    Null and empty texts have no words and are clean; repeated rows are judged alike; an empty benchmark or table of
    documents gives no hits or no rows. Other columns are ignored."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that judged() does not call contaminated, with all their columns.

    Rows are matched by doc_id and a fingerprint of the text, on which alone the verdict depends."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    gone = cut(found.where((hit > 0) & (hit * 20 >= F.col("n_words"))).select("doc_id", "key_text").distinct()).toDF("gone_id", "gone_text")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = packed(docs, key_id=F.col("doc_id").cast("bigint"), key_text=F.xxhash64(F.col("text").cast("string")))
    return rows.join(gone, F.col("key_id").eqNullSafe(F.col("gone_id")) & (F.col("key_text") == F.col("gone_text")), "left_anti").select("row.*")
