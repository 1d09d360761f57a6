"""Near-duplicate documents by Circulant MinHash, banding and exact Jaccard verification.

Signatures use two permutations of the 32-bit words: the first scatters the shingles, the second is shifted
circularly by k to give coordinate k. Both are closed-form bijections, so nothing as large as the universe is stored.

Groups of copies are never expanded into pairs. Documents with equal shingle sets collapse to the smallest doc_id.
In each band bucket one pivot is compared with every other member, and verified links are contracted into components.
What is then undecided in a bucket (members of different components, the pivot left out) is compared unless a bound on
the intersection rules the pair out, so every pair that shares a bucket is linked, rejected, or joined through others.

With 28 bands of 6 rows a pair at similarity 0.85 shares no bucket with probability 2e-6, at 0.9 with 6e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, cut, lean, text_buffer, with_ids

BANDS, ROWS = 28, 6
#: Bytes of text that a task looks at together, or one text.
SLICE = 1 << 20
#: Pairs of one document, or members of one bucket, that are dealt together.
TILE = 1024
_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: Fixed random values of the bytes, A-Z as a-z: the hashes must agree between tasks and runs.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; only those for slices of common size are kept."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    size = max(n, SLICE + 2)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    found = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == SLICE + 2:
        _POWERS[0] = found
    return found


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit words that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit fingerprints of its word shingles; a text of fewer words is one shingle."""
    low = int(offsets[0])
    data, offsets = data[low : int(offsets[-1])], offsets - low
    n = len(data)
    if not n:
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = True
    start = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
    end = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    word = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first, last = np.searchsorted(start, offsets[:-1]), np.searchsorted(start, offsets[1:])
    odd = [_U(2 * int(mix64(np.array([i + 1], np.uint64))[0] >> _U(2)) + 1) for i in range(width)]
    if len(word) >= width:
        rolled = word[: len(word) - width + 1] * odd[0]
        for i in range(1, width):
            rolled = rolled + word[i : len(word) - width + 1 + i] * odd[i]
        rolled = mix64(rolled)
    sets = []
    for f, l in zip(first.tolist(), last.tolist(), strict=True):
        if l - f >= width:
            sets.append(np.unique(rolled[f : l - width + 1]))
        elif l > f:
            few = np.uint64(l - f)
            for i in range(f, l):
                few = few + word[i : i + 1] * odd[i - f]
            sets.append(mix64(few ^ _U(l - f)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _mix32(z: np.ndarray, a: int, b: int) -> np.ndarray:
    """In place, a bijection of the 32-bit words."""
    z ^= z >> np.uint32(16)
    z *= np.uint32(a)
    z ^= z >> np.uint32(15)
    z *= np.uint32(b)
    z ^= z >> np.uint32(16)
    return z


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k, over the first one's image of the set."""
    scattered = _mix32((shingles ^ (shingles >> _U(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(scattered), 2048):
        least = np.minimum(least, _mix32(scattered[None, i : i + 2048] + shift, 0x21F0AAAD, 0xD35A2D97).min(1))
    return least


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = least.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix64(key * _U(_BASE) + rows[:, i])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for low, high in arrow_slices(batch, "text", SLICE):
            sets = shingle_sets(data, offsets[low : high + 1], width)
            keys = [band_keys(signature(s, bands * rows), bands) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def sketches(docs: DataFrame, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: set size, digest of the set, band keys."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        lean(lambda it: _sketch(it, width, bands, rows)), "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for low, high in arrow_slices(batch, "text", SLICE):
            found = [s.view(np.int64) for s in shingle_sets(data, offsets[low : high + 1], width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def shingle_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and the full set of the documents in ids."""
    wanted = with_ids(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), ids, "doc_id")
    return cut(wanted.mapInArrow(lean(lambda it: _sets(it, width)), "doc_id long, shingles array<long>"))


def _tile(by: str, tiles: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(by), F.col(tiles)).cast("int"), F.lit(0))


def _each(tiles: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(tiles, F.lit(1)) - 1))


def in_tiles(pairs: DataFrame, key: str) -> DataFrame:
    """key, tiles: into how many tiles the pairs of a document are dealt, where they are more than TILE."""
    many = pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    return cut(many.select(key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))


def beside(pairs: DataFrame, sets: DataFrame, key: str, other: str, tiles: DataFrame) -> DataFrame:
    """pairs with the columns of sets (key and a set) beside them; the set of a hot document is sent once a tile of its pairs."""
    dealt = with_ids(pairs, tiles, key, "left").withColumn("tile", _tile(other, "tiles")).drop("tiles")
    sent = with_ids(sets, tiles, key, "left").select(*sets.columns, _each("tiles").alias("tile"))
    return dealt.join(sent, [key, "tile"]).drop("tile")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), a cut table, those with 100 * |intersection| >= percent * |union|, on the full sets."""
    both = beside(pairs, sets.toDF("a", "set_a"), "a", "b", in_tiles(pairs, "a"))
    both = beside(both, sets.toDF("b", "set_b"), "b", "a", in_tiles(pairs, "b"))
    # common * 100 >= percent * (|a| + |b| - common), with common written once
    alike = F.size(F.array_intersect("set_a", "set_b")) * (100 + percent) >= percent * (F.size("set_a") + F.size("set_b"))
    return both.where(alike).select("a", "b").distinct()


def shared_shingles(sets: DataFrame) -> DataFrame:
    """doc_id, shared: the shingles that another document of the table has as well."""
    each = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
    private = each.where("n = 1").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("shingle").alias("private"))
    none = F.array().cast("array<bigint>")
    return sets.join(private, "doc_id", "left").select("doc_id", F.array_except("shingles", F.coalesce("private", none)).alias("shared"))


#: 256 bits, as four words: one for each shingle of an array.
WORDS = 4
_BITS = "aggregate(filter(outside, s -> (s & 3) = {}), 0L, (w, s) -> w | shiftleft(1L, cast(shiftright(s, 2) & 63 as int)))"


def against_pivots(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (rep, pivot): inside and outside, how many of rep's shared shingles the pivot has and hasn't;
    bits of those outside, and spare, how many of them fell on a bit already set."""
    both = beside(pairs.join(shared_shingles(sets).toDF("rep", "shared"), "rep"), sets.toDF("pivot", "pivot_set"), "pivot", "rep", in_tiles(pairs, "pivot"))
    both = both.select("rep", "pivot", F.size("shared").alias("most"), F.array_except("shared", "pivot_set").alias("outside"))
    both = both.select("rep", "pivot", "most", F.size("outside").alias("outside"), *(F.expr(_BITS.format(i)).alias(f"bits{i}") for i in range(WORDS)))
    spare = F.col("outside") - sum((F.bit_count(f"bits{i}") for i in range(1, WORDS)), F.bit_count("bits0"))
    return both.withColumn("inside", F.col("most") - F.col("outside")).withColumn("spare", spare)


def most_common(left: str, right: str) -> Column:
    """A bound on the intersection of two undecided sets: what both have of their pivot, and what else they can share."""
    here, there = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    bits = [F.bit_count(here(f"bits{i}").bitwiseAND(there(f"bits{i}"))) for i in range(WORDS)]
    both = sum(bits[1:], bits[0]) + F.least(here("spare"), there("spare"))
    return F.least(here("inside"), there("inside")) + F.least(here("outside"), there("outside"), both)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of an undirected graph: the least node reachable.

    Labels spread along links and then jump to the label of their label, so paths shorten geometrically."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels.toDF("node", "component")
        before = total
        near = edges.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        spread = cut(labels.join(near, "node").select("node", F.least("label", "near").alias("label")))
        jump = spread.toDF("label", "further")
        labels = cut(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Null or blank texts have no shingles and stay alone. Rows with a null doc_id stay alone too: component_id is
    null and kept true. Rows that repeat a doc_id are one document, linked by any of its texts. Other columns are
    ignored; an empty table gives an empty result."""
    sketch = cut(sketches(docs, width, bands, rows))
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    copies = cut(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    owned = cut(some.join(copies, "set_key", "left").select("doc_id", "set_key", F.coalesce("rep", "doc_id").alias("rep")).where("doc_id != rep").distinct())
    first = some.join(owned.select("doc_id", "set_key"), ["doc_id", "set_key"], "left_anti") if owned.take(1) else some
    spread = first.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n")).distinct()
    shared = cut(spread.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot != top"))
    members = cut(spread.join(shared.drop("top"), "key"))
    near = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent
    size = members.where("rep = pivot").select("key", F.col("n").alias("pivot_n"))
    pairs = members.where("rep != pivot").join(size, "key").where(near(F.col("n"), F.col("pivot_n"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    links = cut(verified(shingle_table(docs, ids, width), pairs, percent).union(owned.select("doc_id", "rep").distinct().toDF("a", "b")))
    labels = components(links)
    # What is undecided: members of different components in a bucket, its pivot left out.
    rest = members.where("rep != pivot").select("key", "pivot", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    rest = cut(rest.withColumn("component", F.coalesce("component", "rep")))
    per = rest.groupBy("key", "component").agg(F.count("*").alias("n_in"))
    major = cut(per.groupBy("key").agg(F.max_by("component", F.struct("n_in", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    if major.take(1):
        rest = cut(rest.join(major, "key"))
        sets = shingle_table(docs, cut(rest.select(F.explode(F.array("rep", "pivot")).alias("doc_id")).distinct()), width)
        # Exact bounds on each intersection leave few pairs of a large group whose members are not linked: shingles that
        # no other of these documents has don't count, those of the pivot count once for both, and the bits of the rest
        # must agree.
        bounds = cut(against_pivots(cut(rest.select("rep", "pivot").distinct()), sets))
        rest = cut(rest.join(bounds, ["rep", "pivot"]).where(F.col("most") * 100 >= F.col("n") * percent))
        # A bucket of many undecided members is a grid of tiles: a member stands in one row or column of it.
        grid = rest.groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.col("component") != F.col("major")).alias("others"))
        grid = grid.select("key", *(F.ceil(F.greatest(c, F.lit(1)) / TILE).cast("int").alias(t) for c, t in (("all", "high"), ("others", "wide"))))
        grid = cut(grid.where("high > 1 or wide > 1"))
        rest = with_ids(rest, grid, "key", "left")
        left = rest.select("*", _tile("rep", "high").alias("i"), _each("wide").alias("j")).alias("l")
        right = rest.where("component != major").select("*", _tile("rep", "wide").alias("j"), _each("high").alias("i")).alias("r")
        n, m = F.col("l.n"), F.col("r.n")
        enough = most_common("l", "r") * (100 + percent) >= (n + m) * percent
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
        pairs = left.join(right, same[0] & same[1] & same[2] & (F.col("l.component") != F.col("r.component")) & near(n, m) & enough)
        pairs = pairs.select(F.greatest("l.rep", "r.rep").alias("a"), F.least("l.rep", "r.rep").alias("b")).distinct()
        more = cut(verified(sets, cut(pairs), percent))
        if more.take(1):
            labels = components(cut(links.union(more)))
    parts = labels.toDF("doc_id", "component_id")
    return sketch.select("doc_id", "n_shingles").join(parts, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = 85, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs with one document of each group: the one with the least doc_id, once."""
    result = cut(near_duplicates(docs, percent, width, bands, rows).select("doc_id", "kept"))
    gone = cut(result.where("not kept").select("doc_id").distinct())
    again = cut(result.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    left = with_ids(docs, gone, "doc_id", "left_anti") if gone.take(1) else docs
    if not again.take(1):
        return left
    return with_ids(left, again, "doc_id", "left_anti").unionByName(with_ids(left, again, "doc_id").dropDuplicates(["doc_id"]))
