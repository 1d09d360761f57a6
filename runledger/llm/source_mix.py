"""Mixing sources to target weights by the cube method.

Every source gets a target of words; target / size is the rate at which its documents are taken. The whole part of
the rate is taken of every document, and the fraction is an inclusion probability. The flight phase moves the
probabilities of three documents at a time along the null space of two constraints (words and documents taken),
until one of them is 0 or 1. It runs on chunks of CHUNK documents, the largest first; the two that a chunk leaves
undecided meet again in chunks of the next level, until one chunk a source is left. Its last two and RESERVE
documents, from large to small, are landed by the rounding that leaves the words nearest to their target: there, the
totals go before the probabilities. Chunks depend on keys alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, cut, packed

#: Units that fly together, and units of a source, from large to small, that are kept for its landing.
CHUNK, RESERVE = 4096, 14
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
_EPS = 1e-9


def word_count(text: str = "text") -> "F.Column":
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text).cast("string"), SPACE), "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """rank, source, source_size, target from rows of (source, size).

    The level at which weights fill up is found in closed form: sources saturate in the order of most * size / weight."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    known = per.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    known = known.withColumn("level", level).withColumn("at", F.row_number().over(fill))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))).over(whole)["level"]
    known = known.withColumn("found", F.coalesce(first, F.lit(float("inf"))))
    return cut(known.select("rank", "source", "source_size", F.least("cap", F.col("found") * F.col("w")).alias("target")))


def _uniform(seed: int) -> float:
    """A fixed hash of a number, as a fraction."""
    x = (seed + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2**53


def _move(p: list[float], units: list[int], u: list[float], chance: float) -> None:
    """Moves p along u or against it as far as it stays in [0, 1]; in expectation it stays where it is."""
    up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(units, u, strict=True) if d)
    down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(units, u, strict=True) if d)
    step = up if chance * (up + down) < down else -down
    for i, d in zip(units, u, strict=True):
        x = p[i] + step * d
        p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def _spread(sizes: list[float], units: list[int]) -> list[int]:
    """RESERVE of the units at most, each about half as large as the one before: subsets of them have all sorts of totals."""
    out: list[int] = []
    for i in sorted(units, key=lambda k: -sizes[k]):
        if len(out) < RESERVE and (not out or sizes[i] <= sizes[out[-1]] / 2):
            out.append(i)
    rest = [i for i in reversed(units) if i not in set(out)]
    return out + rest[: RESERVE - len(out)]


def fly(sizes: list[float], counts: list[float], p: list[float], seeds: list[int], land: bool) -> list[float]:
    """The flight phase over units with these words and documents; land: also the landing of the two left
    at most and of RESERVE units."""
    p, held = list(p), []
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    reserve = _spread(sizes, open_) if land else []
    for i in sorted(set(open_) - set(reserve)):
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = [sizes[b] * counts[c] - sizes[c] * counts[b], sizes[c] * counts[a] - sizes[a] * counts[c], sizes[a] * counts[b] - sizes[b] * counts[a]]
            top = max(map(abs, u))
            u = [x / top for x in u] if top else [counts[b] / (counts[a] + counts[b]), -counts[a] / (counts[a] + counts[b]), 0.0]
            _move(p, held, u, _uniform(seeds[i]))
            held = [k for k in held if 0 < p[k] < 1]
    if land and open_:
        # The landing problem: of all roundings of the units left, the one that leaves the words nearest to their total,
        # then the documents.
        left = held + reserve
        bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.float64)
        off = [np.abs((bits - [p[k] for k in left]) @ np.array([x[k] for k in left])) for x in (sizes, counts)]
        for k, v in zip(left, bits[np.lexsort((off[1], off[0]))[0]].tolist(), strict=True):
            p[k] = v
    return p


def _flight(land: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["size"].to_numpy("float64") * pdf["n"].to_numpy("float64")
        pdf = pdf.assign(total=-total).sort_values(["total", "seed", "doc_id", "size"], kind="stable", na_position="last")
        total = -pdf.pop("total").to_numpy("float64")
        pdf["p"] = fly(total.tolist(), pdf["n"].astype("float64").tolist(), pdf["p"].tolist(), pdf["seed"].tolist(), land)
        return pdf

    return work


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: a row for each distinct (doc_id, source, size), of which
    docs has n rows; each is taken copies times, 0 to 2.

    Null texts have size 0, null sources are one source and come last; rows that agree in doc_id, source and size are
    decided together. A source without words has target 0 and is not taken. An empty table gives an empty result."""
    units = cut(
        docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count().alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
    )
    aims = targets(units.select("source", (F.col("size") * F.col("n")).alias("size")))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    all_units = units.join(F.broadcast(aims) if aims.count() <= BROADCAST_ROWS else aims, units["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    all_units = all_units.withColumn("rate", F.least(rate, F.lit(MOST))).withColumn("whole", F.floor("rate"))
    rows = all_units.withColumn("p", F.col("rate") - F.col("whole")).withColumn("seed", F.xxhash64("doc_id", "source", "size"))
    rows = rows.select("doc_id", "source", "size", "n", "rank", "source_size", "target", "whole", "p", "seed")
    open_rows, level = rows, 0
    done = []
    while True:
        per = open_rows.groupBy("rank").agg(F.count("*").alias("units"))
        most = per.agg(F.max("units")).first()[0] or 0
        last = most <= CHUNK
        # Each source is dealt into chunks by its own number of units, by the hash of the key and the level.
        chunk = F.pmod(F.xxhash64("seed", F.lit(level)), F.ceil(F.col("units") / F.lit(CHUNK)))
        dealt = open_rows.join(F.broadcast(per) if aims.count() <= BROADCAST_ROWS else per, "rank").withColumn("chunk", chunk).drop("units")
        schema = dealt.select(*rows.columns, "chunk").schema
        flown = cut(dealt.select(*rows.columns, "chunk").groupBy("rank", "chunk").applyInPandas(_flight(last), schema).drop("chunk"))
        if last:
            done.append(flown)
            break
        done.append(flown.where("p <= 0 or p >= 1"))
        open_rows, level = flown.where("p > 0 and p < 1"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.round("p")).cast("bigint").alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    Null texts have size 0 and are taken 0 words; null sources are one source; repeated rows count each; an empty table
    gives an empty result. Other columns are ignored."""
    mix = mixture(docs).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: never, once or twice.

    Null texts count as empty and are taken as their source's rate and the balance say; null doc_ids and sources are
    values of their own; rows that agree in doc_id, source and size share their fate; an empty table stays empty. Other
    columns are kept, whatever their names."""
    chosen = cut(mixture(docs).where("copies > 0").select("doc_id", "source", "size", "copies"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = packed(docs, key_id=F.col("doc_id").cast("bigint"), key_source=F.col("source").cast("string"), key_size=word_count())
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & F.col("key_source").eqNullSafe(F.col("source")) & (F.col("key_size") == F.col("size"))
    return rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
