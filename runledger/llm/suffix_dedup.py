"""Removal of byte strings repeated across documents, by suffix sorting with linear Lyndon grouping.

A document loses every byte covered by a WIDTH-byte string that also starts in a document of smaller doc_id.

1. Documents of equal bytes are one string, that of the smallest doc_id; the others are removed whole.
2. Each WIDTH-byte window has a minimizer, the least hash among its GRAM-byte strings; equal windows have equal ones.
   Consecutive windows of one minimizer form a piece. Equal pieces are one string as well: a task keeps the smallest
   document of those it sees, and buckets by minimizer do so for all tasks. Fingerprints of 128 bits tell them apart.
3. The different pieces of a shared minimizer meet in a batch. Of each, the runs of windows that another document of the
   batch has go on, equal runs as one string, and the runs of one minimizer are suffix-sorted: suffixes are grouped by
   their Lyndon prefixes, groups are processed in descending order, each splitting the groups of its members' previous
   smaller suffixes by how often they are reached, and the order inside the groups is then emitted in one ascending pass,
   without renaming. Neighbours that agree in WIDTH bytes form a class; its smallest document keeps the window.

A minimizer of more than HOT different pieces is dealt to the batches window by window, so no batch grows with the
contexts of one string. A bucket holds 24 bytes for each different piece of a minimizer, those of a task counted once."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, cut, lean, text_buffer, with_ids
from .near_dedup import mix64

WIDTH, GRAM = 50, 24
#: Bytes of text a bucket of fingerprints stands for, pieces in a batch to sort, on average; bytes of text that a task looks at
#: together; different pieces from which on a minimizer is dealt by windows.
BUCKET_BYTES, BATCH_PIECES, SLICE, HOT = 6_000_000, 3_000, 1 << 20, 2_000
_U = np.uint64
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 2**64))


class Hashes:
    """Polynomial hashes of the strings at each place of data, put together from those of powers of two."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _BYTE[data]}

    def _level(self, size: int) -> np.ndarray:
        if size not in self.by:
            half = self._level(size // 2)
            self.by[size] = half[: -(size // 2)] * _power(size // 2) + half[size // 2 :]
        return self.by[size]

    def at(self, places: np.ndarray | slice, width: int) -> np.ndarray:
        """Hashes of the width-byte strings at the places, or at all."""
        n, out, done = len(self.by[1]) - width + 1, None, 0
        for size in (1 << k for k in range(width.bit_length()) if width >> k & 1):
            h = self._level(size)
            h = h[done : done + n] if isinstance(places, slice) else h[places + done]
            out = h if out is None else out * _power(size) + h
            done += size
        return mix64(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    m, size = h, 1
    while 2 * size <= width:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return np.minimum(m[: len(h) - width + 1], m[width - size :]) if size < width else m


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimizer, fingerprint, text, first and last window (places in data) of the pieces of texts that lie in data.

    A piece has WIDTH windows at most, so its first and its last window cover it."""
    n = len(data) - WIDTH + 1
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= WIDTH)
    if n <= 0 or not len(long):
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    step = np.zeros(n + 1, np.int8)
    step[offsets[long]] = 1
    np.add.at(step, offsets[long + 1] - WIDTH + 1, -1)
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    hashes = Hashes(data)
    least = _least(hashes.at(slice(None), GRAM), WIDTH - GRAM + 1)
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(least[1:], least[:-1], out=begins[1:])
    begins[1:] |= ~valid[:-1]
    begins[offsets[long]] = True
    begins &= valid
    first = np.flatnonzero(begins)
    text = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offsets[text + 1] - WIDTH)
    over = last - first >= WIDTH
    if over.any():  # strings that repeat themselves
        parts = (last - first) // WIDTH + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last, text = np.repeat(first, parts) + nth * WIDTH, np.repeat(last, parts), np.repeat(text, parts)
        last = np.minimum(last, first + WIDTH - 1)
    mark = mix64(hashes.at(first, WIDTH) * _U(_BASE) + hashes.at(last, WIDTH) + (last - first).astype(np.uint64))
    return least[first], mark, text, first, last


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings and places of all their suffixes in ascending order; equal ones are neighbours in any order.

    Seven 4-byte numbers are held for each byte."""
    text = b"".join(strings)
    n = len(text)
    sizes = np.array([len(s) for s in strings], np.int64)
    start_of = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    low = array("i", np.repeat(start_of, sizes).astype(np.int32).tobytes())  # where the suffix's string begins
    # Phase 1. A group is a range of order, its number where it starts; at first the groups are those of the first bytes.
    raw = np.frombuffer(text, np.uint8)
    by_byte = np.argsort(raw, kind="stable")
    starts = np.searchsorted(raw[by_byte], np.arange(257))
    order, group = array("i", by_byte.astype(np.int32).tobytes()), array("i", starts[raw].astype(np.int32).tobytes())
    at = np.empty(n, np.int32)
    at[by_byte] = np.arange(n, dtype=np.int32)
    at = array("i", at.tobytes())
    ends = np.zeros(n + 1, np.int32)
    ends[starts[:-1]] = starts[1:] - 1
    ends[starts[raw]] = starts[raw.astype(np.int64) + 1] - 1
    ends = array("i", ends.tobytes())
    smaller = array("i", bytes(4 * n))  # the previous smaller suffix, -1 for none
    high = n - 1
    while high >= 0:
        g = group[order[high]]
        reached: dict[int, int] = {}
        for i in sorted(order[g : high + 1]):
            # Groups above are done, so are members before i: their pointers lead past all that isn't smaller.
            p, least = i - 1, low[i]
            while p >= least and group[p] >= g:
                p = smaller[p]
            if p >= least:
                smaller[i] = p
                reached[p] = reached.get(p, 0) + 1
            else:
                smaller[i] = -1
        split: dict[tuple[int, int], list[int]] = {}
        for p, times in reached.items():
            split.setdefault((group[p], times), []).append(p)
        # Those reached more often are greater; each part becomes a group right above what it leaves.
        for old, times in sorted(split, reverse=True):
            part, end = split[old, times], ends[old]
            new = end - len(part) + 1
            for k, p in enumerate(part):
                q, here = order[end - k], at[p]
                order[here], at[q] = q, here
                order[end - k], at[p] = p, end - k
            if new > old:
                ends[old], ends[new] = new - 1, end
                for p in part:
                    group[p] = new
        high = g - 1
    # Phase 2. Each suffix, when its place is reached, sends the suffixes that end their Lyndon prefix before it to the
    # next free places of their groups. The ends of the strings come first.
    free, placed = array("i", bytes(4 * n)), bytearray(n)

    def send(i: int) -> None:
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            order[g + free[g]] = i
            free[g] += 1
            i = smaller[i]

    for s, size in zip(start_of.tolist(), sizes.tolist(), strict=True):
        if size:
            send(s + size - 1)
    for k in range(n):
        i = order[k]
        if i > low[i]:
            send(i - 1)
    found = np.frombuffer(order, np.int32).astype(np.int64)
    return owner[found], found - start_of[owner[found]]


def least_documents(strings: list[bytes], docs: list[int]) -> list[np.ndarray]:
    """For each string the smallest document among those of the strings that have its windows, window by window."""
    owner, place = suffix_order(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    whole = place + WIDTH <= sizes[owner]
    owner, place = owner[whole], place[whole]
    data, begin = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes
    here = begin[owner] + place
    same = np.ones(len(here) - 1, bool)
    for k in range(WIDTH):
        same &= data[here[1:] + k] == data[here[:-1] + k]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(np.array(docs, np.int64)[owner], first)
    flat = np.empty(len(data), np.int64)
    flat[here] = np.repeat(least, np.diff(np.append(first, len(here))))
    return [flat[b : b + n - WIDTH + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _edges(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return edge.tolist(), [*edge[1:].tolist(), len(x)] if len(edge) else []


def _fingerprints(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ids, counts, marks) of the different pieces of some documents, each for its smallest one, and rows
    (doc_id, marks) of the pieces that a smaller one of them has."""
    names = ["bucket", "ids", "counts", "marks", "doc_id"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        h, mark, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, h ^ mix64(mark)))
        h, mark, doc = h[order], mark[order], doc[order]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (mark[1:] == mark[:-1])))
        twice = again & np.concatenate(([False], doc[1:] == doc[:-1]))
        out: list[tuple] = []
        both = np.stack([h, mark], 1)
        copies = np.flatnonzero(again & ~twice)
        if len(copies):
            # the piece's smallest document is the first of its run
            run = np.flatnonzero(~again)
            owner = doc[run][np.cumsum(~again) - 1]
            copies = copies[doc[copies] > owner[copies]]
            copies = copies[np.argsort(doc[copies], kind="stable")]
            out += [(-1 - int(doc[copies[a]]) % buckets, None, None, both[copies[a:b]].tobytes(), int(doc[copies[a]])) for a, b in zip(*_edges(doc[copies]), strict=True)]
        h, doc, both = h[~again], doc[~again], both[~again]
        bucket = (h % _U(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        both, doc, bucket = both[order], doc[order], bucket[order]
        for a, b in zip(*_edges(bucket), strict=True):
            start, stop = _edges(doc[a:b])
            counts = np.subtract(stop, start).astype(np.int64)
            out.append((int(bucket[a]), doc[a:b][start].tobytes(), counts.tobytes(), both[a:b].tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    size = 0
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for low, high in arrow_slices(batch, "text", SLICE):
            a, b = int(offsets[low]), int(offsets[high])
            h, mark, text, _, _ = pieces(data[a:b], offsets[low : high + 1] - a)
            text = text + low
            some = known[text]
            if some.any():
                held.append((h[some], mark[some], ids[text[some]]))
                size += b - a
            if size > 8 * SLICE:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def _meet(pdf: pd.DataFrame, many: int) -> pd.DataFrame:
    """Of a bucket: per document the pieces that go whole, and those to be sorted (open, or hot), by fingerprint.

    many: the different pieces up to which a minimizer is not hot."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["doc_id", "marks"]].assign(kind="whole")[["doc_id", "kind", "marks"]]
    both = np.concatenate([np.frombuffer(m, np.uint64) for m in pdf["marks"]]).reshape(-1, 2)
    doc = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int64)) for i, c in zip(pdf["ids"], pdf["counts"], strict=True)])
    by_h = np.sort(both[:, 0])
    several = np.unique(by_h[1:][by_h[1:] == by_h[:-1]])
    found = np.searchsorted(several, both[:, 0])
    some = found < len(several)
    some[some] = several[found[some]] == both[some, 0]
    both, doc = both[some], doc[some]
    rows: list[tuple] = []
    if len(doc):
        order = np.lexsort((doc, both[:, 1], both[:, 0]))
        h, mark, doc = both[order, 0], both[order, 1], doc[order]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new = new_h | np.concatenate(([True], mark[1:] != mark[:-1]))
        first = np.flatnonzero(new)
        owner = np.repeat(doc[first], np.diff(np.append(first, len(h))))
        whole = doc > owner
        key, heads = np.cumsum(new_h) - 1, np.flatnonzero(new_h)
        least, most = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
        kinds = np.bincount(key[first])
        live = new & ((least != most) & (kinds > 1))[key]
        hot = (kinds > many)[key]
        for flag, name in ((whole, "whole"), (live & ~hot, "open"), (live & hot, "hot")):
            if flag.any():
                d, m = doc[flag], np.stack([h[flag], mark[flag]], 1)
                by = np.argsort(d, kind="stable")
                d, m = d[by], m[by]
                rows += [(int(d[a]), name, m[a:b].tobytes()) for a, b in zip(*_edges(d), strict=True)]
    return pd.DataFrame(rows, columns=["doc_id", "kind", "marks"])


def _spans(first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([first, last + WIDTH], 1).astype(np.int64).tobytes()


def _key(text: np.ndarray, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix64(h ^ mix64(mark ^ mix64(text.astype(np.uint64))))


def _cut_out(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, spans) of whole pieces, and (doc_id, batch, minimizer, start, piece) of pieces to be sorted."""
    names = ["doc_id", "spans", "batch", "minimizer", "start", "piece"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for low, high in arrow_slices(batch, "text", SLICE):
            a = int(offsets[low])
            raw = data[a : int(offsets[high])]
            h, mark, text, first, last = pieces(raw, offsets[low : high + 1] - a)
            begin = offsets[low:high] - a
            lists = batch.column("lists").slice(low, high - low).to_pylist()
            mine, rows, plain = _key(text, h, mark), [], raw.tobytes()
            for kind in ("whole", "open", "hot"):
                listed = [np.frombuffer(b"".join(x["marks"] for x in some if x["kind"] == kind), np.uint64).reshape(-1, 2) for some in lists]
                counts = [len(x) for x in listed]
                if not sum(counts):
                    continue
                all_ = np.concatenate(listed)
                known = np.sort(_key(np.repeat(np.arange(len(lists)), counts), all_[:, 0], all_[:, 1]))
                k = np.searchsorted(known, mine)
                k[k == len(known)] = 0
                hit = np.flatnonzero(known[k] == mine)
                t, f, l = text[hit], first[hit], last[hit]
                if kind == "whole":
                    rows += [(int(ids[low + t[x]]), _spans(f[x:y] - begin[t[x]], l[x:y] - begin[t[x]]), None, None, None, None) for x, y in zip(*_edges(t), strict=True)]
                    continue
                g = h[hit]
                if kind == "hot":  # window by window, each to the batch of its own bytes
                    many = l - f + 1
                    t, g = np.repeat(t, many), np.repeat(g, many)
                    f = np.repeat(f, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    l = f
                    g = Hashes(raw).at(f, WIDTH)
                where = (g // _U(7) % _U(groups)).astype(np.int64).tolist()
                at = (f - begin[t]).tolist()
                rows += [(int(d), None, b, m, s, plain[x : y + WIDTH]) for d, b, m, s, x, y in zip(ids[low + t], where, g.view(np.int64).tolist(), at, f.tolist(), l.tolist(), strict=True)]
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names)


def _window_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For SLICE bytes of texts at a time: the number of the first, and text and hash of each window."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or k == len(texts) - 1:
            some = texts[low : k + 1]
            counts = np.array([len(x) - WIDTH + 1 for x in some])
            begin = np.cumsum(counts + WIDTH - 1) - counts - WIDTH + 1
            places = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            yield low, np.repeat(np.arange(len(some)), counts), Hashes(np.frombuffer(b"".join(some), np.uint8)).at(places, WIDTH)
            low, size = k + 1, 0


def _sorted_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, spans) of the windows that a smaller document of the batch has."""
    pdf = pdf.sort_values(["minimizer", "doc_id", "start"], kind="stable")
    texts, docs, starts, keys = (pdf[c].tolist() for c in ("piece", "doc_id", "start", "minimizer"))
    doc_of = np.array(docs, np.int64)
    parts = [(low + owner, h) for low, owner, h in _window_hashes(texts)]
    owner, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    heads, doc = np.flatnonzero(new), doc_of[owner[order]]
    shared = np.empty(len(h), bool)
    shared[order] = (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads))[np.cumsum(new) - 1]
    # runs of shared windows; equal ones are one string, that of the smallest document
    begin = np.cumsum(counts := np.bincount(owner, minlength=len(texts))) - counts
    edge = np.flatnonzero(np.concatenate(([True], (shared[1:] != shared[:-1]) | (owner[1:] != owner[:-1]))))
    stop = np.append(edge[1:], len(h))
    runs: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for k, a, b in zip(owner[edge].tolist(), edge.tolist(), stop.tolist(), strict=True):
        if shared[a]:
            i = a - int(begin[k])
            runs.setdefault(keys[k], {}).setdefault(texts[k][i : i + b - a + WIDTH - 1], []).append((docs[k], starts[k] + i))
    found: dict[int, list[np.ndarray]] = {}
    for strings in runs.values():
        least = [min(d for d, _ in at) for at in strings.values()]
        by_window = least_documents(list(strings), least) if len(strings) > 1 else [np.full(len(s) - WIDTH + 1, d) for s, d in zip(strings, least, strict=True)]
        for at, smallest in zip(strings.values(), by_window, strict=True):
            for d, start in at:
                if len(gone := np.flatnonzero(smallest < d)):
                    found.setdefault(d, []).append(start + gone)
    return pd.DataFrame([(d, _spans(x := np.concatenate(v), x)) for d, v in found.items()], columns=["doc_id", "spans"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, text, all_spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("all").to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            step = np.zeros(len(raw) + 1, np.int64)
            for spans in all_spans or ():
                pair = np.frombuffer(spans, np.int64).reshape(-1, 2)
                pair = pair[pair[:, 1] <= len(raw)]
                np.add.at(step, pair[:, 0], 1)
                np.add.at(step, pair[:, 1], -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            rows.append((d, len(raw), int(gone.sum()), [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (spans of bytes, end excluded), kept_sha256 of every row of docs.

    A null text is empty. Rows of one doc_id are one document, whose texts don't remove each other; where such rows
    differ, a span that one of them loses goes in the others as well if it fits there. Rows with a null doc_id neither
    lose bytes nor make others lose any. Other columns are ignored."""
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = text.withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    base = cut(sized.drop("text"))
    long = base.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WIDTH))
    first = cut(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("top")).where("first != top").drop("top"))
    copies = cut(long.join(first, "sha").where("doc_id != first").select("doc_id", "sha").distinct())
    # documents that have other long texts than their copies
    mixed = cut(long.join(copies.select("doc_id").distinct(), "doc_id", "left_semi").join(copies, ["doc_id", "sha"], "left_anti").select("doc_id").distinct())
    alone = cut(copies.select("doc_id").distinct().join(mixed, "doc_id", "left_anti"))
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, total // BUCKET_BYTES)
    rest = with_ids(text, alone, "doc_id", "left_anti") if alone.take(1) else text
    several = bool(mixed.take(1))
    if several:
        parted = cut(copies.join(mixed, "doc_id", "left_semi"))
        sha = F.sha2(F.col("text").cast("binary"), 256)
        rest = with_ids(rest.withColumn("sha", sha), parted, ["doc_id", "sha"], "left_anti").drop("sha")
    many = HOT
    marks = rest.mapInArrow(lean(lambda it: _fingerprints(it, buckets)), "bucket long, ids binary, counts binary, marks binary, doc_id long")
    lists = cut(marks.groupBy("bucket").applyInPandas(lambda pdf: _meet(pdf, many), "doc_id long, kind string, marks binary"))
    per = lists.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "marks")).alias("lists"))
    touched = cut(lists.select("doc_id").distinct())
    groups = max(8, (lists.where("kind <> 'whole'").agg(F.sum(F.octet_length("marks"))).first()[0] or 0) // 16 // BATCH_PIECES)
    parts = with_ids(rest, touched, "doc_id").join(per, "doc_id").mapInArrow(lean(lambda it: _cut_out(it, groups)), "doc_id long, spans binary, batch long, minimizer long, start long, piece binary")
    parts = cut(parts)
    sorted_ = parts.where("batch is not null").select("doc_id", "batch", "minimizer", "start", "piece").groupBy("batch").applyInPandas(_sorted_batch, "doc_id long, spans binary")
    spans = cut(parts.where("spans is not null").select("doc_id", "spans").union(sorted_))
    losing = cut(spans.select("doc_id").distinct())
    removed = with_ids(rest, losing, "doc_id").join(spans.groupBy("doc_id").agg(F.collect_list("spans").alias("all")), "doc_id")
    columns = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string"
    removed = removed.mapInArrow(lean(_remove), columns)
    span = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    none = F.slice(span, 1, 0)
    other = with_ids(base, losing, "doc_id", "left_anti") if losing.take(1) else base
    if several:
        other = other.unionByName(with_ids(with_ids(base, parted, ["doc_id", "sha"], "left_semi"), losing, "doc_id").select(other.columns))
    gone = other.join(first, "sha", "left").withColumn("gone", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)))
    plain = gone.select("doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(F.col("gone"), span).otherwise(none).alias("removed"), F.when(F.col("gone"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
    return removed.unionByName(plain).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "removed", "kept_sha256")
