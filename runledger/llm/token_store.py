"""Token ids in patched frame-of-reference blocks.

A store is a Parquet dataset that Spark writes; a row is a shard: the bytes of one file of the format below, its place
(part, seq) and its counts. Shards follow each other in ascending doc_id order. All numbers are little-endian.

    magic "PFOR1\\0\\0\\0", uint64 documents, ids, blocks
    int64 doc_ids, uint8 is-null flags, uint64 ids of each document, end id included
    uint64 index: start of each block in the body, and the body's length
    body: blocks of BLOCK ids (the last is padded with its own minimum): uint32 minimum, uint8 width, uint8 outliers,
          BLOCK * width bits of the differences' low bits, uint8 places and uint32 high bits of the outliers

The width is that of the PERCENTILE of a block's differences; larger ones are outliers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_slices, lean, shared_dir, text_buffer

BLOCK, PERCENTILE, SHARD = 128, 0.9, 1 << 18
MAGIC = b"PFOR1\0\0\0"
END = 0
#: Bytes of text that are encoded together, or one text; bytes of chunks and ids that a worker remembers; bytes of new
#: chunks that the library gets at once, or one chunk: it takes many times as much memory.
SLICE, CACHE_BYTES, LEARN = 4 << 20, 32 << 20, 1 << 18


def _scatter(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    out[at[:, None] + np.arange(rows.shape[1])] = rows


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Index and body of an array of ids under 2**32."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, "<u8"), b""
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    x = x.reshape(n, BLOCK)
    low = x.min(1)
    x = x - low[:, None]
    edge = np.sort(x, 1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.zeros(n, np.int64)
    for w in range(32):
        width += edge >> np.uint32(w) > 0
    out = (x >> width[:, None].astype(np.uint64)) > 0
    odd = out.sum(1)
    index = np.zeros(n + 1, np.int64)
    np.cumsum(6 + BLOCK // 8 * width + 5 * odd, out=index[1:])
    body = np.zeros(index[-1], np.uint8)
    _scatter(body, index[:-1], low.astype("<u4").view(np.uint8).reshape(n, 4))
    body[index[:-1] + 4] = width
    body[index[:-1] + 5] = odd
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = (x[rows][:, :, None] >> np.arange(w, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)
            _scatter(body, index[rows] + 6, np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"))
    row, place = np.nonzero(out)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
        start = index[row] + 6 + BLOCK // 8 * width[row]
        body[start + nth] = place
        high = (x[row, place] >> width[row].astype(np.uint64)).astype("<u4")
        _scatter(body, start + odd[row] + 4 * nth, high.view(np.uint8).reshape(-1, 4))
    return index.astype("<u8"), body.tobytes()


def unpack(index: np.ndarray, body: np.ndarray, count: int, first: int = 0) -> np.ndarray:
    """The ids of the blocks of an index (of which first is the place of index[0] in the body)."""
    n = len(index) - 1
    if not n:
        return np.empty(0, np.uint32)
    at = index[:-1].astype(np.int64) - first
    low = body[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, odd = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    x = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(body[at[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            for k in range(w):
                x[rows] |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    if odd.any():
        row = np.repeat(np.arange(n), odd)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
        start = at[row] + 6 + BLOCK // 8 * width[row]
        high = body[(start + odd[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        x[row, body[start + nth]] |= high << width[row].astype(np.uint32)
    return (x + low[:, None]).ravel()[:count]


def to_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    index, body = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(index) - 1], "<u8").tobytes()
    return b"".join((MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(), index.tobytes(), body))


def from_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard")
    docs, count, blocks = map(int, np.frombuffer(shard, "<u8", 3, 8))
    at = 32
    ids = np.frombuffer(shard, "<i8", docs, at).tolist()
    null = np.frombuffer(shard, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(shard, "<u8", docs, at := at + docs).astype(np.int64)
    index = np.frombuffer(shard, "<u8", blocks + 1, at := at + 8 * docs)
    body = np.frombuffer(shard, np.uint8, offset=at + 8 * (blocks + 1)) if blocks else np.empty(0, np.uint8)
    return [None if x else d for d, x in zip(ids, null, strict=True)], lengths, unpack(index, body, count)


#: Classes of bytes by which texts are cut: 1 letters, 2 digits, 3 other visible ASCII but ', 4 white space but the blank,
#: 5 the blank, 0 all else; and the bytes that begin a character that certainly isn't white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 0
_CLASS[9:14] = 4
_CLASS[32] = 5
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(33, 127), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


class Encoder:
    """Encodes whole texts with a file of the tokenizers library.

    Byte-level BPE's pre-tokenizer always begins a new piece at some places: between letters, digits and signs, before
    white space, before the last white space of several, and after white space that isn't a blank. Texts are cut there
    (where only ASCII, or bytes that can't be white space, are at hand to tell), so a text's ids are those of its
    chunks. The different chunks of a batch are looked up among those seen before (CACHE_BYTES of them at most) and
    their ids gathered by array operations. New chunks without white space are encoded as one text of lines, whose ids
    are dealt back by the bytes that each id stands for; where the ends don't fall on line ends, and for other chunks,
    each is encoded on its own."""

    def __init__(self, path: str, by_chunk: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_chunk = by_chunk and type(self.library.pre_tokenizer).__name__ == "ByteLevel"
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.binary())
        self.ends, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and their number in each."""
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found or [np.empty(0, np.uint32)]), np.array([len(f) for f in found], np.int64)

    def _lines(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks without white space but a leading blank."""
        texts = chunks.to_pylist()
        ids = np.array(self.library.encode_batch_fast([b"\n".join(texts).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64) + 1)
        at = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(at, ends - 1)  # the last id of each chunk; that of the line end follows
        if not len(at) or at[-1] != ends[-1] - 1 or (at[cut] != ends - 1).any() or (at[cut[:-1] + 1] != ends[:-1]).any():
            return self._plain([t.decode("utf-8", "replace") for t in texts])
        inside = np.ones(len(ids), bool)
        inside[cut[:-1] + 1] = False
        return ids[inside], np.diff(cut, prepend=-1) - (np.arange(len(cut)) > 0)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Adds new chunks to those known and returns their numbers."""
        column = pa.RecordBatch.from_arrays([chunks.cast(pa.large_binary())], ["chunk"])
        return np.concatenate([self._add(chunks.slice(low, high - low)) for low, high in arrow_slices(column, "chunk", LEARN)])

    def _add(self, chunks: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(chunks.cast(pa.large_binary()))
        low = int(offsets[0])
        data, offsets = data[low : int(offsets[-1])], offsets - low
        odd = np.zeros(len(data) + 1, np.int64)
        hidden = (data < 0x80) | (data >= 0xC0)  # bytes that continue a character don't count
        np.cumsum(~_VISIBLE[data] & hidden, out=odd[1:])
        count, first = np.diff(odd[offsets]), data[offsets[:-1]]
        plain = count == ((first == 32) & (np.diff(offsets) > 1))
        parts = [(self._lines, pa.array(plain)), (lambda c: self._plain([t.decode("utf-8", "replace") for t in c.to_pylist()]), pa.array(~plain))]
        for encode, mask in parts:
            some = chunks.filter(mask)
            if len(some):
                ids, n = encode(some)
                self.keys = pa.concat_arrays([self.keys, some])
                self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(n)))
                self.ids = np.concatenate((self.ids, ids))
        number = np.empty(len(chunks), np.int64)
        number[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(self.keys) - len(chunks), len(self.keys))
        return number

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin."""
        kind, visible = _CLASS[data], _VISIBLE[data]
        blank, word = kind >= 4, (kind > 0) & (kind < 4)
        cut = np.zeros(len(data), bool)
        cut[1:] = (word[:-1] & word[1:] & (kind[:-1] != kind[1:])) | (word[:-1] & blank[1:]) | ((kind[:-1] == 4) & visible[1:])
        visible[offsets[:-1][offsets[:-1] < len(data)]] = False  # what follows in another text doesn't count
        cut[1:-1] |= blank[1:-1] & visible[2:]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) and their number in each."""
        if not self.by_chunk:
            return self._plain(texts.to_pylist())
        whole = np.zeros(len(texts), bool)  # texts that hold a token which the library looks for before it cuts
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_chunk(texts)
        both = self._by_chunk(texts.filter(pa.array(~whole))), self._plain(texts.filter(pa.array(whole)).to_pylist())
        count = np.empty(len(texts), np.int64)
        count[~whole], count[whole] = both[0][1], both[1][1]
        ids, of = np.empty(count.sum(), np.uint32), np.repeat(whole, count)
        ids[~of], ids[of] = both[0][0], both[1][0]
        return ids, count

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(texts)
        low = int(offsets[0])
        data, offsets = data[low : int(offsets[-1])], offsets - low
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self._starts(data, offsets)
        places = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        if self.keys.nbytes + self.ids.nbytes + self.ends.nbytes > CACHE_BYTES:
            self._forget()
        number = pc.index_in(chunks.dictionary, value_set=self.keys)
        new = number.is_null()
        number = number.fill_null(0).to_numpy().astype(np.int64)
        if number.size and pc.any(new).as_py():
            number[new.to_numpy(zero_copy_only=False)] = self._learn(chunks.dictionary.filter(new))
        number = number[chunks.indices.to_numpy()]
        count = np.diff(self.ends)[number]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.ends[number] - (stop - count), count) + np.arange(stop[-1])]
        before = np.concatenate(([0], stop))[np.searchsorted(starts, offsets)]
        return ids, np.diff(before)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode, part, seq = encoder(path), TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    pieces: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch:
        body = to_shard(doc_ids, [len(p) for p in pieces], np.concatenate(pieces))
        row = [[part], [seq], [len(doc_ids)], [size], [body]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "bytes"])

    for batch in batches:
        for low, high in arrow_slices(batch, "text", SLICE):
            some = batch.slice(low, high - low)
            ids, count = encode(some.column("text").fill_null(""))
            ends = np.cumsum(count)
            ids, ends = np.insert(ids, ends, END), ends + np.arange(1, len(ends) + 1)
            for d, a, b in zip(some.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                doc_ids.append(d)
                pieces.append(ids[a:b])
                size += b - a
                if size >= SHARD:
                    yield shard()
                    doc_ids, pieces, size, seq = [], [], 0, seq + 1
    if doc_ids:
        yield shard()


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes every text (null: empty) of docs and writes the store in ascending doc_id order, nulls first.

    Rows of one doc_id are all kept, ordered by a hash of their text. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(lean(lambda it: _encode(it, tokenizer)), "part long, seq long, n_docs long, n_tokens long, bytes binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The store's shards with start, the number of ids before each. Sums run over shards of a part, then over parts."""
    shards = spark.read.schema("part long, seq long, n_docs long, n_tokens long, bytes binary").parquet(path)
    counts = shards.select("part", "seq", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = counts.select("part", "seq", inner.alias("inner")).join(parts, "part").select("part", "seq", (F.col("inner") + F.col("part_start")).alias("start"))
    return shards.join(starts, ["part", "seq"])


def _rows(digest: Callable[[bytes], int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, shard in zip(batch.column("start").to_pylist(), batch.column("bytes"), strict=True):
                doc_ids, lengths, ids = from_shard(shard.as_py())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = ids.astype("<u4")
                if digest is None:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(raw.astype(np.int64)))
                else:
                    last = pa.array([digest(raw[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids" if digest is None else "ids_crc32"])

    return work


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a store."""
    return read_shards(spark, path).select("start", "bytes").mapInArrow(lean(_rows(None)), "doc_id long, start long, n_tokens long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store."""
    return read_shards(spark, path).select("start", "bytes").mapInArrow(lean(_rows(zlib.crc32)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store of docs to the shared folder and reads its digests back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer)
    return read_digests(spark, path)
