"""Elias-Fano coded document borders over a concatenated id array, and the shard files that hold both."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.llm.common import broadcast_if_small, read_table, shuffle_partitions, small, small_batches, stored
from ocellus.llm.tokens import arrow_bytes, default_path, tokenizer

MAGIC = b"EFIDS2\0\0"
_HEAD = struct.Struct("<8sQQBBHI")
SAMPLE = 256
SHARD_BYTES, SHARD_DOCS = 400_000, 20_000


class EliasFano:
    """A non-decreasing sequence of n values up to u in about n * (2 + log2(u / n)) bits, and n / 8 for select.

    Low bits lie packed; high bits are unary: bit (v >> low) + i is set for value i. The place of every
    256th set bit is stored with it (``samples``, 32 bits each); select goes from there over 64-bit words by their
    numbers of set bits. No table of all values or ranks is made: ``select`` answers a batch of places.
    """

    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.lows, self.highs, self.samples = n, universe, low, lows, highs, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        marks = np.zeros((universe >> low) + n + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, universe, low, _to_words(bits.reshape(-1)), _to_words(marks), at[::SAMPLE].astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Positions of the i-th set bits, from 0; ``i`` ascends.

        From the sample before each, one word forward at a time for all that haven't met theirs; then the bit within the word
        by halves.
        """
        i = np.asarray(i, np.int64)
        start = self.samples[i // SAMPLE].astype(np.int64)
        at, left = start >> 6, i % SAMPLE
        word = self.highs[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (start & 63).astype(np.uint64))
        todo = np.arange(len(i))
        while len(todo):
            ones = np.bitwise_count(word[todo]).astype(np.int64)
            todo, ones = todo[left[todo] >= ones], ones[left[todo] >= ones]
            left[todo] -= ones
            at[todo] += 1
            word[todo] = self.highs[at[todo]]
        bit = np.zeros(len(i), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count((word >> bit) & np.uint64((1 << width) - 1)).astype(np.int64)
            further = left >= below
            left -= np.where(further, below, 0)
            bit += np.where(further, np.uint64(width), np.uint64(0))
        return (at << 6) + bit.astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The i-th values; ``i`` ascends."""
        i = np.asarray(i, np.int64)
        high = (self.select(i) - i) << self.low
        if not self.low:
            return high
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = self.lows[word] >> shift
        over = np.flatnonzero(shift.astype(np.int64) + self.low > 64)
        low[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return high | (low & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.values(np.array([i]))[0])

    def dumps(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.universe, self.low, len(self.lows), len(self.highs)) + self.lows.astype("<u8").tobytes() + self.highs.astype("<u8").tobytes() + self.samples.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        n, universe, low, a, b = struct.unpack_from("<QQQQQ", data)
        return cls(n, universe, low, np.frombuffer(data, "<u8", a, 40), np.frombuffer(data, "<u8", b, 40 + 8 * a), np.frombuffer(data, "<u4", -(-n // SAMPLE), 40 + 8 * (a + b)))


def _to_words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8").astype(np.uint64)


def write_shard(ids: list[bytes], width: int) -> bytes:
    """A shard file: header, Elias-Fano coded ends of the documents with its select samples, then all ids of ``width`` bytes each."""
    ends = EliasFano.build(np.cumsum([len(x) // width for x in ids]) if ids else np.zeros(0)).dumps()
    body = b"".join(ids)
    return _HEAD.pack(MAGIC, len(ids), len(body) // width, width, 0, 0, len(ends)) + ends + body


class Shard:
    """Reader of a shard file: ``shard[i]`` gives document i's ids by two selects, no table of offsets."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, width, _, _, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no shard file")
        self.ends = EliasFano.loads(data[_HEAD.size : _HEAD.size + size])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, _HEAD.size + size)

    def __len__(self) -> int:
        return self.n_docs

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]

    def offsets(self, first: int, stop: int) -> np.ndarray:
        """Where documents first .. stop - 1 begin, and where the last ends: a batch of selects."""
        ends = self.ends.values(np.arange(max(0, first - 1), stop))
        return ends if first else np.append(0, ends)


def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text and the end id, little-endian. Null texts: the end id."""
    small_batches(docs)

    def run(batches):
        t = tokenizer(path)
        end = np.array([end_id], t.dtype).tobytes()
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() + end for x in t.encode_batch(arrow_bytes(b.column(1)))], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write_shards(docs: DataFrame, path: str, end_id: int, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shard files of consecutive doc ids, as a stored table (shard, file, doc_ids, n_ids, data).

    Shards are ranges of the order (doc_id, hash of the ids, ids), of about ``shard_docs`` documents
    each, two for each shuffle partition at least, by Spark's range partitioning over (doc_id, hash): their number follows the
    number of documents, and rows that repeat an id are split like others, but for those whose ids are
    equal too. Texts are tokenized once and stored as ids, and only ids are shuffled. A shard streams
    through its task and is cut into files of about ``shard_bytes``, so a task holds one file. Null ids come first. An
    empty table gives no shard.
    """
    spark = docs.sparkSession
    width = tokenizer(path).width
    ids = stored(token_ids(docs, path, end_id), "token-ids", "zstd")
    shards = max(2 * shuffle_partitions(spark), -(-ids.count() // shard_docs))
    order = ["doc_id", "h", "ids"]
    ranged = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions(*order)

    def build(batches):
        from pyspark import TaskContext

        part, file, size = TaskContext.get().partitionId(), 0, 0
        docs_: list[int | None] = []
        own: list[bytes] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([sum(map(len, own)) // width], pa.int64()), pa.array([write_shard(own, width)], pa.binary())], ["shard", "file", "doc_ids", "n_ids", "data"])

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                docs_.append(doc)
                own.append(x.as_py())
                size += len(own[-1])
                if size >= shard_bytes:
                    yield close()
                    file, size, docs_, own = file + 1, 0, [], []
        if own:
            yield close()

    return stored(ranged.select("doc_id", "ids").mapInArrow(build, "shard int, file int, doc_ids array<bigint>, n_ids bigint, data binary"), "id-shards", "zstd")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files' bytes.

    start counts all ids before the document: ids of the shards before, summed over one row a shard, ids
    of the shard's files before, and the offset that select gives.
    """
    within = Window.partitionBy("shard").orderBy("file")
    files = shards.select("shard", "file", "n_ids", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("own"))
    totals = stored(shards.groupBy("shard").agg(F.sum("n_ids").alias("total")), "shard-totals")  # one row a shard
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("first"))
    places = stored(files.join(broadcast_if_small(stored(before, "shard-starts")), "shard").select("shard", "file", (F.col("own") + F.col("first")).alias("before")), "file-starts")

    def run(batches):
        for b in batches:
            for ids, before_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                shard = Shard(data.as_py())
                for at in range(0, len(shard), 4096):
                    cuts = shard.offsets(at, min(at + 4096, len(shard)))
                    crcs = [zlib.crc32(shard.ids[a:z].astype("<u4").tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 4096], pa.int64()), pa.array(cuts[:-1] + before_), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(broadcast_if_small(places), ["shard", "file"]).select("doc_ids", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read_table(spark, sf_dir, "documents"), default_path(), 2))
