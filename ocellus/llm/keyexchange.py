"""Corpus-wide counts for 64-bit keys that numpy makes from texts, without a row for each key.

Texts are dealt by hash to chunks. A chunk makes its keys, sorts them and sends each key range's
distinct keys, packed, to that range's bucket; a bucket merges what all chunks sent and answers each
chunk by values in the order of its keys; the chunk, making its keys again, finds every key's value by
position. Hot keys are one entry for each chunk, as a chunk sends distinct keys with their counts, and
both chunks and buckets are even in size since either follows a hash. A task holds one chunk or one
bucket: their number follows the number of rows and ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import shuffle_partitions, small_batches

CHUNK_ROWS = 2500
SENT = "bucket int, chunk int, keys binary, extra binary"


def chunk_count(docs: DataFrame, rows: int = CHUNK_ROWS) -> int:
    """One chunk for each shuffle partition, and one for each ``rows`` rows at least."""
    return max(shuffle_partitions(docs.sparkSession), -(-docs.count() // rows))


def bucket_count(docs: DataFrame, chunks: int) -> int:
    """Two buckets for each shuffle partition, and one for eight chunks at least: a chunk sends a value to each."""
    return max(2 * shuffle_partitions(docs.sparkSession), -(-chunks // 8))


def chunked(docs: DataFrame, chunks: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(chunk, text, row): row has the columns ``keep`` (default: all but the text)."""
    small_batches(docs)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    text = F.col(text_col).cast("string")
    return docs.select(F.pmod(F.xxhash64(*[F.col(c) for c in keep], text), F.lit(chunks)).cast("int").alias("chunk"), text.alias("text"), F.struct(*keep).alias("row"))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes: the planes of high bytes are zeros, which any codec shrinks."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in byte planes of the least width that holds them, behind that width."""
    most = int(counts.max(initial=0))
    dtype = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return bytes([np.dtype(dtype).itemsize]) + planes(counts.astype(dtype))


def widen(data: bytes) -> np.ndarray:
    return unplanes(data[1:], f"u{data[0]}")


def edges(buckets: int) -> np.ndarray:
    """First keys of all buckets: equal ranges of 64 bits."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def send(chunk: int, keys: np.ndarray, buckets: int, extra: Callable[[int, int], bytes]) -> pa.Table:
    """Rows for all buckets that have some of the sorted ``keys``; extra(a, z) is sent with keys[a:z]."""
    cuts = np.append(np.searchsorted(keys, edges(buckets)), len(keys))
    to = np.flatnonzero(np.diff(cuts))
    return pa.table(
        [pa.array(to.astype(np.int32)), pa.array(np.full(len(to), chunk, np.int32)), pa.array([pack_keys(keys[cuts[b] : cuts[b + 1]]) for b in to], pa.binary()), pa.array([extra(cuts[b], cuts[b + 1]) for b in to], pa.binary())],
        ["bucket", "chunk", "keys", "extra"],
    )


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[bytes]]:
    """What a bucket got: (distinct keys, each entry's place among them, cuts of senders, chunks, extras)."""
    parts = [unpack_keys(x) for x in table["keys"].to_pylist()]
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, inverse, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), table["chunk"].to_pylist(), table["extra"].to_pylist()


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among a chunk's sorted keys, and the end."""
    return np.append(np.searchsorted(keys, edges(buckets)), len(keys))


def answers(table: pa.Table, column: str = "answer") -> Iterator[tuple[int, bytes]]:
    return zip(table["bucket"].to_pylist(), table[column].to_pylist())
