"""Substring dedup: every 35-word window is hashed and counted; what repeated windows cover is removed."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import blocks, read_table, text_buffer
from ocellus.llm.hashing import Hasher, fresh, window_starts, word_bounds
from ocellus.llm.keyexchange import SENT, answers, bucket_count, chunk_count, chunked, merged, planes, ranges, send, unpack_keys, unplanes

WINDOW = 35


def chunk_windows(texts: pa.ChunkedArray, width: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, its first word's number in the chunk, words before each text)."""
    buf, offsets = text_buffer(texts)
    keys, at, before, done = [], [], [np.zeros(1, np.int64)], 0
    for i, j in blocks(offsets):
        part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, counts = word_bounds(part, offs)
        inside = window_starts(counts, width)
        if inside.any():
            keys.append(hasher.windows(hasher.words(part, starts, ends), width)[inside])
            at.append(np.flatnonzero(inside) + done)
        before.append(counts[1:] + done)
        done += len(starts)
    none = np.zeros(0, np.uint64)
    return np.concatenate(keys) if keys else none, np.concatenate(at) if at else none.astype(np.int64), np.concatenate(before)


def covered(at: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which words the windows that begin at ``at`` cover: windows that overlap or touch merge."""
    change = np.zeros(n_words + 1, np.int32)
    change[at] += 1
    np.subtract.at(change, at + width, 1)
    return np.cumsum(change[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first word, word behind the last) of a document's removed words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove_repeats(docs: DataFrame, width: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Remove each word that a repeated window covers: row, n_words, n_removed, kept_text, removed.

    Words are runs of bytes but 0x20 and 0x09-0x0D. A window is ``width`` consecutive words of one
    text; it is repeated if the same words begin a window anywhere else, in the same text too. Windows
    are judged on the input. ``removed`` has the maximal intervals of word numbers; ``kept_text`` the
    kept words joined by one space; with ``whole``, a text that loses nothing is kept as it is. ``row`` has the columns ``keep`` (default: all but the text).
    Null and empty texts have no words; repeated rows repeat each other's windows, whatever their id.

    A first Rabin-Karp hash of every window is counted: a chunk sends each of its distinct hashes once,
    with a bit for those that it has twice. Windows whose hash repeats are then sent with a second hash
    of other bases, and count as repeated only if the pair does. Two different windows so are taken for
    equal with a chance of about (width / 2**61)**2 over the seeds, 1e-33, whatever their words are.
    Rows that are equal in all of ``keep`` and the text are dealt to one chunk, as a task must get the
    same rows again.
    """
    chunks = chunk_count(docs)
    buckets = bucket_count(docs, chunks)
    texts = chunked(docs, chunks, text_col, keep)
    first, second = fresh(), fresh()

    def bits(x: np.ndarray) -> bytes:
        return np.packbits(x).tobytes()

    def unbits(x: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)

    def emit(table: pa.Table) -> pa.Table:
        keys, n = np.unique(chunk_windows(table["text"], width, first)[0], return_counts=True)
        return send(table["chunk"][0].as_py(), keys, buckets, lambda a, z: bits(n[a:z] > 1))

    def judge(table: pa.Table) -> pa.Table:
        keys, inverse, cuts, sent_by, twice = merged(table)
        repeated = np.bincount(inverse, minlength=len(keys)) > 1
        for k, x in enumerate(twice):
            own = inverse[cuts[k] : cuts[k + 1]]
            repeated[own[unbits(x, len(own))]] = True
        found = [(k, repeated[inverse[cuts[k] : cuts[k + 1]]]) for k in range(len(sent_by))]
        found = [(k, x) for k, x in found if x.any()]
        return pa.table([pa.array([sent_by[k] for k, _ in found], pa.int32()), pa.array([table["bucket"][0].as_py()] * len(found), pa.int32()), pa.array([bits(x) for _, x in found], pa.binary())], ["chunk", "bucket", "answer"])

    def repeats(hashes: np.ndarray, told: pa.Table) -> np.ndarray:
        """Which windows have a hash that repeats."""
        keys, inverse = np.unique(hashes, return_inverse=True)
        repeated, cuts = np.zeros(len(keys), bool), ranges(keys, buckets)
        for b, x in answers(told):
            if b >= 0:
                repeated[cuts[b] : cuts[b + 1]] = unbits(x, cuts[b + 1] - cuts[b])
        return repeated[inverse]

    def pairs(table: pa.Table, told: pa.Table) -> pa.Table:
        """The pairs of hashes of windows whose first hash repeats, to the first hash's bucket."""
        if not told.num_rows or not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], ["bucket", "chunk", "keys", "extra"])
        x = chunk_windows(table["text"], width, first)[0]
        some = np.flatnonzero(repeats(x, told))
        x, y = x[some], chunk_windows(table["text"], width, second)[0][some]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        n, x, y = np.diff(np.append(at, len(x))), x[at], y[at]
        return send(table["chunk"][0].as_py(), x, buckets, lambda a, z: planes(y[a:z]) + bits(n[a:z] > 1))

    def refute(table: pa.Table) -> pa.Table:
        """Pairs that do not repeat, although their first hash does: none, but for chance."""
        x = [unpack_keys(k) for k in table["keys"].to_pylist()]
        sizes = [len(k) for k in x]
        y = [unplanes(e[: 8 * n], np.uint64) for e, n in zip(table["extra"].to_pylist(), sizes)]
        twice = np.concatenate([unbits(e[8 * n :], n) for e, n in zip(table["extra"].to_pylist(), sizes)])
        x, y, by = np.concatenate(x), np.concatenate(y), np.repeat(table["chunk"].to_numpy(), sizes)
        order = np.lexsort((y, x))
        x, y, by, twice = x[order], y[order], by[order], twice[order]
        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        alone = at[(np.diff(np.append(at, len(x))) == 1) & ~twice[at]]
        return pa.table([pa.array(by[alone].astype(np.int32)), pa.array(np.full(len(alone), -1, np.int32)), pa.array([np.array([a, b], "<u8").tobytes() for a, b in zip(x[alone], y[alone])], pa.binary())], ["chunk", "bucket", "answer"])

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        hashes, at, before = chunk_windows(table["text"], width, first)
        repeated = repeats(hashes, told)
        wrong = {x for b, x in answers(told) if b < 0}
        if wrong:
            other = chunk_windows(table["text"], width, second)[0]
            for k in np.flatnonzero(repeated):
                repeated[k] = np.array([hashes[k], other[k]], "<u8").tobytes() not in wrong
        gone = covered(at[repeated], width, int(before[-1]))
        n_removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = n_removed[before[1:]] - n_removed[before[:-1]]
        texts, runs = [], []
        for k, text in enumerate(table["text"].cast(pa.large_binary()).to_pylist()):
            if whole and not n_removed[k]:
                texts.append(text or b"")
                runs.append([])
                continue
            words = (text or b"").split()
            if n_removed[k]:
                mask = gone[before[k] : before[k + 1]]
                words = compress(words, ~mask)
                runs.append([{"start": a, "stop": z} for a, z in intervals(mask)])
            else:
                runs.append([])
            texts.append(b" ".join(words))
        return pa.table([table["row"], pa.array(np.diff(before)), pa.array(n_removed), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["row", "n_words", "n_removed", "kept_text", "removed"])

    sent = texts.groupBy("chunk").applyInArrow(emit, SENT)
    told = sent.groupBy("bucket").applyInArrow(judge, "chunk int, bucket int, answer binary")
    wrong = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(pairs, SENT).groupBy("bucket").applyInArrow(refute, told.schema)
    told = told.union(wrong)
    schema = f"row {texts.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string, removed array<struct<start:int,stop:int>>"
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM p),
r AS (SELECT win FROM k GROUP BY win HAVING count(*) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM k JOIN r USING (win)),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
f AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, gone FROM w LEFT JOIN g USING (doc_id)),
t AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN x USING (doc_id, i)),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM f LEFT JOIN s USING (doc_id)
"""
