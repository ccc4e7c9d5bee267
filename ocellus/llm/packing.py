"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import read_table, shuffle_partitions, small, small_batches, stored
from ocellus.llm.tokens import arrow_bytes, default_path, tokenizer

CAPACITY = 2048
GROUP_PIECES = 50_000
FAN_IN = 16


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indexes into ``lengths``; each item goes where least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the sorted rooms that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, capacity - n
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
            room -= n
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(b)
    return bins


def _step(k: int, bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int, items: list[tuple[int, int, int]]):
    """The step with the largest gain for receiver k: (giver, items taken, items given back), or None.

    items: (length, index, bin) of what lies in underfull bins, ascending. Givers are no fuller than k.
    """
    room, best, gain = capacity - fill[k], None, 0

    def largest(most: int, least: int):
        at = bisect_right(items, (most, len(lengths), 0)) - 1
        while at >= 0 and items[at][0] > least:
            _, i, b = items[at]
            if b != k and fill[b] <= fill[k]:
                return i, b
            at -= 1
        return None

    if found := largest(room, 0):
        best, gain = (found[1], [found[0]], []), lengths[found[0]]
    for own in {lengths[i]: i for i in bins[k]}.values():
        if gain < room and (found := largest(lengths[own] + room, lengths[own] + gain)):
            best, gain = (found[1], [found[0]], [own]), lengths[found[0]] - lengths[own]
    if gain < room:
        for giver in {b for _, _, b in items if b != k and fill[b] <= fill[k] and len(bins[b]) > 1}:
            theirs = sorted(bins[giver], key=lambda i: (lengths[i], i))
            for own in {lengths[i]: i for i in bins[k]}.values():
                a, z = 0, len(theirs) - 1
                while a < z:
                    more = lengths[theirs[a]] + lengths[theirs[z]] - lengths[own]
                    if more > room:
                        z -= 1
                        continue
                    if more > gain:
                        best, gain = (giver, [theirs[a], theirs[z]], [own]), more
                    a += 1
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move documents, or exchange one for one or two for one, between underfull bins until no step helps.

    Receivers go from the fullest underfull bin down and take from bins no fuller than themselves, so
    each step raises the sum of squared fills and the search ends; bins that have given all are gone.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        open_ = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k))
        items = sorted((lengths[i], i, k) for k in open_ for i in bins[k])
        changed = False
        for k in open_:
            while 0 < fill[k] < capacity and (step := _step(k, bins, fill, lengths, capacity, items)):
                giver, take, give = step
                for i, a, b in [(i, giver, k) for i in take] + [(i, k, giver) for i in give]:
                    bins[a].remove(i)
                    bins[b].append(i)
                    items.pop(bisect_left(items, (lengths[i], i, a)))
                    insort(items, (lengths[i], i, b))
                    fill[a] -= lengths[i]
                    fill[b] += lengths[i]
                changed = True
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, part long, open boolean"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each whole text's ids and the end id: only longer documents are cut, every ``capacity`` ids.

    A null or empty text is one piece with the end id.
    """

    def run(batches):
        t = tokenizer(path)
        end = t.dtype.type(end_id)
        for b in small(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), t.encode_batch(arrow_bytes(b.column(1)))):
                wide = np.append(ids, end).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(wide), 4 * capacity)):
                    part = wide[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, open_bins: int = 64) -> DataFrame:
    """Pieces with their sequence_id and offset. The rows of ``pieces`` should be stored, as they are counted first.

    Pieces are dealt by hash to groups of about ``group_pieces``, each packed by one task with best
    fit and swaps. A group's emptiest bins, ``open_bins`` at most, are unpacked and packed anew
    together with those of 15 other groups, level by level, until one group is left: so few bins stay
    underfull however many groups there are, and no task sees more than a bounded number of pieces.
    Within a bin pieces lie in descending length.
    """
    spark = pieces.sparkSession
    groups = max(shuffle_partitions(spark), -(-pieces.count() // group_pieces))
    todo = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    done, level = None, 0
    while True:
        last = groups == 1
        placed = stored(todo.groupBy("part").applyInArrow(_packer(capacity, level, 0 if last else open_bins), PLACED), f"packed-{level}")
        closed = placed.filter("not open").drop("part", "open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        groups, level = -(-groups // FAN_IN), level + 1
        todo = placed.filter("open").select("doc_id", "piece", "start", "length", "ids_crc32", F.expr(f"part div {FAN_IN}").alias("part"))


def _packer(capacity: int, level: int, open_bins: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]))
        lengths = [r["length"] for r in rows]
        bins = sorted(pack(lengths, capacity), key=lambda b: (-sum(lengths[i] for i in b), b))
        out = []
        for k, b in enumerate(bins):
            full, at = sum(lengths[i] for i in b), 0
            for i in sorted(b):
                out.append(rows[i] | {"sequence_id": (level << 58) + (rows[0]["part"] << 26) + k, "offset": at, "open": k >= len(bins) - open_bins and full < capacity * 0.98})
                at += lengths[i]
        return pa.Table.from_pylist(out, schema)

    return run


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(stored(cut_pieces(read_table(spark, sf_dir, "documents"), default_path(), 0), "pieces"))
