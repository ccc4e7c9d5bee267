"""Approximate nearest neighbours on shifted Hilbert curves: windows of neighbouring keys, merged and reranked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.llm.common import read_table, shuffle_partitions, stored

CURVES, DIMS, BITS = 8, 6, 10
FIT_ROWS, FIT_QUERIES, RECALL, SEGMENT_ROWS, QUERY_ROWS = 10_000, 128, 0.98, 20_000, 4096


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2**bits (columns * bits at most 63).

    The transposed index by reflections and exchanges of the coordinates' bits from the top down, then
    Gray decoding; all rows at once.
    """
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curves:
    """Per curve a random orthonormal projection, and a shift of the grid of a third of its side at most.

    low, high: bounds of the projections, of the sample that fitted them; what lies outside is clipped.
    """

    def __init__(self, dim: int, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, dims = bits, min(dims, dim)
        self.axes = [np.linalg.qr(rng.standard_normal((dim, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dims) / 3 for _ in range(curves)]
        self.low = self.high = None

    def fit(self, units: np.ndarray) -> Curves:
        seen = [units @ a for a in self.axes]
        self.low = [x.min(0) if len(x) else np.zeros(x.shape[1]) for x in seen]
        self.high = [np.maximum(x.max(0), lo + 1e-9) if len(x) else lo + 1 for x, lo in zip(seen, self.low)]
        return self

    def keys(self, units: np.ndarray, curve: int) -> np.ndarray:
        x = (units @ self.axes[curve] - self.low[curve]) / (self.high[curve] - self.low[curve])
        x = (np.clip(x, 0, 1) + self.shifts[curve]) * 0.75
        return hilbert_keys(np.minimum((1 << self.bits) - 1, (x * (1 << self.bits)).astype(np.int64)), self.bits)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a binary column as doubles; it has floats or doubles, as the table had."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(rows), np.float32 if len(rows[0]) == 4 * dim else np.float64).reshape(len(rows), dim).astype(np.float64)


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of rows that take part, v as bytes of floats or doubles; and the vectors' length.

    Left out: null ids, null, empty and zero vectors, null, infinite or NaN components, and vectors
    whose length isn't the table's most common one (ties to the shorter), as they have no cosine with it.
    """
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    dim = dim["n"] if dim else 1

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat.reshape(-1, dim)], pa.binary())], ["id", "v"])

    return rows.filter(F.size("v") == dim).mapInArrow(run, "id long, v binary"), dim


def _cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One query against rows, each row's sums in the same order wherever it stands."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def _nearest(query_ids, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, first=None, last=None):
    """(query, id, cosine) of each query's k nearest ids, with their nearest rows; first, last: the rows that count for a query."""
    out: list[tuple[int, int, float]] = []
    known, of = np.unique(ids, return_inverse=True)
    order = np.argsort(of, kind="stable") if len(known) < len(ids) else None
    cuts = np.searchsorted(of[order], np.arange(len(known))) if order is not None else None
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    for at in range(0, len(queries), 128):
        near = (queries[at : at + 128] / np.linalg.norm(queries[at : at + 128], axis=1)[:, None]) @ units.T
        for j, own in enumerate(near):
            n = at + j
            a, z = (0, len(ids)) if first is None else (max(0, int(first[n])), min(len(ids), int(last[n]) + 1))
            own[:a] = own[z:] = -np.inf
            own[ids == query_ids[n]] = -np.inf
            some = np.flatnonzero(own > -np.inf)
            each = own[some] if order is None else np.maximum.reduceat(own[order], cuts)
            each = each[each > -np.inf]  # the best row of each id
            if len(each) > k:
                least = np.partition(each, len(each) - k)[len(each) - k]
                some = some[own[some] >= least - 1e-9]  # ties and rounding are settled below
            exact = _cosines(queries[n], rows[some])
            best = np.lexsort((ids[some], -exact))
            best = best[np.sort(np.unique(ids[some[best]], return_index=True)[1])][:k]
            out += [(int(query_ids[n]), int(ids[some[x]]), float(exact[x])) for x in best]
    return out


FOUND = "query_id long, vec_id long, score double"


def _table(rows: list[tuple[int, int, float]]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the pairs found, ties to the smaller id: query_id, rank, vec_id, score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, dim: int, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries, against all rows in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        ids_ = [q for q, _ in shared.value]
        q = _matrix(pa.array([v for _, v in shared.value], pa.binary()), dim)
        for b in batches:
            if b.num_rows:
                yield from _table(_nearest(ids_, q, b.column(0).to_numpy(), _matrix(b.column(1), dim), k)).to_batches()

    return top(rows.mapInArrow(run, FOUND), k)


def search(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, by cosine in double precision.

    ``is_query``: condition on the column ``id``. Candidates are all rows with another id; repeated
    ids count once, with their nearest row. Fewer than k candidates: all of them.

    Every row goes on every curve; the curves are range-partitioned and sorted by Hilbert key, which
    gives each row its place. A query's candidates on a curve are the rows at most ``window`` places
    away; they are scored where they lie, segment by segment, and the curves' best are merged.
    The index is fitted on bounded samples: the grid's bounds on FIT_ROWS rows, and the window on
    FIT_QUERIES queries whose exact neighbours are found against all rows: it is the least one that
    holds the share ``recall`` of them on some curve, and a twentieth more. A segment that more than
    QUERY_ROWS query rows meet goes to several tasks, each with a share of them. Where neighbours are near
    in the projections it is small; where all directions look alike (random vectors) it grows with
    the table, as no curve can tell them apart, and the search nears a brute-force one.
    """
    spark = table.sparkSession
    rows, dim = vectors(table, id_col, vector_col)
    rows = stored(rows, "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = lambda df, most, total: df if total <= most else df.filter(F.pmod(F.xxhash64("id"), F.lit(total)) < most)
    seen = _matrix(sample(rows.select("id", "v"), FIT_ROWS, n).toArrow()["v"], dim)
    grid = Curves(dim, curves, dims, bits, seed).fit(seen / np.linalg.norm(seen, axis=1)[:, None])

    def to_keys(batches):
        for b in batches:
            v = _matrix(b.column(1), dim)
            units = v / np.linalg.norm(v, axis=1)[:, None]
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(grid.keys(units, c)), b.column(0), b.column(1)], ["curve", "key", "id", "v"])

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)), b.column(2), b.column(3)], ["curve", "part", "pos", "id", "v"])
            at += b.num_rows

    parts = max(2 * shuffle_partitions(spark), -(-n * curves // SEGMENT_ROWS))
    keyed = stored(rows.mapInArrow(to_keys, "curve int, key long, id long, v binary"), "curve-keys")
    ordered = keyed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    ordered = stored(ordered.mapInArrow(number, "curve int, part int, pos long, id long, v binary"), "curves")
    # A segment is what a curve has in a partition; there is a bounded number of them for each partition.
    segments = sorted(tuple(r) for r in ordered.groupBy("curve", "part").agg(F.min("pos"), F.count(F.lit(1))).collect())
    spots, before = [], dict.fromkeys(range(curves), 0)
    for s, (c, part, first, size) in enumerate(segments):
        spots.append((s, c, part, before[c] - first, before[c], before[c] + size))
        before[c] += size
    spots = spark.createDataFrame(spots, "segment int, curve int, part int, shift long, first long, stop long")
    placed = ordered.join(F.broadcast(spots.select("curve", "part", "segment", "shift")), ["curve", "part"]).select("segment", "curve", (F.col("pos") + F.col("shift")).alias("place"), "id", "v")

    n_queries = rows.filter(is_query).count()
    tried = [(r["id"], r["v"]) for r in sample(rows.filter(is_query), FIT_QUERIES, n_queries).limit(4 * FIT_QUERIES).collect()]
    window = n
    if tried:
        truth = brute_force(rows, dim, tried, k).select("query_id", "vec_id").collect()
        wanted = spark.createDataFrame([(i,) for i in sorted({i for r in truth for i in r} | {q for q, _ in tried})], "id long")
        place = {(r["curve"], r["id"]): r["place"] for r in placed.join(F.broadcast(wanted), "id").select("curve", "id", "place").collect()}
        gaps = np.sort([min(abs(place[c, q] - place[c, i]) for c in range(curves)) for q, i in truth])
        window = int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))] * 1.05) + 1 if len(gaps) else n
    queries = placed.filter(is_query).select("curve", F.col("id").alias("query_id"), (F.col("place") - window).alias("a"), (F.col("place") + window).alias("z"), F.col("v").alias("q"))
    asked = queries.join(F.broadcast(spots), "curve").filter("a < stop AND z >= first").select("segment", "query_id", (F.col("a") - F.col("first")).alias("a"), (F.col("z") - F.col("first")).alias("z"), "q")

    def look(own: pa.Table, asked_: pa.Table) -> pa.Table:
        if not own.num_rows or not asked_.num_rows:
            return _table([])
        own = own.sort_by("place")
        q = _matrix(asked_["q"], dim)
        return _table(_nearest(asked_["query_id"].to_numpy(), q, own["id"].to_numpy(), _matrix(own["v"], dim), k, asked_["a"].to_numpy(), asked_["z"].to_numpy()))

    # One row a segment that is asked; the others are not sent.
    load = asked.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("tasks"))
    shared_out = asked.join(F.broadcast(load), "segment").withColumn("task", F.pmod(F.xxhash64("query_id", "a"), F.col("tasks")).cast("int")).drop("tasks")
    own_rows = placed.join(F.broadcast(load), "segment").select("segment", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "place", "id", "v")
    found = own_rows.groupBy("segment", "task").cogroup(shared_out.groupBy("segment", "task")).applyInArrow(look, FOUND)
    return top(found, k)


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(50)) == 0)
