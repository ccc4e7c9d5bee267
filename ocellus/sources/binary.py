"""Readers and writers of the binary and text formats in which descriptors, indexes and models come.

Files are read through Spark (``binaryFile``), one row a file, and parsed by numpy in Arrow batches. A
file is parsed whole by one task; collections are split over many files. Writers make a file's bytes
from rows; ``write_files`` groups rows by path for them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURES, SIFT_DIM, SIFT_SCALE = 5000, 128, 512.0
SIFTGEO = np.dtype([("geom", "<f4", 9), ("dim", "<i4"), ("desc", "u1", SIFT_DIM)])
FEATURES = "path string, feat_id int, geom array<float>, desc array<float>"
VECTORS = "path string, pos int, v array<double>"


def read_files(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``parse`` makes of each file, behind its path. ``schema`` begins with the path column."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_parser(parse, spark.createDataFrame([], schema).schema), schema)


def _parser(parse, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(path, *r) for r in parse(content)]
                cols = list(zip(*rows)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return run


# --- local descriptors


def parse_siftb(data: bytes, most: int = MOST_FEATURES, frame: int = 4, dim: int = SIFT_DIM, scale: float = SIFT_SCALE) -> list[tuple]:
    """(feat_id, geometry, descriptor): the first ``most`` features, scaled down, those with a NaN left out."""
    n = min(struct.unpack_from("<i", data)[0], most)
    x = np.frombuffer(data, "<f4", n * (frame + dim), 4).reshape(n, frame + dim)
    desc = x[:, frame:] / np.float32(scale)
    keep = ~np.isnan((desc * desc).sum(1))
    return [(int(k), x[k, :frame].tolist(), desc[k].tolist()) for k in np.flatnonzero(keep)]


def dump_siftb(rows: list[tuple[list[float], list[float]]], scale: float = SIFT_SCALE) -> bytes:
    return struct.pack("<i", len(rows)) + b"".join(np.array([*g, *(np.array(d) * scale)], "<f4").tobytes() for g, d in rows)


def parse_siftgeo(data: bytes, most: int = MOST_FEATURES) -> list[tuple]:
    """(feat_id, geometry of 9, descriptor) of 168-byte records; ValueError if a record states another length."""
    x = np.frombuffer(data, SIFTGEO, min(len(data) // SIFTGEO.itemsize, most))
    if len(x) and (x["dim"] != SIFT_DIM).any():
        raise ValueError("unexpected descriptor length")
    return [(k, r["geom"].tolist(), r["desc"].astype(float).tolist()) for k, r in enumerate(x)]


def read_siftb(spark: SparkSession, paths, most: int = MOST_FEATURES) -> DataFrame:
    return read_files(spark, paths, lambda d: parse_siftb(d, most), FEATURES)


def read_siftgeo(spark: SparkSession, paths, most: int = MOST_FEATURES) -> DataFrame:
    return read_files(spark, paths, lambda d: parse_siftgeo(d, most), FEATURES)


# --- indexes of global descriptors


def parse_index(data: bytes, words: int, dim: int = 32, binary: bool = True) -> list[tuple]:
    """(ordinal, l1, soft, packed words, vector) of an index; one of the last two is None. The file doesn't state words."""
    body = np.dtype([("l1", "<f4", words), ("soft", "<f4", words), ("x", "<u4", words) if binary else ("x", "<f4", words * dim)])
    rows = np.frombuffer(data, body, struct.unpack_from("<i", data)[0], 4)
    return [(k, r["l1"].tolist(), r["soft"].tolist(), r["x"].tolist() if binary else None, None if binary else r["x"].tolist()) for k, r in enumerate(rows)]


def dump_index(rows: list[tuple], binary: bool = True) -> bytes:
    """rows: (l1, soft, packed words or vector)."""
    out = [struct.pack("<i", len(rows))]
    for l1, soft, x in rows:
        out += [np.array(l1, "<f4").tobytes(), np.array(soft, "<f4").tobytes(), np.array(x, "<u4" if binary else "<f4").tobytes()]
    return b"".join(out)


def read_index(spark: SparkSession, paths, words: int, dim: int = 32, binary: bool = True) -> DataFrame:
    return read_files(spark, paths, lambda d: parse_index(d, words, dim, binary), "path string, ordinal int, l1 array<float>, soft array<float>, words array<bigint>, fv array<float>")


def parse_points(data: bytes, binary: bool, most: int | None = None) -> list[tuple]:
    """(item, feat_id, word, weight, residual, bits) of a point index; the first ``most`` features of each item."""
    (n, size), at = (struct.unpack_from("<ii", data) if not binary else (struct.unpack_from("<i", data)[0], 1)), 4 if binary else 8
    out = []
    for item in range(n):
        k = struct.unpack_from("<i", data, at)[0]
        word, weight = np.frombuffer(data, "<u4", k, at + 4), np.frombuffer(data, "<f4", k, at + 4 + 4 * k)
        at += 4 + 8 * k
        x = np.frombuffer(data, "<u4" if binary else "<f4", k * size, at).reshape(k, size)
        at += 4 * k * size
        for f in range(k if most is None else min(k, most)):
            out.append((item, f, int(word[f]), float(weight[f]), None if binary else x[f].tolist(), int(x[f, 0]) if binary else None))
    return out


def dump_points(items: list[list[tuple]], binary: bool) -> bytes:
    """items: for each the features (word, weight, residual or bits)."""
    size = len(next((f[2] for i in items for f in i), [])) if not binary else 0
    out = [struct.pack("<i", len(items)) if binary else struct.pack("<ii", len(items), size)]
    for features in items:
        word, weight, x = zip(*features) if features else ((), (), ())
        out += [struct.pack("<i", len(features)), np.array(word, "<u4").tobytes(), np.array(weight, "<f4").tobytes(), np.array(x, "<u4" if binary else "<f4").tobytes()]
    return b"".join(out)


def read_points(spark: SparkSession, paths, binary: bool, most: int | None = None) -> DataFrame:
    return read_files(spark, paths, lambda d: parse_points(d, binary, most), "path string, item int, feat_id int, word int, weight float, residual array<float>, bits bigint")


# --- models


def parse_gmm(data: bytes) -> list[tuple]:
    """(k, w, mu, sigma) of a mixture file: dimension, components, weights, means, variances."""
    d, k = struct.unpack_from("<ii", data)
    w, mu, sigma = (np.frombuffer(data, "<f4", n, at).astype(float) for n, at in ((k, 8), (k * d, 8 + 4 * k), (k * d, 8 + 4 * k * (d + 1))))
    return [(j, float(w[j]), mu[j * d : j * d + d].tolist(), sigma[j * d : j * d + d].tolist()) for j in range(k)]


def dump_gmm(rows: list[tuple]) -> bytes:
    """rows: (k, w, mu, sigma) by k."""
    d = len(rows[0][2]) if rows else 0
    flat = lambda xs: np.array(xs, "<f4").tobytes()
    return struct.pack("<ii", d, len(rows)) + flat([r[1] for r in rows]) + flat([r[2] for r in rows]) + flat([r[3] for r in rows])


def read_gmm(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_gmm, "path string, k int, w double, mu array<double>, sigma array<double>").drop("path")


def parse_floats(data: bytes, width: int | None = None, rows: int | None = None) -> list[tuple]:
    """(pos, v) of raw floats: rows of ``width`` (default: one row), the first ``rows`` of them."""
    x = np.frombuffer(data, "<f4").astype(float)
    x = x.reshape(-1, width or len(x))[:rows]
    return [(k, r.tolist()) for k, r in enumerate(x)]


def read_floats(spark: SparkSession, path: str, width: int | None = None, rows: int | None = None) -> DataFrame:
    """Means, eigenvectors and correlation weights are such files."""
    return read_files(spark, path, lambda d: parse_floats(d, width, rows), VECTORS)


# --- vectors that each state their length

_VECS = {"f": "<f4", "i": "<i4", "b": "u1", "l": "<i8"}


def parse_vecs(data: bytes, kind: str, most: int | None = None, first: int = 0) -> list[tuple]:
    """(pos, v) of fvecs, ivecs, bvecs or lvecs (kind: f, i, b, l), from vector ``first``, at most ``most``."""
    if not data:
        return []
    dtype = np.dtype(_VECS[kind])
    d = struct.unpack_from("<i", data)[0]
    size = 4 + d * dtype.itemsize
    if len(data) % size:
        raise ValueError("vectors of different lengths, or a file cut short")
    x = np.frombuffer(data, np.dtype([("d", "<i4"), ("v", dtype, (d,))]))
    if (x["d"] != d).any():
        raise ValueError("vectors of different lengths")
    x = x[first:] if most is None else x[first : first + most]
    return [(first + k, r["v"].astype(float).tolist()) for k, r in enumerate(x)]


def dump_vecs(vectors: list[list[float]], kind: str) -> bytes:
    return b"".join(struct.pack("<i", len(v)) + np.array(v, _VECS[kind]).tobytes() for v in vectors)


def parse_sparse(data: bytes) -> list[tuple]:
    """(pos, indexes, values) of sparse vectors: count, indexes, count, values."""
    at, out = 0, []
    while at < len(data):
        n = struct.unpack_from("<i", data, at)[0]
        idx = np.frombuffer(data, "<i4", n, at + 4)
        if struct.unpack_from("<i", data, at + 4 + 4 * n)[0] != n:
            raise ValueError("counts differ")
        val = np.frombuffer(data, "<f4", n, at + 8 + 4 * n)
        out.append((len(out), idx.tolist(), val.astype(float).tolist()))
        at += 8 + 8 * n
    return out


def read_vecs(spark: SparkSession, paths, kind: str = "f", most: int | None = None, first: int = 0) -> DataFrame:
    return read_files(spark, paths, lambda d: parse_vecs(d, kind, most, first), VECTORS)


def read_sparse(spark: SparkSession, paths) -> DataFrame:
    return read_files(spark, paths, parse_sparse, "path string, pos int, i array<int>, v array<double>")


def parse_pgm(data: bytes) -> list[tuple]:
    """(row, pixels) of a binary or plain PGM image."""
    import re

    head = re.match(rb"(P[25])\s(?:\s*#[^\n]*\n)*\s*(\d+)\s(?:\s*#[^\n]*\n)*\s*(\d+)\s(?:\s*#[^\n]*\n)*\s*(\d+)\s", data)
    if not head:
        raise ValueError("no PGM image")
    kind, w, h, most = head[1], *(int(head[k]) for k in (2, 3, 4))
    body = data[head.end() :]
    x = np.array(body.split()[: w * h], np.int64) if kind == b"P2" else np.frombuffer(body, "u1" if most < 256 else ">u2", w * h)
    return [(k, r.astype(int).tolist()) for k, r in enumerate(x.reshape(h, w))]


def dump_pgm(rows: list[list[int]]) -> bytes:
    x = np.array(rows)
    big = x.max(initial=0) > 255
    return f"P5\n{x.shape[1]} {x.shape[0]}\n{65535 if big else 255}\n".encode() + x.astype(">u2" if big else "u1").tobytes()


def write_files(rows: DataFrame, path_col: str, dump: Callable[[list[dict]], bytes], order: str) -> DataFrame:
    """(path, content): rows of each path, in the order of ``order``, as a file's bytes. Each path is one task's group."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r[order])
        return pa.table({"path": [own[0][path_col]], "content": pa.array([dump(own)], pa.binary())})

    return rows.groupBy(path_col).applyInArrow(run, "path string, content binary")


# --- text


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, value: one line each, whole, in file order; a list is one small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "value"))
    return lines.select("pos", F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, shot_id: a line's numbers are the shots of the scene with the line's number."""
    return read_list(spark, path).select(F.col("pos").alias("scene_id"), F.explode(F.split(F.trim("value"), r"\s+")).alias("s")).filter("s <> ''").select("scene_id", F.col("s").cast("int").alias("shot_id"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, clip, start, stop in seconds: a line has the query and triples."""
    from ocellus.functions.vec import seconds

    t = read_list(spark, path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter("t[0] <> ''")
    n = F.floor((F.size("t") - 1) / 3).cast("int")
    each = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get("t", 1 + 3 * i).alias("clip"), F.get("t", 2 + 3 * i).alias("a"), F.get("t", 3 + 3 * i).alias("z"))), lambda s: s["clip"].isNotNull())
    return t.select(F.col("t")[0].cast("int").alias("query_id"), F.explode(each).alias("s")).select("query_id", F.col("s.clip").alias("clip"), seconds(F.col("s.a")).alias("start"), seconds(F.col("s.z")).alias("stop"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank (from 1), path: a line ``Query <n>`` heads the results below it."""
    from pyspark.sql import Window

    lines = read_list(spark, path).filter("value <> ''")
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("value", r"^Query\s+(\d+)", 1)
    marked = lines.withColumn("query_id", F.last(F.when(head != "", head.cast("int")), ignorenulls=True).over(w)).filter(head == "")
    return marked.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"), F.col("value").alias("path"))


def format_results(results: DataFrame, path: str = "path") -> DataFrame:
    """value, one row a query: its head line and its paths by rank, ready for ``write.text``."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", path))), lambda s: s[path])
    return results.groupBy("query_id").agg(F.concat(F.lit("Query "), F.col("query_id"), F.lit("\n"), F.array_join(lines, "\n")).alias("value")).orderBy("query_id").select("value")
