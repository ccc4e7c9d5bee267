import struct

import numpy as np
import pandas as pd

from ocellus.sources import binary as b


def write(path, data):
    path.write_bytes(data) if isinstance(data, bytes) else path.write_text(data)
    return str(path)


def test_siftb_caps_before_dropping_nan(spark, tmp_path):
    rows = [([1.0, 2, 3, 4], [float(k)] * 128) for k in range(4)]
    rows[1] = (rows[1][0], [float("nan")] * 128)
    p = write(tmp_path / "a.siftb", b.dump_siftb(rows))
    got = b.read_siftb(spark, p, most=3).orderBy("feat_id").collect()
    assert [(r.feat_id, r.geom, r.desc[0]) for r in got] == [(0, [1, 2, 3, 4], 0.0), (2, [1, 2, 3, 4], 2.0)]


def test_siftgeo(spark, tmp_path):
    rec = np.zeros(2, b.SIFTGEO)
    rec["dim"], rec["desc"][1] = 128, 7
    got = b.read_siftgeo(spark, write(tmp_path / "a.siftgeo", rec.tobytes())).orderBy("feat_id").collect()
    assert [len(r.geom) for r in got] == [9, 9] and got[1].desc == [7.0] * 128


def test_index_both_kinds(spark, tmp_path):
    p = write(tmp_path / "b", b.dump_index([([1, 2], [3, 4], [2**32 - 1, 5])]))
    r = b.read_index(spark, p, 2).head()
    assert (r.l1, r.soft, r.words, r.fv) == ([1, 2], [3, 4], [2**32 - 1, 5], None)
    p = write(tmp_path / "f", b.dump_index([([1], [2], [0.5, 0.25])], binary=False))
    assert b.read_index(spark, p, 1, 2, binary=False).head().fv == [0.5, 0.25]


def test_points_with_cap(spark, tmp_path):
    p = write(tmp_path / "f", b.dump_points([[(1, 0.5, [1.0, 2.0]), (2, 0.25, [3.0, 4.0])], []], False))
    assert [tuple(r)[1:5] for r in b.read_points(spark, p, False, most=1).collect()] == [(0, 0, 1, 0.5)]
    p = write(tmp_path / "b", b.dump_points([[(1, 0.5, 9)], [(3, 1.0, 2**31)]], True))
    assert [(r.item, r.word, r.bits) for r in b.read_points(spark, p, True).orderBy("item").collect()] == [(0, 1, 9), (1, 3, 2**31)]


def test_gmm_floats_vecs_sparse_pgm(spark, tmp_path):
    g = [(0, 0.25, [1.0, 2.0], [3.0, 4.0]), (1, 0.75, [5.0, 6.0], [7.0, 8.0])]
    assert [tuple(r) for r in b.read_gmm(spark, write(tmp_path / "g", b.dump_gmm(g))).orderBy("k").collect()] == [(k, w, m, s) for k, w, m, s in g]
    assert b.read_floats(spark, write(tmp_path / "x", np.arange(6, dtype="<f4").tobytes()), 2, 2).count() == 2
    for kind in "fibl":
        p = write(tmp_path / kind, b.dump_vecs([[1, 2], [3, 4], [5, 6]], kind))
        assert [r.v for r in b.read_vecs(spark, p, kind, most=1, first=1).collect()] == [[3.0, 4.0]]
    sparse = struct.pack("<iiiiff", 2, 0, 3, 2, 1.5, 2.5)
    assert tuple(b.read_sparse(spark, write(tmp_path / "s", sparse)).head())[1:] == (0, [0, 3], [1.5, 2.5])
    rows = [[0, 128], [255, 3]]
    assert [r for _, r in b.parse_pgm(b.dump_pgm(rows))] == rows and [r for _, r in b.parse_pgm(b"P2\n# c\n2 1\n255\n7 8\n")] == [[7, 8]]


def test_write_files(spark):
    df = spark.createDataFrame([("a", 1, [3.0]), ("a", 0, [2.0]), ("b", 0, [1.0])], "path string, pos int, v array<double>")
    out = {r.path: bytes(r.content) for r in b.write_files(df, "path", lambda rows: b.dump_vecs([r["v"] for r in rows], "f"), "pos").collect()}
    assert [v for _, v in b.parse_vecs(out["a"], "f")] == [[2.0], [3.0]] and len(out) == 2


def test_text_formats(spark, tmp_path):
    p = write(tmp_path / "gt", "0 a.mp4 0:10 0:20 b.mp4 1:00 1:05\n1 c.mp4 0:0 1:0:0\n")
    assert [tuple(r) for r in b.read_ground_truth(spark, p).orderBy("query_id", "clip").collect()] == [(0, "a.mp4", 10, 20), (0, "b.mp4", 60, 65), (1, "c.mp4", 0, 3600)]
    p = write(tmp_path / "groups", "0 1 2\n3\n\n4 5\n")
    assert [tuple(r) for r in b.read_groups(spark, p).orderBy("shot_id").collect()] == [(0, 0), (0, 1), (0, 2), (1, 3), (3, 4), (3, 5)]
    p = write(tmp_path / "res", "Query 0\nx/a 1.jpg\nx/b.jpg\nQuery 1\ny.jpg\n")
    res = b.read_results(spark, p)
    assert [tuple(r) for r in res.orderBy("query_id", "rank").collect()] == [(0, 1, "x/a 1.jpg"), (0, 2, "x/b.jpg"), (1, 1, "y.jpg")]
    assert "\n".join(r.value for r in b.format_results(res).collect()) + "\n" == (tmp_path / "res").read_text()
    assert [r.value for r in b.read_list(spark, p).orderBy("pos").collect()][1] == "x/a 1.jpg"


def test_stream_equals_batch(spark, tmp_path):
    from ocellus.operators.shots import boundaries
    from ocellus.streaming.shots import stream_boundaries

    rng = np.random.default_rng(0)
    h = rng.dirichlet([0.3] * 3, 40)
    rows = pd.DataFrame({"clip": [i % 2 for i in range(40)], "frame": [i // 2 for i in range(40)], "hist": h.tolist(), "ts": pd.to_datetime([1_700_000_000 + i // 2 for i in range(40)], unit="s")})
    df = spark.createDataFrame(rows, "clip long, frame long, hist array<double>, ts timestamp")
    for k in range(2):
        df.filter(f"frame >= {10 * k} AND frame < {10 * k + 10}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_boundaries(stream, 0.8).writeStream.format("memory").queryName("bounds").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.clip, r.frame) for r in spark.sql("SELECT * FROM bounds").collect()}
    assert got == {(r.clip, r.frame) for r in boundaries(df, 0.8).collect()}
