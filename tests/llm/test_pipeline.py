import brute
import numpy as np
import corpus_pipeline as cp
from oracle import DATA
from pyspark.sql import functions as F

from ocellus.llm import mixing, tokens
from ocellus.llm.common import read_table, stored


def test_stages_against_brute_force(spark):
    docs = read_table(spark, DATA, "documents")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, DATA), name)
        assert docs.columns == cp.COLUMNS and docs.count() > 0
        rows = texts(before)
        if name == "language_id":
            assert texts(docs) == rows
        elif name == "near_dedup":
            near = brute.near(rows, 5, 80)
            assert [k for k, _ in texts(docs)] == [k for k, _ in rows if near[k][1] == k]
        elif name == "substring_dedup":
            want = brute.repeats(rows, 35)
            assert {k: brute.words(t) for k, t in texts(docs)} == {k: w for k, (_, w) in want.items() if w}
        else:
            want = brute.mixed([(r.doc_id, r.text, r.lang, r.source) for r in before.collect()], mixing)
            assert [k for k, _ in texts(docs)] == sorted(k for k, v in want.items() if v[-1])
    tk = tokens.tokenizer(tokens.default_path()).tokenizer
    want = []
    for r in docs.collect():
        ids = [*tk.encode(r.text, add_special_tokens=False).ids, 0]
        want += [(r.doc_id, n, at, len(ids[at : at + 2048]), brute.zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    packed = cp.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    fill = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 3


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, "12 34", "en", None, 5), (4, long, "en", "a", 9), (4, long, "en", "a", 9), (5, long + " x", None, "b", None), (6, "some words here", None, None, 3), (None, "another text", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = cp.language_id(spark, docs, DATA)
    assert sorted(str(r.doc_id) for r in a.collect()) == ["4", "4", "5", "6", "None"] and a.filter("lang IS NULL").count() == 0
    b = cp.near_dedup(spark, a, DATA)
    assert sorted(str(r.doc_id) for r in b.collect()) == ["4", "6", "None"]
    for name, stage in cp.STAGES:
        assert stage(spark, docs, DATA).count() >= 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_near_dedup_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (1, text("d")), (1, text("d")), (2, text("e")), (2, text("f")), (2, text("g") + " x"), (3, text("g"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, DATA).collect()]
    assert sorted(t for i, t in got if i is None) == [text("a"), text("b"), text("c")]
    assert got.count((1, text("d"))) == 1 and (2, text("e")) in got and (2, text("f")) in got
    assert ((2, text("g") + " x") in got) + ((3, text("g")) in got) == 1 and len(got) == 7
