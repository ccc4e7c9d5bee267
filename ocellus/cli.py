"""spark-submit ocellus/cli.py COMMAND ...: the engine's stages from files to files.

Tables are parquet folders. Each command reads its inputs, appends or writes one output, and prints nothing else than
counts, so stages can be chained as the scripts of a retrieval pipeline are.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import paths, vec
from ocellus.operators import bloom, evaluate, gmm, index, scoring, shots
from ocellus.sources import binary


def _descriptors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, feat_id, d of local descriptor files or a table with these columns."""
    if kind == "table":
        return spark.read.parquet(path)
    read = binary.read_siftb if kind == "siftb" else binary.read_siftgeo
    return read(spark, path).select("path", "feat_id", vec.doubles(F.col("desc")).alias("d"))


def index_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Global descriptors of frames, or of shots if a table (path, shot) is given."""
    model = binary.read_gmm(spark, a.gmm) if a.gmm_format == "binary" else spark.read.parquet(a.gmm)
    desc = _descriptors(spark, a.descriptors, a.format).withColumn("vec_id", F.xxhash64("path", "feat_id"))
    if a.shots:
        desc = desc.join(spark.read.parquet(a.shots).select("path", "shot"), "path")
    out = gmm.global_descriptor(desc, model, "shot" if a.shots else "path", intra=a.intra_normalization, power=a.power)
    index.save(out, a.output)


def binarize(spark: SparkSession, a: argparse.Namespace) -> None:
    """An index with its words' signs packed beside or, with --drop, instead of the values."""
    index = spark.read.parquet(a.index).withColumn("bits", vec.pack_signs(F.col("fv")))
    (index.drop("fv") if a.drop else index).write.mode("overwrite").parquet(a.output)


def point_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each local descriptor's word, weight, residual and bits."""
    model = binary.read_gmm(spark, a.gmm) if a.gmm_format == "binary" else spark.read.parquet(a.gmm)
    desc = _descriptors(spark, a.descriptors, a.format).withColumn("vec_id", F.xxhash64("path", "feat_id"))
    points = gmm.point_index(gmm.posterior(desc, model), model)
    points.join(desc.select("vec_id", "path", "feat_id"), "vec_id").write.mode("overwrite").parquet(a.output)


def join_indexes(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [spark.read.parquet(p) for p in a.inputs]
    index.concatenated(parts, a.item).write.mode("overwrite").parquet(a.output)


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ranked items of each query; a second stage over groups if they are given."""
    p = scoring.QueryParams(mode=a.mode, threshold=a.threshold, power=a.power, min_words=a.min_words, word_dim=a.word_dim, words=a.words, top_k=a.output_results)
    q, d = spark.read.parquet(a.queries), spark.read.parquet(a.database)
    first = scoring.search(q, d, p)
    if a.groups:
        short = scoring.search(q, d, scoring.QueryParams(**{**p.__dict__, "top_k": a.rerank}))
        members = binary.read_groups(spark, a.groups).select(F.col("scene_id").alias("group_id"), F.col("shot_id").alias("member_id"))
        first = scoring.rescore(short, members, *scoring.prepared(q, spark.read.parquet(a.second), p), a.rerank, a.output_results)
    first.write.mode("overwrite").parquet(a.output)


def retrieve_bloom(spark: SparkSession, a: argparse.Namespace) -> None:
    """Clips by Bloom score; both tables have word and bits, points also clip, queries query_id."""
    positions = [int(x) for x in a.positions.split(",")]
    hashed = lambda df: df.withColumn("hasher", F.col("word")).withColumn("bucket", vec.bit_sample(F.col("bits"), positions))
    found = bloom.BloomIndex.fit(hashed(spark.read.parquet(a.points)), a.alpha, a.exact_idf).query(hashed(spark.read.parquet(a.queries)))
    scoring.ranked(found, a.output_results, item="clip").write.mode("overwrite").parquet(a.output)


def detect_shots(spark: SparkSession, a: argparse.Namespace) -> None:
    shots.boundaries(spark.read.parquet(a.frames), a.threshold).write.mode("overwrite").parquet(a.output)


def evaluate_results(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints mean average precision and mean precision at 1 of a results file against a ground truth file."""
    found = binary.read_results(spark, a.results).select("query_id", "rank", paths.keyframe_clip(F.col("path")).alias("clip") if a.keyframes else F.col("path").alias("clip"))
    r = evaluate.average_precision(found, binary.read_ground_truth(spark, a.ground_truth), a.shortlist, a.substring).agg(F.avg("ap"), F.avg("p1")).head()
    print(f"mAP {r[0]:.6f}\nmP@1 {r[1]:.6f}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(f, *args):
        c = sub.add_parser(f.__name__.replace("_", "-"), description=f.__doc__)
        for names, options in args:
            c.add_argument(*names, **options)
        c.set_defaults(run=f)

    need = lambda n: ((n,), {"required": True})
    command(index_dataset, need("--descriptors"), need("--gmm"), need("--output"), (("--shots",), {}), (("--format",), {"choices": ["table", "siftb", "siftgeo"], "default": "table"}), (("--gmm-format",), {"choices": ["table", "binary"], "default": "table"}), (("--intra-normalization",), {"action": "store_true"}), (("--power",), {"type": float, "default": 0.5}))
    command(binarize, need("--index"), need("--output"), (("--drop",), {"action": "store_true"}))
    command(point_index, need("--descriptors"), need("--gmm"), need("--output"), (("--format",), {"choices": ["table", "siftb", "siftgeo"], "default": "table"}), (("--gmm-format",), {"choices": ["table", "binary"], "default": "table"}))
    command(join_indexes, (("inputs",), {"nargs": "+"}), need("--output"), (("--item",), {"default": "item_id"}))
    command(retrieve, need("--queries"), need("--database"), need("--output"), (("--mode",), {"choices": ["off", "qags", "dags", "sgs"], "default": "qags"}), (("--threshold",), {"type": float, "default": 0.0}), (("--power",), {"type": float, "default": 0.5}), (("--min-words",), {"type": int, "default": 0}), (("--word-dim",), {"type": int, "default": 32}), (("--words",), {"type": int, "default": 512}), (("--output-results",), {"type": int, "default": 100}), (("--groups",), {}), (("--second",), {}), (("--rerank",), {"type": int, "default": 100}))
    command(retrieve_bloom, need("--points"), need("--queries"), need("--output"), need("--positions"), (("--alpha",), {"type": float, "default": 0.5}), (("--exact-idf",), {"action": "store_true"}), (("--output-results",), {"type": int, "default": 100}))
    command(detect_shots, need("--frames"), need("--output"), (("--threshold",), {"type": float, "default": 0.7}))
    command(evaluate_results, need("--results"), need("--ground-truth"), (("--shortlist",), {"type": int}), (("--substring",), {"action": "store_true"}), (("--keyframes",), {"action": "store_true"}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("ocellus").getOrCreate(), args)


if __name__ == "__main__":
    main()
