"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm import langid, mixing, neardup, packing, substring
from ocellus.llm.common import broadcast_if_small, read_table, stored
from ocellus.llm.tokens import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.5


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ``gone``; by broadcast if gone is small, else both sides are dealt by id."""
    gone = stored(gone.select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if no language is found in them (``und``: null, or no letter) or none has half of their words.

    The model learns from the labelled documents; lang keeps its value, and where it is null gets the prediction.
    """
    model = langid.fit(docs)
    found = langid.predict(docs, model)
    rejected = found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE))
    kept = without(docs, rejected)
    if docs.filter("lang IS NULL").limit(1).count():
        filled = docs.filter("lang IS NULL").select("doc_id", "text")
        labels = langid.predict(filled, model).groupBy("doc_id").agg(F.min("lang_pred").alias("_lang"))
        kept = kept.join(labels, "doc_id", "left").withColumn("lang", F.coalesce("lang", "_lang"))
    return kept.select(COLUMNS)


def own_ids(docs: DataFrame) -> DataFrame:
    """COLUMNS and own: an id for each pair of doc_id and text; null where doc_id is.

    Of rows with one doc_id and one text one stays, that with the least other columns. Of several texts
    of one doc_id one takes it as its own; others get a hash of both above 2**62. Rows without doc_id all stay.
    """
    of = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("text")).alias("first"))
    repeated = stored(of.filter("rows > 1").select("doc_id", "first"), "repeated")
    if not repeated.limit(1).count():
        return docs.select(*COLUMNS, F.col("doc_id").alias("own"))
    repeated = broadcast_if_small(repeated)
    once = docs.join(repeated, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").alias("own"))
    rest = docs.join(repeated, "doc_id").groupBy("doc_id", "text", "first").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    further = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.when(F.xxhash64("text") == F.col("first"), F.col("doc_id")).otherwise(further)
    return once.union(rest.select("doc_id", "text", "row.lang", "row.source", "row.n_chars", own.alias("own")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingle sets with a similarity of 0.8, the smallest id stays.

    Different texts with one doc_id are documents of their own, and stay or go each for itself (see ``own_ids``).
    """
    docs = own_ids(docs)
    found = neardup.near_duplicates(docs.select(F.col("own").alias("doc_id"), "text"), width=5, percent=80)
    gone = stored(found.filter("NOT kept").select("doc_id").distinct(), "gone").withColumnRenamed("doc_id", "own")
    return docs.join(broadcast_if_small(gone), "own", "left_anti").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeated 35-word windows cover; documents that lose all words go, others keep their text."""
    found = substring.remove_repeats(docs, keep=["doc_id", "lang", "source", "n_chars"], whole=True)
    text = F.col("kept_text")
    return found.filter("n_words > n_removed").select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that words by source, language and topic meet tempered shares."""
    return mixing.mix(docs.select(COLUMNS)).filter("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048."""
    return packing.place(stored(packing.cut_pieces(docs, default_path(), 0), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language ID and packing have no SQL form; tests hold the rows of the other stages, and the packed pieces, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
