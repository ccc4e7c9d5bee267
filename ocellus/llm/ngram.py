"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates, weights by EM on held-out counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import blocks, id_crc, read_table, small_batches, stored, text_buffer
from ocellus.llm.hashing import PRIME, Hasher, fresh, reduced, times, word_bounds
from ocellus.llm.keyexchange import SENT, answers, bucket_count, chunk_count, merged, narrow, ranges, send, widen

_U = np.uint64
END = _U(PRIME)  # words are below it
BIGRAM, WORD, BEGIN = 0, 1, 2  # low bits of keys; the begin of a text only is a context
_BEGIN = _U(PRIME << 3 | BEGIN)
RETAINED, HELD, UNSEEN = 0, 1, 2  # roles of documents: estimates, weights, neither
LEVELS, OCTAVE, GRID = 25, 8, 512
CHUNK_ROWS = 1250  # two keys a word, each with two counts, are held for a chunk


@dataclass
class Interpolation:
    """n_tokens, vocabulary: of all training tokens. weights: per context-frequency bucket, of bigram, unigram and uniform."""

    n_tokens: int
    vocabulary: int
    weights: np.ndarray


def tokens(texts: pa.ChunkedArray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens before each text): the words, A-Z lowered, then one end each."""
    buf, offsets = text_buffer(texts)
    parts, before, done = [], [np.zeros(1, np.int64)], 0
    for i, j in blocks(offsets):
        part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, counts = word_bounds(part, offs)
        parts.append(np.insert(hasher.words(part, starts, ends, fold=True), counts[1:], END))
        before.append(counts[1:] + np.arange(1, j - i + 1) + done)
        done = int(before[-1][-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(before)


def keys_of(words: np.ndarray, before: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of words and bigrams, each token's word and bigram among them; the last is that of the begin.

    A bigram's hash is context * base + word modulo the prime.
    """
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[before[:-1]] = END
    bigram = times(context, hasher.word)
    bigram += words
    n = len(words)
    keys, inverse = np.unique(np.concatenate([words << _U(3) | _U(WORD), reduced(bigram) << _U(3) | _U(BIGRAM), [_BEGIN]]), return_inverse=True)
    return keys, inverse[:n], inverse[n : 2 * n]


def contexts(unigram: np.ndarray, before: np.ndarray, begin: int) -> np.ndarray:
    """Each token's context among the keys."""
    out = np.empty_like(unigram)
    out[1:] = unigram[:-1]
    out[before[:-1]] = begin
    return out


def level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: 0 for none, else 1 + floor(log2)."""
    return np.minimum(LEVELS - 1, np.frexp(counts.astype(np.float64))[1])


def estimate(n: np.ndarray, p2: np.ndarray, p1: np.ndarray, level_: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """EM for the weights of each bucket from ``n`` held-out events with those probabilities."""
    weights = np.full((LEVELS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    p = np.stack([p2, p1, np.full(len(p1), p0)], 1)
    prior = np.full((LEVELS, 3), 1e-3)
    prior[0, 0] = 0
    for _ in range(rounds):
        share = weights[level_] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        total = prior + np.stack([np.bincount(level_, x, LEVELS) for x in share.T], 1)
        weights = total / total.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, role, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``role``: 0 for documents that give the counts, 1 for those that are held out to learn the weights
    and then give counts too, 2 for those that teach nothing. A null text has only the end token.
    Unigram and bigram counts cover all training documents, without a frequency cut. The weights come
    from held-out tokens under the counts of role 0: events of one context bucket whose probabilities lie
    in one eighth of an octave each are summed in Spark with their number and both means, so EM runs
    over a table of bounded size and sees the exact probabilities to second order in that eighth.
    Counts have 64 bits. Words and bigrams are told apart by one hash modulo 2**61 - 1 under this run's
    seed: among n different ones about n * n / 2**62 pairs share their count.
    With no training document every estimate but the uniform one is 0; the base score is
    log10(1 / (V + 1)) a token, with V = 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), role.cast("int").alias("role"))
    small_batches(docs)
    chunks = chunk_count(docs, CHUNK_ROWS)
    buckets = bucket_count(docs, chunks)
    held_chunks = max(1, chunks // 7)
    hasher = fresh()
    h = F.xxhash64("doc_id", "text")
    texts = rows.select(F.when(F.col("role") == HELD, F.pmod(h, F.lit(held_chunks))).otherwise(held_chunks + F.pmod(h, F.lit(chunks))).cast("int").alias("chunk"), "doc_id", "text", "role")

    def emit(table: pa.Table) -> pa.Table:
        words, before = tokens(table["text"], hasher)
        keys, unigram, bigram = keys_of(words, before, hasher)
        roles = np.repeat(table["role"].to_numpy(), np.diff(before))
        kinds = table["role"].to_numpy()
        counts = np.zeros((2, len(keys)), np.uint32)  # a chunk's: at most its number of tokens
        for r in (RETAINED, HELD):
            own = roles == r
            counts[r] = np.bincount(unigram[own], minlength=len(keys))
            counts[r] += np.bincount(bigram[own], minlength=len(keys)).astype(np.uint32)
            counts[r][-1] = (kinds == r).sum()
        return send(table["chunk"][0].as_py(), keys, buckets, lambda a, z: narrow(counts[:, a:z].reshape(-1)))

    def add(table: pa.Table) -> pa.Table:
        keys, inverse, cuts, sent_by, extras = merged(table)
        total = np.zeros((2, len(keys)), np.uint64)
        for x, a, z in zip(extras, cuts[:-1], cuts[1:]):
            total[:, inverse[a:z]] += widen(x).reshape(2, -1)  # a chunk's keys are distinct
        words = total[:, (keys & _U(7)) == WORD]
        sums = [int(words[0].sum()), int((words[0] > 0).sum()), int(words.sum()), int((words.sum(0) > 0).sum())]
        n = len(sent_by)
        return pa.table([table["chunk"], table["bucket"], pa.array([narrow(total[:, inverse[a:z]].reshape(-1)) for a, z in zip(cuts[:-1], cuts[1:])], pa.binary()), *(pa.array([s] + [0] * (n - 1), pa.int64()) for s in sums)], ["chunk", "bucket", "answer", "n_ret", "v_ret", "n_all", "v_all"])

    counted = stored(texts.groupBy("chunk").applyInArrow(emit, SENT).groupBy("bucket").applyInArrow(add, "chunk int, bucket int, answer binary, n_ret long, v_ret long, n_all long, v_all long"), "ngram-counts")
    n_ret, v_ret, n_all, v_all = (int(x or 0) for x in counted.agg(*(F.sum(c) for c in ("n_ret", "v_ret", "n_all", "v_all"))).head())

    def looked_up(table: pa.Table, told: pa.Table):
        words, before = tokens(table["text"], hasher)
        keys, unigram, bigram = keys_of(words, before, hasher)
        counts, cuts = np.zeros((2, len(keys)), np.int64), ranges(keys, buckets)
        for b, x in answers(told):
            counts[:, cuts[b] : cuts[b + 1]] = widen(x).reshape(2, -1)
        return before, unigram, bigram, contexts(unigram, before, len(keys) - 1), counts

    def observe(table: pa.Table, told: pa.Table) -> pa.Table:
        _, unigram, bigram, context, counts = looked_up(table, told)
        c = counts[RETAINED]
        # Bins: 0 for probability 0, else 1 + the eighth of an octave below 1.
        p2 = np.divide(c[bigram], c[context], out=np.zeros(len(bigram)), where=c[context] > 0)
        p1 = c[unigram] / max(1, n_ret)
        b2, b1 = (np.where(p > 0, 1 + np.minimum(GRID - 2, np.rint(-OCTAVE * np.log2(np.where(p > 0, p, 1)))), 0).astype(np.int64) for p in (p2, p1))
        cell, at = np.unique((level(c[context]) * GRID + b2) * GRID + b1, return_inverse=True)
        return pa.table([pa.array(cell), pa.array(np.bincount(at)), pa.array(np.bincount(at, p2)), pa.array(np.bincount(at, p1))], ["cell", "n", "p2", "p1"])

    answers_ = counted.select("chunk", "bucket", "answer")
    seen = texts.filter(F.col("role") == HELD).groupBy("chunk").cogroup(answers_.filter(F.col("chunk") < held_chunks).groupBy("chunk")).applyInArrow(observe, "cell long, n long, p2 double, p1 double")
    cells = seen.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1"))).toArrow()
    cell, n, p2, p1 = (cells[c].to_numpy() for c in ("cell", "n", "p2", "p1"))
    model = Interpolation(n_all, v_all, estimate(n.astype(np.float64), p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), cell.astype(np.int64) // GRID // GRID, 1 / (v_ret + 1)))

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        before, unigram, bigram, context, counts = looked_up(table, told)
        c = counts.sum(0)
        own, above = c[unigram], c[context]
        base = np.log10((own + 1) / (model.n_tokens + model.vocabulary + 1))
        w = model.weights[level(above)]
        p = w[:, 0] * np.divide(c[bigram], above, out=np.zeros(len(bigram)), where=above > 0)
        p += w[:, 1] * own / max(1, model.n_tokens) + w[:, 2] / (model.vocabulary + 1)
        sums = lambda x: np.add.reduceat(x, before[:-1])  # noqa: E731  every text has its end token
        return pa.table([table["doc_id"], table["role"], pa.array(np.diff(before)), pa.array(sums((own > 0).astype(np.int64))), pa.array(np.full(table.num_rows, model.n_tokens)), pa.array(sums(base)), pa.array(sums(np.log10(p)))], ["doc_id", "role", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.groupBy("chunk").cogroup(answers_.groupBy("chunk")).applyInArrow(apply, "doc_id long, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def default_role(id_col: str = "doc_id") -> Column:
    """By crc32 of the id modulo 7: 2 teaches nothing, 3 is held out for the weights. Null ids teach counts."""
    rest = F.coalesce(F.pmod(id_crc(id_col), F.lit(7)), F.lit(0))
    return F.when(rest == 2, UNSEEN).when(rest == 3, HELD).otherwise(RETAINED)


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(read_table(spark, sf_dir, "documents"), default_role())
    return found.select("doc_id", (F.col("role") == UNSEEN).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
