"""Language ID: script ranges narrow the candidates, Viterbi over words labels spans of mixed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.common import blocks, id_crc, read_table, small_batches
from ocellus.llm.hashing import NOT_SPACE, SPACE, Hasher, mix, word_bounds

GRAMS, WORDS = 1 << 16, 1 << 16
FIT_ROWS, LEAST_ROWS, SWITCH, SMOOTH, SCRIPT_SHARE, OFF_SCRIPT = 20_000, 20, 12.0, 0.3, 0.01, -60.0

# The code points of each script's letters, by Unicode block.
SCRIPT_RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1D00, 0x1D25), (0x1D2C, 0x1D5C), (0x1D62, 0x1D65), (0x1D6B, 0x1D77), (0x1D79, 0x1DBE), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1D26, 0x1D2A), (0x1D5D, 0x1D61), (0x1D66, 0x1D6A), (0x1DBF, 0x1DBF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x1D2B, 0x1D2B), (0x1D78, 0x1D78), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "syriac": [(0x700, 0x74F), (0x860, 0x86F)],
    "thaana": [(0x780, 0x7BF)],
    "nko": [(0x7C0, 0x7FF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "canadian": [(0x1400, 0x167F), (0x18B0, 0x18FF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "tifinagh": [(0x2D30, 0x2D7F)],
    "bopomofo": [(0x3100, 0x312F), (0x31A0, 0x31BF)],
    "yi": [(0xA000, 0xA4CF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)],
    "han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "other": [(0x1680, 0x177F), (0x1900, 0x1C7F), (0xA4D0, 0xA63F), (0xA6A0, 0xA6FF), (0xA800, 0xA8DF), (0xA900, 0xA95F), (0xA980, 0xA9DF), (0xAA00, 0xAA5F), (0xAA80, 0xAAFF), (0xABC0, 0xABFF), (0x10000, 0x1EFFF)],
}
#: Script numbers are from 1, in the order above; 0 is no letter. A word has the highest of its letters' scripts.
SCRIPT_NAMES = ["", *SCRIPT_RANGES]
SCRIPTS = len(SCRIPT_NAMES)
_RANGES = sorted((first, last, SCRIPT_NAMES.index(name)) for name, ranges in SCRIPT_RANGES.items() for first, last in ranges)
_FIRST, _LAST, _NUMBER = (np.array(x, np.int64) for x in zip(*_RANGES))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32
_HASHER = Hasher(0)  # word buckets are part of the model


@dataclass
class LanguageModel:
    """langs, and per-language log probabilities of hashed character trigrams and of hashed words."""

    langs: list[str]
    grams: np.ndarray  # GRAMS + 1 rows, the last 0: for what isn't in a word
    words: np.ndarray
    allowed: np.ndarray  # script x language


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a space between, as bytes, and where each begins (n + 1 values)."""
    rows = [(t.as_py() or b"") if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])]).astype(np.int64)
    return np.frombuffer(b" ".join([*rows, b""]), np.uint8), offsets


def script_numbers(points: np.ndarray) -> np.ndarray:
    """The script of each code point, 0 if it is in no range."""
    at = np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _NUMBER[at], 0).astype(np.uint8)


_ASCII = np.zeros(256, np.uint8)
_ASCII[:128] = script_numbers(np.arange(128))


def byte_scripts(buf: np.ndarray) -> np.ndarray:
    """At each character's first UTF-8 byte its script; 0 at other bytes. ``buf`` ends with a whole character."""
    out = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        b = buf[lead].astype(np.int64)
        next_ = [buf[np.minimum(lead + i, len(buf) - 1)] & 0x3F for i in (1, 2, 3)]
        two = (b & 0x1F) << 6 | next_[0]
        three = (b & 0x0F) << 12 | next_[0].astype(np.int64) << 6 | next_[1]
        four = (b & 0x07) << 18 | next_[0].astype(np.int64) << 12 | next_[1].astype(np.int64) << 6 | next_[2]
        out[lead] = script_numbers(np.where(b < 0xE0, two, np.where(b < 0xF0, three, four)))
    return out


def _features(buf: np.ndarray, offsets: np.ndarray):
    """Bounds of words, words before each text, trigram bucket of each byte, bucket and script of each word."""
    fold = _FOLD[buf]
    upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
    fold[upper] += 32
    x = np.full(len(buf) + 2, 32, np.uint32)
    x[1:-1] = fold
    gram = (x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(40503) * np.uint32(65599) + x[2:] * np.uint32(2246822519)) >> np.uint32(16)
    gram = gram.astype(np.int64)
    gram[~NOT_SPACE[buf]] = GRAMS
    starts, ends, before = word_bounds(buf, offsets)
    if not len(starts):
        return starts, ends, before, gram, np.zeros(0, np.int64), np.zeros(0, np.uint8)
    word = (mix(_HASHER.words(fold, starts, ends)) >> np.uint64(48)).astype(np.int64)
    script = np.maximum.reduceat(byte_scripts(buf), starts)
    return starts, ends, before, gram, word, script


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of the labelled rows: about ``fit_rows`` (default 20000) over all languages.

    Each language gives about ``fit_rows`` / languages rows (LEAST_ROWS at least), or all if it has fewer,
    by hash of id and text, and always the row of the least hash: every label is learned at every size. Rows without text or label teach nothing. Counts are summed in Spark; what comes to the driver is
    at most languages x 131072 features, however large the table. No labelled row: no languages.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    small_batches(docs)
    chance = F.xxhash64("id", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min(chance).alias("least")).toArrow()
    if sum(sizes["rows"].to_pylist()) > fit_rows:
        each = max(LEAST_ROWS, fit_rows // sizes.num_rows)
        sizes = docs.sparkSession.createDataFrame(sizes.to_pylist(), "lang string, rows long, least long")
        rows = rows.join(F.broadcast(sizes), "lang").filter((F.pmod(chance, F.col("rows")) < each) | (chance == F.col("least")))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                buf, offsets = _joined(b.column(0).filter(pa.array(langs == lang)))
                total = sums.setdefault(lang, np.zeros(GRAMS + 1 + WORDS + SCRIPTS, np.int64))
                for i, j in blocks(offsets):
                    part = buf[offsets[i] : offsets[j]]
                    starts, _, _, gram, word, script = _features(part, offsets[i : j + 1] - offsets[i])
                    total[: GRAMS + 1] += np.bincount(gram, minlength=GRAMS + 1)
                    total[GRAMS + 1 : -SCRIPTS] += np.bincount(word, minlength=WORDS)
                    total[-SCRIPTS:] += np.bincount(script, minlength=SCRIPTS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "feature", "n"])

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts["lang"].to_pylist(), object)
    langs = sorted(set(names))
    table = np.zeros((len(langs), GRAMS + 1 + WORDS + SCRIPTS))
    at = np.searchsorted(np.array(langs, object), names) if len(names) else np.zeros(0, int)
    table[at, counts["feature"].to_numpy()] = counts["n"].to_numpy()

    def logs(c: np.ndarray) -> np.ndarray:
        p = (c + SMOOTH) / (c.sum(1, keepdims=True) + SMOOTH * c.shape[1])
        return np.log(p).T.astype(np.float32)

    scripts = table[:, -SCRIPTS:]
    share = scripts / np.maximum(1, scripts[:, 1:].sum(1, keepdims=True))
    allowed = (share >= SCRIPT_SHARE).T
    allowed[0] = True
    allowed[~allowed.any(1)] = True
    grams = np.vstack([logs(table[:, :GRAMS]), np.zeros((1, len(langs)), np.float32)])
    return LanguageModel(langs, grams, logs(table[:, GRAMS + 1 : -SCRIPTS]), allowed)


def word_scores(model: LanguageModel, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of every word by language, words before each text, which words have a letter)."""
    parts, counts, lettered, done = [], [np.zeros(1, np.int64)], [], 0
    for i, j in blocks(offsets, max(1 << 16, (1 << 21) // max(4, len(model.langs)))):
        starts, _, before, gram, word, script = _features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        counts.append(before[1:] + done)
        done += len(starts)
        if len(starts):
            s = np.add.reduceat(model.grams[gram], starts, axis=0)
            s += model.words[word]
            if not model.allowed[script.max()].all() or script.max() > 1:
                s[~model.allowed[script]] += OFF_SCRIPT
            s[script == 0] = 0
            parts.append(s)
            lettered.append(script > 0)
    return np.concatenate(parts) if parts else np.zeros((0, len(model.langs)), np.float32), np.concatenate(counts), np.concatenate(lettered) if lettered else np.zeros(0, bool)


def viterbi(scores: np.ndarray, before: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word: sum of scores less ``switch`` for each change within a text.

    All texts go forward together, a word each at a time, the longest first in order.
    """
    length = np.diff(before)
    order = np.argsort(-length, kind="stable")
    length, first = length[order], before[:-1][order]
    steps = int(length[0]) if len(length) else 0
    labels = np.zeros(len(scores), np.int16)
    if not steps:
        return labels
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t words
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    v = np.zeros((len(length), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        x = v[:n]
        if t:
            best = x.argmax(1)
            top = x[np.arange(n), best] - np.float32(switch)
            stay = x >= top[:, None]
            back[first[:n] + t] = np.where(stay, own, best[:, None])
            np.maximum(x, top[:, None], out=x)
            x -= x.max(1)[:, None]
        x += scores[first[:n] + t]
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, word behind the last, label) of each run."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return [(int(a), int(z), int(labels[a])) for a, z in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(labels)]]))] if len(labels) else []


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every whole text.

    lang_pred is the language of most words with a letter, ties to the first name; score is its share.
    ``und`` with score 0: a null text, one without a letter, or no learned language. spans: runs of
    words of one language, as (first word, word behind the last, language).
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<start:int,stop:int,lang:string>>" if with_spans else "")

    def run(batches):
        m = shared.value
        for b in batches:
            texts, at = b.column(1), 0
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())])
            while at < b.num_rows:
                z = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 23), side="right")))
                yield _predict(m, b.column(0)[at:z], texts[at:z], with_spans)
                at = z

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _predict(m: LanguageModel, ids: pa.Array, texts: pa.Array, with_spans: bool) -> pa.RecordBatch:
    buf, offsets = _joined(texts)
    scores, before, lettered = word_scores(m, buf, offsets)
    names, shares, runs = [], [], []
    labels = viterbi(scores, before) if m.langs else np.zeros(len(scores), np.int16)
    doc = np.repeat(np.arange(len(ids)), np.diff(before))
    votes = np.bincount(doc[lettered] * max(1, len(m.langs)) + labels[lettered], minlength=len(ids) * max(1, len(m.langs))).reshape(len(ids), -1)
    for k in range(len(ids)):
        if m.langs and not votes[k].any() and any(c.isalpha() for c in texts[k].as_py() or ""):
            votes[k] = np.bincount(labels[before[k] : before[k + 1]], minlength=len(m.langs))  # letters of scripts beyond the table
        total = int(votes[k].sum())
        if not total or not m.langs or not any(c.isalpha() for c in texts[k].as_py()):
            names.append("und")
            shares.append(0.0)
        else:
            best = int(votes[k].argmax())
            names.append(m.langs[best])
            shares.append(int(votes[k, best]) / total)
        if with_spans:
            runs.append([{"start": a, "stop": z, "lang": m.langs[x]} for a, z, x in spans(labels[before[k] : before[k + 1]])] if names[-1] != "und" else [])
    arrays = [ids, pa.array(names, pa.string()), pa.array(shares, pa.float64())]
    kinds = ["doc_id", "lang_pred", "score"]
    if with_spans:
        arrays.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
        kinds.append("spans")
    return pa.RecordBatch.from_arrays(arrays, kinds)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(id_crc(id_col), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
