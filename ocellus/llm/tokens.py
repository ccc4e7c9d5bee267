"""Token ids of whole texts by a public tokenizer, with a hash table of the units it never joins."""

from __future__ import annotations

import os

import numpy as np

from ocellus.llm.common import blocks
from ocellus.llm.hashing import FOLD, NOT_SPACE, SPACE, fresh, mix, word_bounds

TABLE_UNITS, TABLE_BYTES = 3_000_000, 64 << 20
_LETTER, _MARK, _HARD = 1, 2, 4
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _HARD
_CLASS[[39, 60]] = _HARD  # the apostrophe may begin a contraction, "<" a special token
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[SPACE] = 0
_tokenizers: dict[tuple[str, int], "UnitTokenizer"] = {}


class UnitTokenizer:
    """Encodes batches of UTF-8 texts; ids are unsigned integers of 2 or 4 bytes.

    The tokenizer drops white space, keeps runs of letters and runs of marks apart, and never joins
    what it keeps apart. So a text's ids are those of its units: of words made of ASCII and Latin-1
    letters and of ASCII marks, the runs of either; any other word whole. Units are found and hashed by
    numpy (A-Z count as a-z in runs of letters, as the tokenizer lowers them); each distinct one goes to
    the library once and its ids are gathered from a table, which has the units' bytes too: a text of
    which any unit's bytes differ from the table's goes to the library whole. Units of letters go to it
    many in one string, whose ids are parted behind ids that end a word. The table is emptied when it
    holds ``TABLE_UNITS`` units or ``TABLE_BYTES`` of their bytes, so memory stays bounded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.hasher = fresh()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)
        self.at = np.zeros(0, np.int64)  # where each unit's bytes begin
        self.lengths = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, keys: np.ndarray, data: list[bytes], plain: np.ndarray) -> None:
        """data: the units, folded where they are not hard; plain: those that consist of letters."""
        units = [u.decode() for u in data]
        sizes = np.zeros(len(units), np.int64)
        found: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        for at in range(0, n, 4000):
            some = order[at : min(n, at + 4000)]
            ids = self.library(" ".join([units[k] for k in some]))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                found.append(ids)
                sizes[some] = np.diff(cuts, prepend=0)
            else:
                for k in some:
                    found.append(self.library(units[k]))
                    sizes[k] = len(found[-1])
        for k in order[n:]:
            found.append(self.library(units[k]))
            sizes[k] = len(found[-1])
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, *found])
        lengths = np.array([len(u) for u in data], np.int64)
        self.at = np.insert(self.at, at, np.cumsum(lengths) - lengths + len(self.bytes))
        self.lengths = np.insert(self.lengths, at, lengths)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(data), np.uint8)])

    def _units(self, buf: np.ndarray, offsets: np.ndarray):
        """Starts, ends, hashes, whether made of letters, units before each text, and the bytes, A-Z lowered but in hard words."""
        kind = _CLASS[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        tail = buf[lead + 1]
        lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
        starts, ends, before = word_bounds(buf, offsets)
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64), np.zeros(0, bool), before, buf
        hard = np.bitwise_or.reduceat(kind, starts) >= _HARD  # white space between words adds nothing
        # One unit for a hard word; else a unit for each run of one class.
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts[~hard]] = 1
        inside[ends[~hard]] -= 1
        easy = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        cut = np.zeros(len(buf), bool)
        cut[1:] = easy[1:] & easy[:-1] & (kind[1:] != kind[:-1])
        cut[starts] = True
        first = np.flatnonzero(cut)
        last = np.empty(len(first), np.int64)
        last[:-1] = first[1:]
        last[-1] = len(buf)
        word = np.searchsorted(starts, first, side="right") - 1
        last = np.minimum(last, ends[word])
        plain = ~hard[word] & (kind[first] == _LETTER)
        data = np.where(easy, FOLD[buf], buf)
        keys = self.hasher.words(data, first, last) << np.uint64(1) | hard[word]
        return first, last, mix(keys), plain, np.searchsorted(first, offsets), data

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin: n + 1 values)."""
        first, last, keys, plain, before, data = self._units(buf, offsets)
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > TABLE_UNITS or len(self.bytes) + len(buf) > TABLE_BYTES:
            self._clear()
        slot = np.searchsorted(self.keys, distinct)
        slot[slot == len(self.keys)] = 0
        new = self.keys[slot] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            own, k = data.tobytes(), at[new]
            self._learn(distinct[new], [own[a:z] for a, z in zip(first[k].tolist(), last[k].tolist())], plain[k])
            slot = np.searchsorted(self.keys, distinct)
        slot = slot[inverse]
        sizes = self.sizes[slot]
        ids, cuts = self.ids[_spread(self.starts[slot], sizes)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[before]
        wrong = self._differ(data, first, last, slot)
        if len(wrong):
            return self._by_library(buf, offsets, ids, cuts, np.unique(np.searchsorted(before, wrong, side="right") - 1))
        return ids, cuts

    def _differ(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those of the table's unit: none, but for chance. Units cover all bytes but white space."""
        lengths = last - first
        odd = lengths != self.lengths[slot]
        if not odd.any():
            same = data[NOT_SPACE[data]] == self.bytes[_spread(self.at[slot], lengths)]
            if same.all():
                return np.zeros(0, np.int64)
            odd = ~np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)
            return np.flatnonzero(odd)
        table = self.bytes.tobytes()
        return np.array([k for k in range(len(first)) if data[first[k] : last[k]].tobytes() != table[self.at[slot[k]] : self.at[slot[k]] + self.lengths[slot[k]]]], np.int64)

    def _by_library(self, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, cuts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and cuts with the ids of ``texts`` made anew by the library."""
        parts = [ids[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        for k in texts.tolist():
            parts[k] = self.library(buf[offsets[k] : offsets[k + 1]].tobytes().decode())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buf, out = np.frombuffer(b"".join(texts), np.uint8), []
        for i, j in blocks(offsets):
            ids, cuts = self.encode_buffer(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [ids[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for sizes[0] values, then those of the next."""
    after = np.cumsum(sizes)
    at = np.repeat(starts - after + sizes, sizes)
    at += np.arange(len(at))
    return at


def tokenizer(path: str) -> UnitTokenizer:
    """One per Python worker and file."""
    key = (path, os.getpid())
    if key not in _tokenizers:
        _tokenizers[key] = UnitTokenizer(path)
    return _tokenizers[key]


def arrow_bytes(column) -> list[bytes]:
    """UTF-8 of each row, nulls empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
