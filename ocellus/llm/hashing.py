"""Word and window hashes of whole UTF-8 buffers, as numpy operations.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are Rabin-Karp polynomials modulo the prime
2**61 - 1 with bases drawn from a seed, so two different sequences of n values share a hash with a chance
of n / 2**61 at most over the seeds, whatever they are.
"""

from __future__ import annotations

import hashlib
import random
import secrets

import numpy as np

_U = np.uint64
PRIME = (1 << 61) - 1
LANE, LONG_WORD = 7, 56
_P, _M30, _M31 = _U(PRIME), _U((1 << 30) - 1), _U((1 << 31) - 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(LANE + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit values."""
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # the difference wraps to a huge value where x is below the prime


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, of values below it, by products of halves of 31 and 30 bits."""
    b1, b0 = _U(b >> 31), _U(b & 0x7FFFFFFF)
    a1, a0 = a >> _U(31), a & _M31
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1
    a1 <<= _U(1)  # 2**62 is 2 modulo the prime
    a0 *= b0
    a0 += a1
    a0 += mid >> _U(30)
    mid &= _M30
    mid <<= _U(31)
    a0 += mid
    return reduced(a0)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (n + 1 values)."""
    word = NOT_SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes of words and of windows of words under one seed; values below PRIME for words, 64 bits for windows."""

    def __init__(self, seed: int):
        rng = random.Random(seed)
        self.lane, self.word, self.spread = (rng.randrange(1 << 32, PRIME) for _ in range(3))
        self.key = rng.randbytes(32)
        self.lengths = np.array([n * self.lane % PRIME for n in range(LONG_WORD + 1)], np.uint64)

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A hash of each word; fold: A-Z count as a-z.

        Words of up to LONG_WORD bytes are polynomials of their length and of lanes of 7 bytes; of longer
        ones, BLAKE2b under the seed's key. A last product spreads them over the whole range.
        """
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = FOLD[buf] if fold else buf
        view = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        size = ends - starts
        h = self.lengths[np.minimum(size, LONG_WORD)]
        h += view[starts] & _MASKS[np.minimum(size, LANE)]
        h = reduced(h)
        some, at = np.flatnonzero(size > LANE), LANE
        while len(some):
            left = size[some] - at
            x = times(h[some], self.lane)
            x += view[np.minimum(starts[some] + at, len(buf))] & _MASKS[np.minimum(left, LANE)]
            h[some] = reduced(x)
            at += LANE
            some = some[left > LANE] if at < LONG_WORD else some[:0]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]].tobytes(), digest_size=8, key=self.key).digest(), "little") % PRIME
        return times(h, self.spread)

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all len(words) - width + 1 windows, document borders not regarded.

        Polynomials of 1, 2, 4 ... words, of which those in ``width`` are joined.
        """
        n = len(words)
        if n < width:
            return np.zeros(0, np.uint64)
        power, length, base = words, 1, self.word
        out, done = None, 0
        while True:
            if width & length:
                if out is None:
                    out = power
                else:
                    out = times(out[: n - done - length + 1], base)
                    out += power[done : done + len(out)]
                    out = reduced(out)
                done += length
            if 2 * length > width:
                break
            more = times(power[: n - 2 * length + 1], base)
            more += power[length : length + len(more)]
            power, length, base = reduced(more), 2 * length, base * base % PRIME
        return mix(out[: n - width + 1])


def fresh() -> Hasher:
    """A hasher of this run: the driver draws its seed and sends it with the tasks."""
    return Hasher(secrets.randbits(64))


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """counts: words before each text, n + 1. True where a window of ``width`` words lies in one text."""
    total = int(counts[-1])
    if total < width:
        return np.zeros(0, bool)
    inside = np.ones(total - width + 1, bool)
    cut = np.zeros(total + 1, np.int32)  # +1 where windows that cross a border begin, -1 behind
    for border in np.unique(counts[1:-1]):
        a = max(0, border - width + 1)
        cut[a] += 1
        cut[border] -= 1
    inside &= np.cumsum(cut)[: total - width + 1] == 0
    return inside
