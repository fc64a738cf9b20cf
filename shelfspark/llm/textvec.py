"""Words of many texts at once: class arrays, boundaries and 64-bit hashes by prefix sums, all in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: Byte classes. SPACE: the six ASCII spaces part words. ALNUM: words are ASCII letters and digits and all of non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: ASCII letters in lower case; other bytes as they are.
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _BYTE[_FOLD]

_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_pow[0]) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _RINV)):
                x = np.full(m, U(r & (1 << 64) - 1))
                x[0] = 1
                _pow[k] = np.multiply.accumulate(x)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_bounds(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of ``inside`` bytes; no run goes on past the end of its text."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | edge[1:n]
    end = m.copy()
    end[:-1] &= ~m[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of buf[start:end], by differences of a polynomial prefix sum; spans are in order and don't overlap."""
    out = np.empty(len(starts), U)
    vals = _FOLDED if fold else _BYTE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + piece, "right")))
            hi = int(ends[j - 1])
            r, rinv = powers(hi - lo + 1)
            s = np.zeros(hi - lo + 1, U)
            np.cumsum(vals[buf[lo:hi]] * r[: hi - lo], out=s[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (s[b] - s[a]) * rinv[a] + (ends[i:j] - starts[i:j]).astype(U) * U(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def window_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all windows of m consecutive words; windows that cross texts are for the caller to leave out."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        r, rinv = powers(len(words) + 1)
        s = np.zeros(len(words) + 1, U)
        np.cumsum(words * r[: len(words)], out=s[1:])
        return mix((s[m:] - s[:n]) * rinv[:n])


def doc_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text, the index of its first word (n+1 entries)."""
    return np.searchsorted(starts, offs, "left")
