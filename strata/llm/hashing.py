"""Vectorised polynomial hashing of bytes and words.

A prefix hash modulo 2^64 has an odd base, so it is invertible and the hash of any span is one
subtraction and one product. Bytes go through a fixed random table first.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shift-multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE, BYTE2 = _table(256, 0x51), _table(256, 0x1D3)
#: Odd factors of the words of a shingle, then a mark for shorter sequences.
WORD = _table(16, 0x77) | _U(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"n": 0}
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if _powers["n"] < n + 1:
        size = max(n + 1, 1 << 16)
        p, q = np.full(size, BASE, dtype=_U), np.full(size, _INVERSE, dtype=_U)
        p[0] = q[0] = 1
        _powers.update(n=size, p=np.cumprod(p), q=np.cumprod(q))
    return _powers["p"], _powers["q"]


def forget() -> None:
    """Drop the powers kept, of which there are as many as the longest buffer so far had bytes."""
    _powers.clear()
    _powers["n"] = 0


def prefix(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Prefix hashes of length len(buf) + 1."""
    p, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, dtype=_U)
    out[0] = 0
    np.cumsum(table[buf] * p[: len(buf)], out=out[1:])
    return out


def spans(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each span [a, b); equal bytes have equal hashes wherever they start."""
    _, q = powers(len(h))
    return (h[b] - h[a]) * q[a]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (n + 1)."""
    solid = ~SPACE[buf]
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | first[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1], after[:-1] = True, ~solid[1:]
    ends = np.flatnonzero(solid & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(spans(prefix(buf), starts, ends) + (ends - starts).astype(_U)) if len(starts) else np.zeros(0, dtype=_U)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the last n - 1 entries run over the end and are not to be used."""
    out = h * WORD[0]
    for k in range(1, min(n, len(h))):
        out[: len(h) - k] += h[k:] * WORD[k]
    return mix(out)
