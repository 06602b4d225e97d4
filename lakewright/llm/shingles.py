"""Word hashes, five-word shingles and sketches of texts, in numpy.

A word is a run of bytes outside the separators; A-Z are lower-cased.  The hash of a
word is a polynomial over random byte values modulo 2**64, read from prefix sums, then
mixed; that of a shingle combines the hashes of its words by place.  Distinct shingles
of the same text, or of two texts, share a hash with a chance of about n**2 / 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WORDS = 5

_random = np.random.Generator(np.random.PCG64(20_240_101))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_up, _down = np.ones(1, U), np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    while len(_up) <= n:
        k = len(_up)
        _up = np.concatenate([_up, _up * U(pow(_BASE, k, 2**64))])
        _down = np.concatenate([_down, _down * U(pow(_INVERSE, k, 2**64))])
    return _up, _down


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none
    edge = np.diff(np.concatenate([[True], _SEPARATOR[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), starts, ends


def shingles(w: np.ndarray) -> np.ndarray:
    """Hash of every five-word window of word hashes, in order; of all words if they are fewer."""
    n = len(w)
    if not n:
        return np.zeros(0, U)
    k = min(n, WORDS)
    out = np.full(n - k + 1, k, U)
    for i in range(k):
        out += w[i : n - k + 1 + i] * _PLACE[i]
    return mix(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingles(words(lowered(text))[0]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """100 * intersection >= percent * union, false for empty sets."""
    if not len(a) or not len(b):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def parity_sketch(s: np.ndarray) -> bytes:
    """Bits flipped once per shingle; 1024 bits, or the power of two of at least twice the shingles.

    A shingle in just one of two sets flips one bit, so the Hamming distance of two
    sketches (folded to one width) never exceeds the size of the symmetric difference.
    """
    m = 1024
    while m < 2 * len(s):
        m *= 2
    bits = np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, n_words: int) -> np.ndarray:
    """A sketch of 64-bit words folded to fewer words."""
    while len(sketch) > n_words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def distance_bound(n_a, n_b, percent: int = 80):
    """Largest symmetric difference of linked sets of these sizes."""
    # inter >= t * union and inter + union = n_a + n_b give union - inter <= (1 - t) / (1 + t) * (n_a + n_b)
    return (n_a + n_b) * (100 - percent) // (100 + percent)
