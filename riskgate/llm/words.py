"""Hashes of words and word shingles, computed on whole buffers with numpy.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D); as the
separators are ASCII, this holds for UTF-8 text. Its hash is a polynomial over its
bytes modulo 2**64, mixed at the end. Buffers are handled in blocks of BLOCK bytes
that end at a separator, so the memory needed does not grow with a text beyond eight
bytes a word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17

# An odd base for the polynomial, its inverse, and mixing multipliers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = np.ones(256, dtype=bool)
_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept for the next call."""
    have = _powers.get(hex(base))
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[hex(base)] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _block_words(block: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(block) + 2, dtype=np.int8)
    inside[1:-1] = ~gap[block]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(block)), out=total[1:])
    value = (total[end] - total[start]) * _power(_INVERSE, len(block) + 1)[start]
    return start, mix(value + (end - start).astype(np.uint64) * _STEP)


def words(data: bytes, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word in bytes, hash of each word). With `letters`, words are runs
    of ASCII letters and digits and of anything beyond ASCII, so punctuation separates."""
    gap = _MARKS if letters else _SPACE
    buffer = np.frombuffer(data, dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = min(len(buffer), at + BLOCK)
        if end < len(buffer):
            gaps = np.flatnonzero(gap[buffer[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a block
                ends = np.flatnonzero(gap[buffer[at:]])
                end = at + int(ends[0]) + 1 if len(ends) else len(buffer)
        block = buffer[at:end]
        start, value = _block_words(_LOWER[block] if lower else block, gap)
        starts.append(start + at)
        hashes.append(value)
        at = end
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def many_words(texts: list[bytes], lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: (first word of each text and the total, word
    starts within the texts joined by one byte, word hashes)."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, hashes = words(b"\n".join(texts), lower, letters)
    return np.searchsorted(starts, begins), starts, hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (their order counts)."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    last = len(hashes) - n + 1
    value = hashes[:last]
    for k in range(1, n):
        value = mix(value * _STEP + np.uint64(k)) + hashes[k:k + last]
    return mix(value)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; with fewer words the whole
    sequence counts as one shingle, without words there is none."""
    return np.unique(grams(hashes, min(n, len(hashes)))) if len(hashes) else hashes
