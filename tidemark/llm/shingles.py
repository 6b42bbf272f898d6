"""Hashed word shingles of whole texts, with numpy over many texts at once.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lowered. A word's hash is a polynomial over the
64-bit wheel with a random number for each byte value; a shingle's is one over its words' mixed hashes. Equal
sequences have equal hashes; that different ones among all of a corpus do is as unlikely as for any 64-bit hash.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240117)
BYTE_HASH = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte (in data) of every word of all texts, and the texts' offsets into the words."""
    is_word = IS_WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = is_word[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    stops = np.append(starts[1:], len(data))
    sizes = np.add.reduceat(is_word.astype(np.int64), starts)
    within = np.arange(len(data), dtype=np.int64)
    within[starts[0] :] -= np.repeat(starts, stops - starts)
    within *= is_word
    values = BYTE_HASH[LOWER[data]] * powers(BYTE_BASE, int(within.max()) + 1)[within]
    values *= is_word
    return mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64)), starts, starts + sizes, np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row (of one text, or of many end to end); fewer than k words give none."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * WORD_BASE + words[i : len(words) - k + 1 + i]
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of fewer words than a shingle has, apart from all shingles'."""
    out = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            out = out * WORD_BASE + w
    return mix(np.array([out ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. A text of fewer than k words has its whole sequence as one; one without
    words has none."""
    words, _, _, at = words_of(data, offsets)
    flat = shingles_of(words, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(flat[a : b - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(np.array([sequence_hash(words[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out
