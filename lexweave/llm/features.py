"""Hashed n-gram features of UTF-8 bytes, vectorised per document."""

from __future__ import annotations

import zlib

import numpy as np

BITS = 16
DIM = 1 << BITS
_M = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 32-bit code per word, the same in every process."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def char_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket (0 to DIM - 1) of each byte n-gram of a uint8 array."""
    size = len(raw) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    wide = raw.astype(np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = (h ^ wide[k : k + size]) * _M[k % 5]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def word_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * _M[k % 5]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def groups(raw: np.ndarray, codes: np.ndarray, char_orders=(3, 4), word_orders=(1, 2)) -> list[np.ndarray]:
    return [char_buckets(raw, n) for n in char_orders] + [word_buckets(codes, n) for n in word_orders]


def sparse_row(parts: list[np.ndarray], scale: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): each group's relative frequencies in a space of its own."""
    idx, val = [], []
    for k, part in enumerate(parts):
        if len(part):
            u, c = np.unique(part, return_counts=True)
            idx.append(u.astype(np.int64) + k * DIM)
            val.append((c * (scale / len(part))).astype(np.float32))
    return (np.concatenate(idx), np.concatenate(val)) if idx else (np.zeros(0, np.int64), np.zeros(0, np.float32))


def mean_weight(parts: list[np.ndarray], weights: np.ndarray, scale: float = 10.0) -> float:
    """The linear score of ``sparse_row`` without building it: mean weights of each group."""
    return scale * sum(float(weights[k * DIM : (k + 1) * DIM][part].mean()) for k, part in enumerate(parts) if len(part))
