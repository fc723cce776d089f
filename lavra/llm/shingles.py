"""Word shingles of folded text as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lavra.functions import codepoints as cp


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the row it stands in."""
    codes, bounds = cp.fold(*cp.decode(texts))
    start, end, row = cp.words(codes, bounds)
    if not len(start):
        return np.zeros(0, np.uint64), row
    return cp.span_hashes(cp.prefix_hash(codes), start, end), row


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `words` consecutive words of one row, repeats included."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = hashes[words - 1 : words - 1 + n].copy()
        for k in range(words - 2, -1, -1):
            x = cp.mix(x + hashes[k : k + n] * np.uint64(2 * k + 3))
    same = row[:n] == row[words - 1 : words - 1 + n]
    return x[same], row[:n][same]
