"""Packing of many short codes into one bit string."""

from __future__ import annotations

import numpy as np


def pack(begins: np.ndarray, values: np.ndarray, widths: np.ndarray, total: int) -> np.ndarray:
    """Bytes of ``total`` bits with each value at its begin; begins ascend, widths are 32 at most."""
    word = begins >> 5
    at = values.astype(np.uint64) << (np.int64(64) - (begins & 31) - widths).astype(np.uint64)
    at[widths == 0] = 0
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros((total + 31) // 32 + 2, np.uint64)
    if len(begins):
        both = np.bitwise_or.reduceat(at, first)
        words[word[first]] |= both >> np.uint64(32)
        words[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: (total + 7) // 8]


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte position the 64 bits that begin there; behind the end there are zeros, 16 positions of them."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 16, np.uint64)
    for i in range(8):
        out |= padded[i : i + len(out)] << np.uint64(56 - 8 * i)
    return out
