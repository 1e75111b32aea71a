"""Canonical length-limited Huffman codes of token ids, on numpy arrays.

Codes come from counts by package-merge, so no code is longer than the limit.
A block of ids is one bit string; the bit offset of every ``STEP``-th id is kept
as a checkpoint. Decoding looks whole codes up in a table and runs all stretches
between checkpoints side by side.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits; it needs to hold the ids that occur, 2**18 of them at most.
LIMIT = 18
#: Ids between two checkpoints.
STEP = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for one that does not occur, by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of the longest length")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(weights) // 2
        packages = weights[: 2 * pairs].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        is_leaf.append(at < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for symbol in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids``, padded to 32 bits, and its checkpoints."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    value = codes[ids].astype(np.uint64) << (64 - (begins & 31) - bits).astype(np.uint64)
    word = begins >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(ends[-1] + 31) // 32 + 1, np.uint64)
    both = np.bitwise_or.reduceat(value, first)
    words[word[first]] |= both >> np.uint64(32)
    words[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
    return words[: int(ends[-1] + 31) // 32].astype(">u4").tobytes(), begins[::STEP].astype(np.uint32)


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` bits the symbol that they begin with and its bits."""
    symbols, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    codes = canonical_codes(lengths)
    for symbol in np.flatnonzero(lengths):
        low = int(codes[symbol]) << (limit - int(lengths[symbol]))
        high = low + (1 << (limit - int(lengths[symbol])))
        symbols[low:high] = symbol
        bits[low:high] = lengths[symbol]
    return symbols, bits


def decode(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """Ids of each block, given as its bit string, its checkpoints and its number of ids."""
    symbols, bits = table
    pad = bytes(4 + STEP * limit // 8 + 8)
    raw = np.frombuffer(b"".join(x[0] for x in blocks) + pad, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    del raw
    at, base = [], 0
    for payload, checkpoints, _ in blocks:
        at.append(checkpoints.astype(np.int64) + 8 * base)
        base += len(payload)
    position = np.concatenate(at) if at else np.zeros(0, np.int64)
    out = np.zeros((STEP, len(position)), np.uint32)
    most = 8 * (len(window) - 1)
    for k in range(STEP):
        np.minimum(position, most, out=position)
        seen = window[position >> 3] << (position & 7).astype(np.uint32) >> np.uint32(32 - limit)
        out[k] = symbols[seen]
        position += bits[seen]
    lanes, result = out.T, []
    start = 0
    for _, checkpoints, n in blocks:
        result.append(lanes[start : start + len(checkpoints)].reshape(-1)[:n])
        start += len(checkpoints)
    return result
