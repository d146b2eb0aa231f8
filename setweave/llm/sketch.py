"""One-bit minhash codes of sets, numpy inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

PRIME_MIX = np.uint32(0x9E3779B1)
CODE_BITS = 256
CODE_WORDS = CODE_BITS // 64
SEED = 20240701


def parameters(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)), r.integers(0, 1 << 32, k, dtype=np.uint32)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64), off - off[0]


def minima(values: np.ndarray, off: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """sets x k minima of k hash functions; an empty set's are the greatest number. Works in slices that fit the CPU's cache."""
    a, b = parameters(k, seed)
    x = ((values ^ (values >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full((len(off) - 1, k), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(off))
    starts, ends = off[:-1][full], off[1:][full]
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 16384, "right")))
        part, at = x[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
        h = np.empty_like(part)
        rows = np.empty((k, hi - lo), np.uint32)
        for i in range(k):
            np.multiply(part, a[i], out=h)
            np.add(h, b[i], out=h)
            np.minimum.reduceat(h, at, out=rows[i])
        out[full[lo:hi]] = rows.T
        lo = hi
    return out


def bits(mins: np.ndarray) -> np.ndarray:
    """One bit of each minimum, sets x k of 0 and 1."""
    m = mins ^ (mins >> np.uint32(15))
    m = m * PRIME_MIX
    return ((m >> np.uint32(17)) & np.uint32(1)).astype(np.uint8)


def pack(b: np.ndarray) -> np.ndarray:
    """sets x (k/64) signed words; bit i is bit 63 - i % 64 of word i // 64."""
    return np.ascontiguousarray(np.packbits(b, axis=1)).view(">u8").astype(np.uint64).view(np.int64)


def radius(code_bits: int, similarity: float, keep: float) -> int:
    """Smallest Hamming radius that keeps `keep` of the pairs of exactly this similarity: their bits differ with chance (1 - similarity) / 2."""
    p, total = (1 - similarity) / 2, 0.0
    for r in range(code_bits + 1):
        total += math.comb(code_bits, r) * p**r * (1 - p) ** (code_bits - r)
        if total >= keep:
            return r
    return code_bits
