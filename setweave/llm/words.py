"""Tokens of text batches in Python, hashed; the same tokens as functions.text.tokens.

A batch is tokenised by one regular expression a text, and every distinct token is hashed once a worker; all that
follows is numpy on (values, offsets), the hashes of all texts one after another and where each text begins.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: All but letters, numbers, the underscore (\w) and white space.
_DROPPED = re.compile(r"[^\w\s]+")
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Token -> 64-bit hash; emptied when it holds 2**18 tokens, some 40 MB."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


_hashes = _Hashes()


def tokens(text: str | None) -> list[str]:
    return _DROPPED.sub("", text).lower().split() if text else []


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes in order, offsets of the texts, one more than texts)."""
    return hashed_lists([tokens(t) for t in texts])


def hashed_lists(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts already tokenised."""
    off = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=off[1:])
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(lists)), np.uint64, int(off[-1])), off


def hash_of(terms: pa.Array) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, terms.to_pylist()), np.uint64, len(terms))


def counted(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, then per distinct term of a text: number of the text, number of the term, occurrences; tokens of each text)."""
    lists = [tokens(t) for t in texts]
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    terms = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    width = max(1, len(terms.dictionary))
    both, tf = np.unique(np.repeat(np.arange(len(lists)), length) * width + terms.indices.to_numpy(), return_counts=True)
    return terms.dictionary, both // width, both % width, tf, length


def gathered(batches, columns: list[str], rows: int = 1 << 14, size: int = 1 << 26):
    """Batches put together as lists of column values, up to about `rows` rows or `size` bytes at a time."""
    held: list[list] = [[] for _ in columns]
    bytes_held = 0
    for b in batches:
        for h, c in zip(held, columns):
            h += b.column(c).to_pylist()
        bytes_held += b.nbytes
        if len(held[0]) >= rows or bytes_held >= size:
            yield held
            held, bytes_held = [[] for _ in columns], 0
    if held[0]:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def runs(values: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` consecutive values of each text, and the offsets; texts shorter than that have none."""
    n = np.maximum(np.diff(off) - (size - 1), 0)
    out_off = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out_off[-1], dtype=np.int64) + np.repeat(off[:-1] - out_off[:-1], n)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[at + k])
    return h, out_off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and the offsets."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[new], np.concatenate([[0], np.cumsum(np.bincount(t[new], minlength=len(off) - 1))])


def digest(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit digest of each text's values in their order."""
    n = np.diff(off)
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
    padded = np.append(mixed(values + mixed(place + np.uint64(1))), np.uint64(0))
    total = np.where(n > 0, np.add.reduceat(padded, off[:-1]), np.uint64(0)).astype(np.uint64)
    return mixed(total + n.astype(np.uint64)).view(np.int64)


def lists(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    """list<int64> of each text's values."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))
