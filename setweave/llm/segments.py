"""Multi-index join of binary codes: records meet where segments of their codes agree, and are compared in blocks.

A code's bits are cut into disjoint segments, by a random division a copy. In a division of m segments, codes that
differ in fewer than m bits agree in a whole segment (pigeonhole); one-bit minhashes at the thresholds used here
differ in more, so the number of segments is calibrated instead: as many as make RECALL of the pairs lying exactly
at the threshold agree. Their widths follow the number of records, their number follows the widths; the recall is
the same at every size.

A record is sent in several copies, each to the unit that its first segment names; a unit has some UNIT records.
There it meets the records that also agree in one of the copy's further segments, some 500 to 1000 a value, and
their codes are compared by vectorised XOR and bit count, the sizes of the sets bounding which. A pair is reported
where it first meets, so each comes once.

Codes travel packed: a map task sends, per copy and unit, one row holding all its codes there. Units named by very
many records are cut into slabs by a hash of the record, and every two slabs are a unit of their own. No row is left
out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.sketch import CODE_BITS, CODE_WORDS, SEED, radius
from setweave.session import materialize

#: Least share of the pairs exactly at the threshold that meet, and that the radii keep.
RECALL, KEEP = 0.99, 0.9995
#: Records of a map task's rows, of a unit of work, and of the first segment's values that are split.
BUFFER, UNIT, HOT = 1 << 15, 1 << 16, 1 << 18
#: Copies sent at a time; their shuffle files go before the next ones are made.
PER_PASS = 8
#: What sending a copy costs, in comparisons of one segment.
SEND = 4
RECORD = np.dtype([("ns", "<u8"), ("key", "<i8"), ("w", "<u8", (CODE_WORDS,))])
WORDS = ", ".join(f"w{i} long" for i in range(CODE_WORDS))
_ROWS, _COLUMNS = 128, 2048


@dataclass(frozen=True)
class Layout:
    """copies x (one segment of `first` bits, then `inner` segments of `width` bits)."""

    first: int
    width: int
    copies: int
    inner: int


def recall(layout: Layout, similarity: float) -> float:
    """Chance that a pair of this similarity meets.

    Segments share the code's bits, so they are independent only for a given number of differing bits.
    """
    total, q = 0.0, (1 - similarity) / 2
    agree = lambda width, x: math.comb(CODE_BITS - width, x) / math.comb(CODE_BITS, x)
    for x in range(CODE_BITS + 1):
        meet = agree(layout.first, x) * (1 - (1 - agree(layout.width, x)) ** layout.inner)
        total += math.comb(CODE_BITS, x) * q**x * (1 - q) ** (CODE_BITS - x) * (1 - (1 - meet) ** layout.copies)
    return total


def _copies(first: int, width: int, inner: int, similarity: float) -> int:
    """Fewest copies that reach RECALL."""
    low, high = 0, 1
    while recall(Layout(first, width, high, inner), similarity) < RECALL:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(Layout(first, width, mid, inner), similarity) >= RECALL else (mid, high)
    return high


@cache
def layout_for(records: int, similarity: float) -> Layout:
    """The cheapest layout for this many records: units of about UNIT, segment values of 500 to 1000 in them."""
    size = math.log2(max(records, 2))
    first = max(0, math.ceil(size - math.log2(UNIT)))
    width = max(3, math.floor(size) - first - 9)
    if not first:  # one unit holds all
        return Layout(0, width, 1, next(k for k in range(1, 1 << 12) if recall(Layout(0, width, 1, k), similarity) >= RECALL))
    options = [Layout(first, width, _copies(first, width, k, similarity), k) for k in range(1, 13)]
    return min(options, key=lambda x: x.copies * (SEND + x.inner))


def divisions(layout: Layout) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per copy the bits of its first segment, and those of its inner ones (inner x width), disjoint while the code has bits."""
    r, out = np.random.default_rng(SEED + 1), []
    for _ in range(layout.copies):
        order = r.permutation(CODE_BITS)
        first, rest = order[: layout.first], order[layout.first :]
        per = len(rest) // layout.width
        every = [p[i * layout.width : (i + 1) * layout.width] for p in [rest, *(r.permutation(rest) for _ in range(layout.inner // per))] for i in range(per)]
        out.append((first, np.array(every[: layout.inner])))
    return out


def cells(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Values of a segment of codes x CODE_WORDS unsigned words."""
    out = np.zeros(len(words), np.uint32)
    for j, bit in enumerate(segment):
        out |= (((words[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)) << np.uint64(j)).astype(np.uint32)
    return out


def masks(segments) -> np.ndarray:
    """segments x CODE_WORDS words with the segments' bits set."""
    out = np.zeros((len(segments), CODE_WORDS), np.uint64)
    for s, segment in enumerate(segments):
        for bit in segment:
            out[s, bit // 64] |= np.uint64(1) << np.uint64(63 - bit % 64)
    return out


def _buffered(batches, size: int):
    """Batches (key, n, side, w0..) -> arrays of RECORD of at least `size` rows, the last one excepted."""
    parts, held = [], 0
    for b in batches:
        rec = np.empty(b.num_rows, RECORD)
        rec["ns"] = b.column("n").to_numpy().astype(np.uint64) << np.uint64(2) | b.column("side").to_numpy().astype(np.uint64)
        rec["key"] = b.column("key").to_numpy()
        for i in range(CODE_WORDS):
            rec["w"][:, i] = b.column(f"w{i}").to_numpy().view(np.uint64)
        parts.append(rec)
        held += len(rec)
        if held >= size:
            yield np.concatenate(parts)
            parts, held = [], 0
    if held:
        yield np.concatenate(parts)


def hot_cells(classes: DataFrame, layout: Layout, records: int, hot: int) -> dict[int, dict[int, int]]:
    """copy -> {value of its first segment: slabs} of the values with more than max(hot, records / 1000) records.

    A map task names the values that hold half that share of its own rows; what it leaves out is less than half the
    limit in all. At most 2000 values a copy can pass, whatever the data.
    """
    limit = max(hot, records / 1000)
    if records <= limit:
        return {}
    share, firsts = limit / records / 2, [first for first, _ in divisions(layout)]

    def run(batches):
        for rec in _buffered(batches, BUFFER):
            for s, first in enumerate(firsts):
                value, n = np.unique(cells(rec["w"], first), return_counts=True)
                keep = n >= share * len(rec)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), s)), pa.array(value[keep].astype(np.int64)), pa.array(n[keep])], names=["s", "value", "n"])

    found = classes.mapInArrow(run, "s long, value long, n long").groupBy("s", "value").agg(F.sum("n").alias("n")).where(F.col("n") >= limit / 2)
    out: dict[int, dict[int, int]] = {}
    for r in found.collect():
        out.setdefault(r.s, {})[r.value] = max(2, math.ceil(r.n / limit * 4))
    return out


def _send(firsts: list[np.ndarray], numbers: range, split: dict):
    """Map side: rows (unit, copy, slab, cross, codes) of the copies of one pass."""

    def run(batches):
        for rec in _buffered(batches, BUFFER):
            out = []
            for s in numbers:
                value, here = cells(rec["w"], firsts[s]), rec
                for cell, slabs in split.get(s, {}).items():
                    own = rec[value == cell]
                    at = own["key"] % slabs
                    for i in range(slabs):
                        data = own[at == i].tobytes()
                        out += [((1 << 62) | hash((s, cell, min(i, j), max(i, j))) & ((1 << 62) - 1), s, i, i != j, data) for j in range(slabs) if data]
                if s in split:
                    rest = ~np.isin(value, list(split[s]))
                    value, here = value[rest], rec[rest]
                order = np.argsort(value, kind="stable")
                value, packed = value[order].astype(np.int64), here[order]
                edges = np.flatnonzero(np.diff(value, prepend=-1, append=-1))
                out += [((s << 32) | int(value[lo]), s, -1, False, packed[lo:hi].tobytes()) for lo, hi in zip(edges, edges[1:])]
                if len(out) > 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["unit", "copy", "slab", "cross", "codes"])


def near(x: np.ndarray, y: np.ndarray, ratio: float, within: tuple[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i of x, j of y) of the codes within the radii, over their first two words and over all.

    Both are sorted by set size, and sizes a pair may have bound what is compared; with `same` x is y, and i < j.
    """
    nx, ny = (z["ns"] >> np.uint64(2) for z in (x, y))
    wx, wy = (np.ascontiguousarray(z["w"][:, :2].T) for z in (x, y))
    found_i, found_j = [], []
    for i0 in range(0, len(x), _ROWS):
        i1 = min(i0 + _ROWS, len(x))
        first = i0 + 1 if same else int(np.searchsorted(ny, math.floor(int(nx[i0]) * ratio), "left"))
        last = int(np.searchsorted(ny, math.ceil(int(nx[i1 - 1]) / ratio), "right"))
        for j0 in range(first, last, _COLUMNS):
            j1 = min(j0 + _COLUMNS, last)
            apart = np.bitwise_count(wx[0, i0:i1, None] ^ wy[0, None, j0:j1])
            apart += np.bitwise_count(wx[1, i0:i1, None] ^ wy[1, None, j0:j1])
            i, j = np.divmod(np.flatnonzero(apart <= within[0]), j1 - j0)
            found_i.append(i + i0)
            found_j.append(j + j0)
    i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
    if same:
        i, j = i[i < j], j[i < j]
    small, large = np.minimum(nx[i], ny[j]), np.maximum(nx[i], ny[j])
    ok = (np.bitwise_count(x["w"][i] ^ y["w"][j]).sum(1, dtype=np.int64) <= within[1]) & (small >= large * (ratio - 1e-12))
    return i[ok], j[ok]


def _compare(layout: Layout, similarity: float, within: tuple[int, int], between: bool):
    """Reduce side: rows sorted by unit -> pairs (a, b, na, nb)."""
    both = divisions(layout)
    first_bits = masks([f for f, _ in both])
    inner_bits = [masks(inner) for _, inner in both]

    def pairs(x, y, i, j, s, u):
        apart = x["w"][i] ^ y["w"][j]
        agrees = lambda bits: ~((apart & bits) != 0).any(1)
        fresh = np.ones(len(i), bool)
        for t in range(s + 1):
            met = np.zeros(len(i), bool)
            for bits in inner_bits[t][: u if t == s else None]:
                met |= agrees(bits)
            fresh &= ~(met & agrees(first_bits[t]))
        if between:
            fresh &= ((x["ns"][i] | y["ns"][j]) & np.uint64(3)) == 3
        i, j = i[fresh], j[fresh]
        na, nb = ((z["ns"][k] >> np.uint64(2)).astype(np.int64) for z, k in ((x, i), (y, j)))
        a, b = x["key"][i], y["key"][j]
        turn = (na > nb) | ((na == nb) & (a > b))
        cols = [np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "na", "nb"])

    def sorted_by(z, segment):
        value = cells(z["w"], segment)
        order = np.lexsort((z["ns"], value))
        value = value[order].astype(np.int64)
        edges = np.flatnonzero(np.diff(value, prepend=-1, append=-1))
        return z[order], dict(zip(value[edges[:-1]].tolist(), zip(edges.tolist(), edges[1:].tolist())))

    def work(s, held, cross):
        slabs = [np.frombuffer(b"".join(v), RECORD) for v in held.values()]
        for u, segment in enumerate(both[s][1]):
            x, own = sorted_by(slabs[0], segment)
            y, other = sorted_by(slabs[1], segment) if cross else (x, own)
            found = [(lo, at, *near(x[lo:hi], y[at:to], similarity, within, not cross)) for value, (lo, hi) in own.items() if value in other for at, to in [other[value]] if cross or hi - lo > 1]
            if found:
                i, j = np.concatenate([f[2] + f[0] for f in found]), np.concatenate([f[3] + f[1] for f in found])
                yield pairs(x, y, i, j, s, u)

    def run(batches):
        unit, s, cross, held = None, 0, False, {}
        for b in batches:
            for now, copy, slab, is_cross, codes in zip(*(b.column(c).to_pylist() for c in ("unit", "copy", "slab", "cross", "codes"))):
                if now != unit:
                    if held and len(held) > cross:
                        yield from work(s, held, cross)
                    unit, s, cross, held = now, copy, is_cross, {}
                held.setdefault(slab, []).append(codes)
        if held and len(held) > cross:
            yield from work(s, held, cross)

    return run


def code_pairs(classes: DataFrame, similarity: float, records: int, between: bool = False, hot: int = HOT, layout: Layout | None = None) -> DataFrame:
    """classes (key, n, side, w0..), each key once -> pairs (a, b, na, nb) within the radii, na <= nb, each once.

    `similarity` is the threshold, which the sizes' ratio cannot fall below either. `side` says where a class occurs:
    1 first table, 2 second, 3 both; with `between`, a pair needs one class on each side. `records` is the number of
    classes. Empty tables give no pairs.
    """
    layout = layout or layout_for(records, similarity)
    firsts = [first for first, _ in divisions(layout)]
    split = hot_cells(classes, layout, records, hot)
    within = (radius(128, similarity, KEEP), radius(CODE_BITS, similarity, KEEP))
    out = None
    for lo in range(0, layout.copies, PER_PASS):
        sent = classes.select("key", "n", "side", *(f"w{i}" for i in range(CODE_WORDS)))
        sent = sent.mapInArrow(_send(firsts, range(lo, min(layout.copies, lo + PER_PASS)), split), "unit long, copy int, slab int, cross boolean, codes binary")
        met = sent.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(layout, similarity, within, between), "a long, b long, na long, nb long")
        met = materialize(met, "near")
        out = met if out is None else out.unionByName(met)
    return out
