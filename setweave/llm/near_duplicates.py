"""Near-duplicate records with small edits: anchor points of a covering code.

A record's fingerprint is, per table, a word of three symbols, 32-bit minhashes of its runs of three tokens. A symbol
is equal in two records with a chance that is the similarity of their run sets, so what is found depends on the
similarity that counts and on nothing else: an edit here and there, an appended half or a moved passage alike.

The anchors are the words (x, y, x + y) of the parity code. Every word lies within distance 1 of it (covering
radius 1): changing any one of three symbols makes a code word, so a fingerprint is replicated to three anchors.
Fingerprints that differ in one symbol at most (threshold 1) share one of them, which replicating within the radius
on both sides ensures. The number of tables makes RECALL of the pairs exactly at the similarity asked for meet; it
depends on that similarity alone, never on the number of records.

Anchors with one record fall away in a packed exchange. At the others records are compared, by a Hamming radius over
128 bits and then by their whole run sets. First every
record is compared with the least record of its anchors; records so linked form components. Then the records of an
anchor outside the component that has most of its records are compared with all others there. A link that is left
out joins records of one component, so the groups are those of all pairs, while a group of near copies, however
large, costs its anchors one comparison a record.

Records with equal token sequences are one class and enter once, so copies never meet each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm import sketch, words
from setweave.llm.similar_sets import newest_coded, of_wanted, similar_whole
from setweave.operators.components import connected_components
from setweave.session import discard, materialize

#: Least share of the pairs exactly at the threshold that meet at an anchor, and that the Hamming radius keeps.
RECALL, KEEP = 0.99, 0.999
BITS = 128
SYMBOLS = 3
#: Records of a map task's rows; (anchor, record) pairs of a reduce unit; records of an anchor in a map task that make it crowded.
BUFFER, UNIT, CROWD = 1 << 15, 1 << 20, 64
_PLACED = np.dtype([("anchor", "<i8"), ("key", "<i8")])


def tables_for(similarity: float) -> int:
    """Tables, each met by the pairs that agree in two symbols of three or more."""
    meet = 3 * similarity**2 * (1 - similarity) + similarity**3
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))) if meet < 1 else 1


def anchors_of(symbols: np.ndarray) -> np.ndarray:
    """records x (3 tables) symbols -> records x (3 tables) anchors: the code words at distance 1 or less, numbered per table."""
    w = symbols.reshape(len(symbols), -1, SYMBOLS)
    a, b, c = (w[:, :, i].astype(np.uint32) for i in range(SYMBOLS))
    first, second = np.stack([a, a, c - b], 2), np.stack([b, c - a, b], 2)
    table = np.arange(w.shape[1], dtype=np.uint64)[None, :, None]
    whole = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    return words.mixed(whole + words.mixed(table + np.uint64(1))).view(np.int64).reshape(len(symbols), -1)


def _fingerprints(size: int, tables: int):
    def run(batches):
        for b in batches:
            values, off = words.hashed(b.column("text").to_pylist())
            m = sketch.minima(*words.runs(values, off, size), BITS)
            w = sketch.pack(sketch.bits(m))
            symbols = np.ascontiguousarray(m[:, : SYMBOLS * tables]).view(np.uint8)
            cols = [b.column("id"), b.column("at"), pa.array(words.digest(values, off)), pa.array(np.diff(off)), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in symbols], pa.binary())], names=["id", "at", "key", "n", "w0", "w1", "symbols"])

    return run


def _anchors(units: int):
    """Map side: rows (unit, pairs) with packed (anchor, key) pairs, by range of the anchor.

    Of an anchor that holds more than CROWD records of the task's buffer two go that way, which tells the reduce side
    that it is shared; the others are known to be shared and go to a unit of the task's own, numbered below 0.
    """

    def run(batches):
        for key, symbols in _gathered(batches):
            at = anchors_of(symbols)
            rec = np.empty(at.size, _PLACED)
            rec["anchor"], rec["key"] = at.ravel(), np.repeat(key, at.shape[1])
            rec = rec[np.argsort(rec["anchor"], kind="stable")]
            begins = np.flatnonzero(np.diff(rec["anchor"], prepend=rec["anchor"][0] - 1))
            place = np.arange(len(rec)) - np.repeat(begins, np.diff(np.append(begins, len(rec))))
            crowded = np.repeat(np.diff(np.append(begins, len(rec))) > CROWD, np.diff(np.append(begins, len(rec))))
            direct = rec[crowded & (place > 1)]
            rest = rec[~(crowded & (place > 1))]
            unit = (rest["anchor"].view(np.uint64) >> np.uint64(40)).astype(np.int64) * units >> 24
            order = np.argsort(unit, kind="stable")
            unit, rest = unit[order], rest[order]
            edges = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
            out = [(int(unit[lo]), rest[lo:hi].tobytes()) for lo, hi in zip(edges, edges[1:])]
            out += [(-1 - int(key[0]) % units, direct[lo : lo + (1 << 16)].tobytes()) for lo in range(0, len(direct), 1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["unit", "pairs"])

    return run


def _gathered(batches):
    """Batches (key, symbols) -> arrays of BUFFER records or more."""
    keys, parts, held = [], [], 0
    for b in batches:
        if b.num_rows:
            keys.append(b.column("key").to_numpy())
            parts.append(np.frombuffer(b"".join(b.column("symbols").to_pylist()), np.uint32).reshape(b.num_rows, -1))
            held += b.num_rows
        if held >= BUFFER:
            yield np.concatenate(keys), np.concatenate(parts)
            keys, parts, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(parts)


def _shared(batches):
    """Reduce side: rows sorted by unit -> (anchor, key) of the anchors that hold two records or more."""

    def of(unit, held):
        rec = np.frombuffer(b"".join(held), _PLACED)
        if unit >= 0:
            rec = rec[np.argsort(rec["anchor"], kind="stable")]
            new = np.diff(rec["anchor"], prepend=rec["anchor"][0] - 1) != 0
            rec = rec[~(new & np.append(new[1:], True))]
        return pa.RecordBatch.from_arrays([pa.array(rec["anchor"]), pa.array(rec["key"])], names=["anchor", "key"])

    unit, held = None, []
    for b in batches:
        for now, pairs in zip(b.column("unit").to_pylist(), b.column("pairs").to_pylist()):
            if held and (now != unit or unit < 0):
                yield of(unit, held)
                held = []
            unit = now
            held.append(pairs)
    if held:
        yield of(unit, held)


def shared_anchors(classes: DataFrame, records: int, tables: int) -> DataFrame:
    """classes (key, symbols) -> (anchor, key) where an anchor holds two records or more, each once."""
    units = min(1 << 24, max(1, math.ceil(records * tables * SYMBOLS / UNIT)))
    sent = classes.select("key", "symbols").mapInArrow(_anchors(units), "unit long, pairs binary")
    return sent.repartition("unit").sortWithinPartitions("unit").mapInArrow(_shared, "anchor long, key long")


def within(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose 128 bits lie within the radius. classes: (key, w0, w1), each once."""
    a, b = (classes.select(F.col("key").alias(x), F.col("w0").alias(f"{x}0"), F.col("w1").alias(f"{x}1")).hint("merge") for x in "ab")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    return pairs.join(a, "a").join(b, "b").where(apart <= sketch.radius(BITS, similarity, KEEP)).select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def star_candidates(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of a record and the least record of one of its anchors."""
    least = shared.groupBy("anchor").agg(F.min("key").alias("least"))
    return shared.join(least.hint("merge"), "anchor").where("key <> least").select(*_ordered("key", "least")).distinct()


def other_candidates(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share an anchor."""
    root = components.select(F.col("node").alias("key"), "root")
    p = shared.join(root.hint("merge"), "key", "left").select("anchor", "key", F.coalesce("root", "key").alias("root"))
    per = p.groupBy("anchor", "root").agg(F.count("*").alias("c")).groupBy("anchor").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = p.join(per.where("roots > 1").select("anchor", "main").hint("merge"), "anchor")
    x, y = mixed.where("root <> main").select("anchor", F.col("key").alias("x"), F.col("root").alias("rx")), mixed.select("anchor", F.col("key").alias("y"), F.col("root").alias("ry"))
    return x.hint("merge").join(y, "anchor").where("rx <> ry").select(*_ordered("x", "y")).distinct()


def _run_sets(size: int):
    def run(batches):
        for b in batches:
            values, off = words.hashed(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(words.digest(values, off)), words.lists(*words.distinct(*words.runs(values, off, size)))], names=["key", "elems"])

    return run


def near_groups(texts: DataFrame, similarity: float, size: int, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Delivered rows (id, at, text) -> (components (node, root) of classes, members (id, key, n)).

    Of an id the newest delivery counts. Null and blank texts, and those under min_tokens tokens, are in no group;
    ties at the similarity are links. No rows give no groups.
    """
    tables = tables_for(similarity)
    schema = "id string, at timestamp, key long, n long, w0 long, w1 long, symbols binary"
    coded = materialize(texts.select("id", "at", "text").mapInArrow(_fingerprints(size, tables), schema), "fingerprints")
    members, classes = newest_coded(coded, min_tokens)
    discard(coded)
    shared = materialize(shared_anchors(classes, classes.count(), tables), "shared")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        near = materialize(within(candidates, classes, similarity), "near")
        if near.isEmpty():
            return near
        sets = of_wanted(texts, classes, near).select("text").mapInArrow(_run_sets(size), "key long, elems array<long>")
        return materialize(similar_whole(near, sets, similarity).select("a", "b"), name)

    stars = verified(star_candidates(shared), "stars")
    components = connected_components(stars)
    others = verified(other_candidates(shared, components), "others")
    if others.isEmpty():
        return components, members
    # A component takes part in the second round as its root.
    root = components.select("node", "root")
    ends = others.join(root.toDF("a", "ra").hint("merge"), "a", "left").join(root.toDF("b", "rb").hint("merge"), "b", "left")
    joined = materialize(connected_components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "joined")
    moved = components.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_top")).hint("merge"), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    new = joined.join(components.select("node").hint("merge"), "node", "left_anti").select("node", "root")
    return moved.unionByName(new), members
