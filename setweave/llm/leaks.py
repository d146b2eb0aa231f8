"""Evaluation texts leaking into training text: prefix-filtered join of shingles.

A window is a run of `window` consecutive tokens of an item; a document holds it if the same run occurs there.
As every shingle of a window has to occur, the necessary prefix of a window, with its shingles ordered by rarity
in the documents, is its rarest shingle. Documents join on those alone; the shingle's place in the window bounds
the place and length of the document's run. Runs of equal hash are then compared token by token, in the documents
that hold one, so the result is exact.

Positions whose shingle is no item's are sifted out before anything is exchanged, by a bitmap; of the rest, those
around which no run's hash is an item's leave a count only. The bitmaps take 32 bits an entry, and 2**MOST_BITS at
most; past that more positions pass, and the join decides as before.
Null and blank texts, and texts shorter than a window, hold nothing. Repeated rows count once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm import words
from setweave.operators.skew import sift
from setweave.session import discard, materialize

WINDOW = 10
SHINGLE = 5
MOST_BITS = 27
BACK = np.arange(WINDOW - SHINGLE + 1)


def _aligned(values: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of `size` values that begins at each position, 0 and False where the text ends before."""
    h, _ = words.runs(values, off, size)
    full = np.arange(len(values)) + size <= np.repeat(off[1:], np.diff(off))
    out = np.zeros(len(values), np.uint64)
    out[full] = h
    return out, full


def _windows(batches):
    """Items -> every window with its tokens and each of its shingles: (item_id, w, tokens, off, shingle)."""
    for b in batches:
        lists = [words.tokens(t) for t in b.column("text").to_pylist()]
        values, off = words.hashed_lists(lists)
        if not len(values):
            continue
        w, full = _aligned(values, off, WINDOW)
        s, _ = _aligned(values, off, SHINGLE)
        at = np.flatnonzero(full)
        flat = [t for x in lists for t in x]
        text = pa.array([" ".join(flat[i : i + WINDOW]) for i in at.tolist()], pa.string())
        ids = np.repeat(b.column("item_id").to_numpy(), np.diff(off))
        six = np.repeat(np.arange(len(at)), len(BACK))
        cols = [pa.array(ids[at][six], pa.int64()), pa.array(w[at][six].view(np.int64)), text.take(pa.array(six)), pa.array(np.tile(BACK, len(at)).astype(np.int32)), pa.array(s[(at[:, None] + BACK).ravel()].view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "w", "tokens", "off", "shingle"])


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(math.log2(8 * len(bitmap))))
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _hits(bitmaps):
    """Documents -> positions whose shingle may be an item's, with the windows that could hold it there."""

    def run(batches):
        shingles, windows = bitmaps.value
        for b in batches:
            values, off = words.hashed(b.column("text").to_pylist())
            if not len(values):
                continue
            s, full = _aligned(values, off, SHINGLE)
            hit = np.flatnonzero(full & _has(shingles, s))
            if not len(hit):
                continue
            w, whole = _aligned(values, off, WINDOW)
            begin = np.repeat(off[:-1], np.diff(off))
            start = hit[:, None] - BACK
            inside = start >= begin[hit][:, None]
            start = np.where(inside, start, 0)
            inside &= whole[start] & _has(windows, w[start])
            some = inside.any(1)
            size = np.where(some, len(BACK), 0)
            around = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(w[start[some]].ravel().view(np.int64), mask=~inside[some].ravel()))
            ids = np.repeat(b.column("doc_id").to_numpy(), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array((hit - begin[hit]).astype(np.int64)), pa.array(s[hit].view(np.int64)), around], names=["doc_id", "pos", "shingle", "around"])

    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of 64-bit hashes (column h), merged into 64-bit words before they are collected: 2**(MOST_BITS - 6) at most."""
    h = hashes.distinct()
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(max(1, h.count()))) + 5))
    at = h.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words64 = at.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words64.column("word").to_numpy()] = words64.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _holds(batches):
    """Documents with the runs they may hold -> those they do: (doc_id, w, tokens)."""
    for b in batches:
        out = []
        for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
            t = words.tokens(text)
            out += [(doc, r["w"], r["tokens"]) for r in runs if " ".join(t[r["start"] : r["start"] + WINDOW]) == r["tokens"]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "w", "tokens"])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> (doc_id, item_id, windows): windows of the item that the document holds."""
    spark = documents.sparkSession
    parts = items.where("item_id is not null").select("item_id", "text").mapInArrow(_windows, "item_id long, w long, tokens string, off int, shingle long")
    windows = materialize(parts.distinct(), "windows")
    bitmaps = spark.sparkContext.broadcast((_bitmap(windows.select(F.col("shingle").alias("h"))), _bitmap(windows.select(F.col("w").alias("h")))))
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    hits = materialize(docs.mapInArrow(_hits(bitmaps), "doc_id long, pos long, shingle long, around array<long>"), "hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    order = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("shingle"), F.col("off")))
    prefix = windows.select("w", "tokens", "off", "shingle").distinct().join(rarity.hint("merge"), "shingle", "left").groupBy("w", "tokens").agg(order.alias("p")).where("p.df > 0").select("w", "tokens", "p.shingle", "p.off")
    near = hits.where(F.size("around") > 0).join(prefix.hint("merge"), "shingle").where(F.get("around", F.col("off")) == F.col("w"))
    near = materialize(near.select("doc_id", "w", "tokens", (F.col("pos") - F.col("off")).alias("start")).distinct(), "runs")
    discard(hits)
    per = near.groupBy("doc_id").agg(F.collect_list(F.struct("w", "tokens", "start")).alias("runs"))
    wanted = sift(docs.withColumn("_h", F.xxhash64("doc_id")), "_h", near.select(F.xxhash64("doc_id").alias("_h"))).drop("_h")
    held = wanted.join(per.hint("merge"), "doc_id").mapInArrow(_holds, "doc_id long, w long, tokens string").distinct()
    named = windows.select("w", "tokens", "item_id").distinct()
    return held.join(named.hint("merge"), ["w", "tokens"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
