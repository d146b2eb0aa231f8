"""Triangles, neighbourhood similarity and small patterns.

Cliques grow along degree-oriented out-neighbour arrays: a partial clique carries the common out-neighbours of its
members, so each level is one join and one array intersection, and the last level is only counted. The other
patterns are closed forms over edges, triangles and 4-cliques.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators.graph import degree_oriented, degrees, symmetric, vertex_rank
from setweave.session import discard, materialize

#: Entries of neighbour lists that may be sent at once, in all or an edge, about 2 bytes each on disk.
PASS, EDGE = 1 << 26, 6


def out_neighbours(oriented: DataFrame) -> DataFrame:
    """(node, nbrs), at most sqrt(2 m) long when oriented by degree."""
    return oriented.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def _in_passes(o: DataFrame, adj: DataFrame, length, take) -> DataFrame:
    """take(p, q, turned, x, y) over the oriented edges whose ends both have lists in adj (node, nbrs), as a union of passes.

    The end with the shorter list, p, sends it to the other, q; p is the edge's source, or its target where turned. The
    lists sent at once are bounded by PASS entries or EDGE an edge: else what take gives is written pass by pass.
    """
    n = adj.select("node", length.alias("n"))
    e = o.join(n.toDF("src", "n0").hint("merge"), "src").join(n.toDF("dst", "n1").hint("merge"), "dst").where("n0 > 1")
    turned = F.col("n1") < F.col("n0")
    ends = F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("p"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("q")
    e = materialize(e.select(*ends, turned.alias("turned"), F.least("n0", "n1").alias("n")), "meetings")
    sent = e.agg(F.count("*").alias("edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).first()
    passes = max(1, -(-sent.entries // max(PASS, EDGE * sent.edges)))
    out = None
    for k in range(passes):
        mine = e.select("p", "q", "turned").where(F.pmod(F.xxhash64("q"), F.lit(passes)) == k)
        met = mine.join(adj.toDF("p", "x").hint("merge"), "p").join(adj.toDF("q", "y").where(F.pmod(F.xxhash64("q"), F.lit(passes)) == k).hint("merge"), "q")
        part = take(met)
        part = materialize(part, "pass") if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def cliques(edges: DataFrame, k: int, take=lambda c: c) -> DataFrame:
    """take of partial cliques (v0..v{k-2}, common): each element of common completes a k-clique; k >= 3.

    take is applied pass by pass, and the results are put together.
    """
    o = materialize(degree_oriented(edges), "oriented")
    adj = materialize(out_neighbours(o), "adjacency")

    def grow(met: DataFrame) -> DataFrame:
        first = F.when(F.col("turned"), F.col("q")).otherwise(F.col("p")).alias("v0"), F.when(F.col("turned"), F.col("p")).otherwise(F.col("q")).alias("v1")
        c = met.select(*first, F.array_intersect("x", "y").alias("common"))
        for level in range(2, k - 1):
            kept = [f"v{i}" for i in range(level + 1)]
            # The outer form lets no filter repeat the intersection below it.
            c = c.select(*kept[:-1], F.explode_outer("common").alias(kept[-1]), "common").where(F.col(kept[-1]).isNotNull())
            step = adj.select(F.col("node").alias(kept[-1]), F.col("nbrs").alias("_n"))
            c = c.join(step.hint("merge"), kept[-1]).select(*kept, F.array_intersect("common", "_n").alias("common"))
        return take(c)

    out = _in_passes(o, adj, F.size("nbrs"), grow)
    discard(o)
    return out


def clique_count(edges: DataFrame, k: int) -> DataFrame:
    n = cliques(edges, k, lambda c: c.agg(F.sum(F.size("common").cast("long")).alias("n")))
    return _total(n, F.col("n"))


def clique_rows(edges: DataFrame, k: int) -> DataFrame:
    """Every k-clique once: v0..v{k-1}."""
    last = f"v{k - 1}"
    return cliques(edges, k, lambda c: c.select(*(f"v{i}" for i in range(k - 1)), F.explode_outer("common").alias(last)).where(F.col(last).isNotNull()))


def support(edges: DataFrame) -> DataFrame:
    """(src, dst, shared) of edges in triangles: the common neighbours of the ends."""
    t = clique_rows(edges, 3)
    sides = F.explode(F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "v2"))))).alias("e")
    return t.select(sides).select("e.src", "e.dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def triangles_per_node(edges: DataFrame) -> DataFrame:
    t = clique_rows(edges, 3)
    return t.select(F.explode(F.array("v0", "v1", "v2")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def triangles_partitioned(edges: DataFrame, parts: int) -> DataFrame:
    """Triangles by partition of their closing node, node mod parts: (part, n), each from the partition's lists alone.

    A partition holds of every out-neighbour list the nodes that fall to it; partial counts add up to the whole.
    """
    o = materialize(degree_oriented(edges), "oriented")
    lists = o.groupBy(F.col("src").alias("node"), F.pmod("dst", F.lit(parts)).alias("part")).agg(F.collect_list("dst").alias("nbrs"))
    lists = materialize(lists, "lists")
    x, y = lists.toDF("src", "part", "x").hint("merge"), lists.toDF("dst", "part", "y").hint("merge")
    n = F.size(F.array_intersect("x", "y")).cast("long")
    # Targets first: those without out-neighbours drop their edges.
    return o.join(y, "dst").join(x, ["src", "part"]).groupBy("part").agg(F.sum(n).alias("n"))


def similar_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges whose ends' neighbourhoods have Jaccard >= threshold: (src, dst, shared, union_size)."""
    d = degrees(edges)
    s = support(edges).join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    s = s.select("src", "dst", "shared", (F.col("ds") + F.col("dd") - F.col("shared")).alias("union_size"))
    return s.where(F.col("shared") / F.col("union_size") >= threshold)


def similar_edges_partitioned(edges: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The same from partial counts per partition of the shared neighbour, found by oriented triangles."""
    t = clique_rows(edges, 3)
    sides = (("v0", "v1", "v2"), ("v0", "v2", "v1"), ("v1", "v2", "v0"))
    e = F.explode(F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.pmod(c, F.lit(parts)).alias("part")) for a, b, c in sides))).alias("e")
    partial = t.select(e).groupBy("e.src", "e.dst", "e.part").agg(F.count("*").alias("c"))
    d = degrees(edges)
    s = partial.groupBy("src", "dst").agg(F.sum("c").alias("shared")).join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    s = s.select("src", "dst", "shared", (F.col("ds") + F.col("dd") - F.col("shared")).alias("union_size"))
    return s.where(F.col("shared") / F.col("union_size") >= threshold)


def ranked_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges between ranks, from the end of lower degree to the higher: (src, dst) with src > dst."""
    r = ranks.select("node", "rank")
    e = edges.join(r.toDF("src", "a").hint("merge"), "src").join(r.toDF("dst", "b").hint("merge"), "dst")
    return e.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))


def bitmaps(ranked: DataFrame) -> DataFrame:
    """Sparse bitmaps of out-neighbours: (node, nbrs), words in order and their bits, one bit a rank; frequent neighbours share words."""
    bit = F.expr("shiftleft(1L, cast(dst & 63 as int))")
    w = ranked.repartition("src").groupBy("src", F.shiftrightunsigned("dst", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    w = w.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return w.select("node", F.struct(F.col("w.word").alias("word"), F.col("w.bits").alias("bits")).alias("nbrs"))


def _shared_bits(met: DataFrame) -> DataFrame:
    """(a, b, n) of edges between ranks, a > b, from met (p, q, x, y): each bit in both bitmaps closes a triangle of three edges."""

    def run(batches):
        for t in batches:
            p, q = t.column(0).to_numpy(), t.column(1).to_numpy()
            (px, wx, bx), (py, wy, by) = ((c.offsets.to_numpy(), c.flatten().to_numpy(), d.flatten().to_numpy()) for c, d in ((t.column(i), t.column(i + 1)) for i in (2, 4)))
            if not len(wx) or not len(wy):
                continue
            # Numbers of row and word, both in order.
            top = int(max(wx.max(), wy.max())) + 1
            row = np.repeat(np.arange(len(p)), np.diff(px))
            key, other = row * top + wx, np.repeat(np.arange(len(p)), np.diff(py)) * top + wy
            at = np.minimum(np.searchsorted(other, key), len(other) - 1)
            hit = np.flatnonzero(other[at] == key)
            bits = bx[hit] & by[at[hit]]
            hit, bits = hit[bits != 0], bits[bits != 0]
            total = np.zeros(len(p), np.int64)
            np.add.at(total, row[hit], np.bitwise_count(bits.view(np.uint64)))
            some = np.flatnonzero(total)
            if len(some):
                yield _counted(np.maximum(p, q)[some], np.minimum(p, q)[some], total[some])
            for i in range(0, len(hit), 1 << 14):
                h = hit[i : i + (1 << 14)]
                w, bit = np.nonzero(np.unpackbits(bits[i : i + (1 << 14)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                third, r = wx[h[w]] * 64 + bit, row[h[w]]
                for end in (p, q):
                    yield _counted(end[r], third, np.ones(len(r), np.int64))

    flat = met.select("p", "q", "x.word", "x.bits", F.col("y.word").alias("word2"), F.col("y.bits").alias("bits2"))
    return flat.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


def support_by_bitmap(edges: DataFrame) -> DataFrame:
    """The same as support, from intersected bitmaps of out-neighbours; the end with fewer words sends them, in passes."""
    ranks = materialize(vertex_rank(edges), "ranks")
    o = materialize(ranked_edges(edges, ranks), "ranked")
    # A word and its bits take the room of four entries of a list.
    s = _in_passes(o, materialize(bitmaps(o), "bitmap"), 4 * F.size("nbrs.word"), _shared_bits)
    discard(o)
    s = s.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    r = ranks.select("rank", "node")
    s = s.join(r.toDF("a", "u").hint("merge"), "a").join(r.toDF("b", "v").hint("merge"), "b")
    return s.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "shared")


def _choose2(c):
    return F.expr(f"{c} * ({c} - 1) div 2")


def _total(df: DataFrame, value) -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("n"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """Q1: per cycle one node is the highest by (degree, id); wedges from it over a lower node to a lower one, C(wedges, 2) a pair of ends.

    A middle node meets its higher neighbours only, at most sqrt(2 m) of them, so hubs make no square of wedges.
    """
    o = materialize(degree_oriented(edges), "oriented")
    d = degrees(edges)
    up = o.join(d.toDF("dst", "dt"), "dst").select(F.col("src").alias("mid"), F.col("dst").alias("top"), "dt")
    n = symmetric(edges).join(d.toDF("dst", "de"), "dst").select(F.col("src").alias("mid"), F.col("dst").alias("end"), "de")
    lower = (F.col("de") < F.col("dt")) | ((F.col("de") == F.col("dt")) & (F.col("end") < F.col("top")))
    pairs = up.join(n, "mid").where(lower).groupBy("top", "end").agg(F.count("*").alias("c"))
    return _total(pairs, _choose2("c"))


def diamonds(edges: DataFrame) -> DataFrame:
    """Q2: sum over edges of C(common neighbours, 2)."""
    return _total(support(edges), _choose2("shared"))


def _sides(k4: DataFrame) -> DataFrame:
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    e = F.explode(F.array(*(F.struct(F.least(f"v{i}", f"v{j}").alias("src"), F.greatest(f"v{i}", f"v{j}").alias("dst")) for i, j in pairs))).alias("e")
    return k4.select(e).select("e.src", "e.dst")


def k4_with_triangle(edges: DataFrame) -> DataFrame:
    """Q4: sum over edges of (4-cliques on the edge) * (common neighbours - 2)."""
    per = _sides(clique_rows(edges, 4)).groupBy("src", "dst").agg(F.count("*").alias("k"))
    return _total(per.join(support(edges), ["src", "dst"]), F.expr("k * (shared - 2)"))


def k23_with_edge(edges: DataFrame) -> DataFrame:
    """Q6: sum over node pairs of (edges among common neighbours) * (common neighbours - 2)."""
    t = clique_rows(edges, 3)
    apex = F.explode(F.array(*(F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col(c).alias("p")) for a, b, c in (("v0", "v1", "v2"), ("v0", "v2", "v1"), ("v1", "v2", "v0"))))).alias("e")
    a = materialize(t.select(apex).select("e.x", "e.y", "e.p"), "apexes")
    inner = a.join(a.toDF("x", "y", "q"), ["x", "y"]).where("p < q").groupBy("p", "q").agg(F.count("*").alias("e"))
    # Of a pair, the neighbours of the end that has fewer are listed and looked up at the other.
    n, d = symmetric(edges), degrees(edges)
    inner = inner.join(d.toDF("p", "dp"), "p").join(d.toDF("q", "dq"), "q")
    turn = F.col("dp") > F.col("dq")
    inner = inner.select(F.when(turn, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(turn, F.col("p")).otherwise(F.col("q")).alias("q"), "e")
    common = inner.join(n.toDF("p", "w"), "p").join(n.toDF("q", "w"), ["q", "w"]).groupBy("p", "q", "e").agg(F.count("*").alias("c"))
    return _total(common, F.expr("e * (c - 2)"))


def k5_minus_edge(edges: DataFrame) -> DataFrame:
    """Q8: (n, distinct_count): three times, and once, the sum over triangles of C(common neighbours, 2)."""
    k4 = clique_rows(edges, 4)
    faces = F.explode(F.array(*(F.sort_array(F.array(*(f"v{i}" for i in range(4) if i != j))) for j in range(4)))).alias("t")
    per = k4.select(faces).groupBy("t").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum(_choose2("c")), F.lit(0)).cast("long").alias("distinct_count")).select((F.col("distinct_count") * 3).alias("n"), "distinct_count")
