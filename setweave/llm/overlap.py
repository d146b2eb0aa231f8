"""Overlap sizes between many large sets: bottom-k hash sketches.

Hashes are uniform in [0, 1). Sets are put in size classes c = 0, 1, .. by powers of four from k members on, and a
set of class c keeps, for every class a <= c that occurs, its smallest hashes: those up to 4**-a. At the class of
the smaller set of a pair both sketches reach as far as each other and hold k members or more (the whole set where
it has fewer), however far apart the sizes are.

The two sketches of a pair are merged: of the m smallest hashes of the union, the last being t, `shared` are in both.
(m - 1) / t estimates the size of the union, shared / m the shared fraction, and their product the intersection, with
a relative standard error of about 1 / sqrt(shared). What is merged is counted, not built: m and t follow from the
counts and last hashes of the two sketches and from `shared`. Where the sketches are the whole sets, all is exact.

Pairs come from an equi-join of sketch rows on the member. Members in very many sketches are taken in blocks, so no
task holds all pairs of one. Where only pairs sharing a given part of the smaller set are wanted, they are met
through the rarest members of its sketch alone, as many as cannot all be missing, and then counted in full.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.llm.similar_sets import node_pairs
from setweave.operators.skew import skew_join
from setweave.session import materialize

K = 512
#: Sketches holding a member that one block takes.
BLOCK = 1000
_UNIT = float(2**63)


def large_sets(edges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(sizes (u, n), rows (u, n, v, h)) of the sets with at least min_size distinct members; h is uniform in [0, 1)."""
    pairs = node_pairs(edges)
    sizes = materialize(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= min_size), "sizes")
    h = (F.xxhash64("v", F.lit(17)).bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(_UNIT)).alias("h")
    return sizes, skew_join(pairs, sizes, "u", sizes).select("u", "n", "v", h)


def _class(n, k: int):
    return F.greatest(F.lit(0), F.floor(F.log(n / k) / math.log(4) + 1e-9)).cast("int")


def sketches(sizes: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """Sketch rows (level, u, n, own, v, h): per set and level its members with h <= 4**-level; `own` marks the set's class."""
    levels = sorted(r.c for r in sizes.select(_class(F.col("n"), k).alias("c")).distinct().collect())  # at most log4 of the largest set
    level = F.explode(F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: (x <= F.col("c")) & (F.col("h") <= F.pow(F.lit(0.25), x)))) if levels else F.lit(0)
    s = rows.withColumn("c", _class(F.col("n"), k)).withColumn("level", level)
    return s.select("level", "u", "n", (F.col("level") == F.col("c")).alias("own"), "v", "h")


def estimates(sizes: DataFrame, rows: DataFrame, k: int = K, share: float = 0.0) -> DataFrame:
    """Pairs whose sketches share a member: (a, b, na, nb, shared, merged, union, intersection), a the smaller set.

    With `share` above 0 only the pairs that share at least that part of a's sketch are sure to be there.
    """
    s = materialize(sketches(sizes, rows, k), "sketches")
    per = s.groupBy("level", "u").agg(F.count("*").alias("m"), F.max("h").alias("t"))
    spread = s.groupBy("level", "v").agg(F.count("*").alias("d"))
    s = s.join(spread.where("d > 1").hint("merge"), ["level", "v"]).withColumn("blocks", F.ceil(F.col("d") / BLOCK).cast("int"))
    a = s.where("own").select("level", "v", "d", "blocks", F.col("u").alias("a"), F.col("n").alias("na"), F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block"))
    if share > 0:
        size = per.select("level", F.col("u").alias("a"), F.col("m").alias("ma"))
        a = a.join(size.hint("merge"), ["level", "a"]).withColumn("r", F.row_number().over(W.partitionBy("level", "a").orderBy("d", "v")))
        # Members in no other sketch are not in `a`, so the ranks of the rest begin behind them.
        held = F.count("*").over(W.partitionBy("level", "a"))
        a = a.withColumn("prefix", F.col("r") <= held - F.ceil(F.col("ma") * F.lit(share)) + 1)
    else:
        a = a.withColumn("prefix", F.lit(True))
    b = s.select("level", "v", F.col("u").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    keys = ["level", "a", "b", "na", "nb"]
    met = a.where("prefix").hint("merge").join(b, ["level", "v", "block"]).where(smaller).groupBy(*keys).agg(F.count("*").alias("shared"))
    if share > 0:
        met = materialize(met, "met")
        rest = met.select(*keys).join(a.where("not prefix").select("level", "a", "v").hint("merge"), ["level", "a"])
        more = rest.join(s.select("level", F.col("u").alias("b"), "v").hint("merge"), ["level", "b", "v"]).groupBy(*keys).agg(F.count("*").alias("shared"))
        met = met.unionByName(more).groupBy(*keys).agg(F.sum("shared").alias("shared"))
    x, y = per.toDF("level", "a", "ma", "ta"), per.toDF("level", "b", "mb", "tb")
    p = met.join(x.hint("merge"), ["level", "a"]).join(y.hint("merge"), ["level", "b"]).withColumn("merged", F.col("ma") + F.col("mb") - F.col("shared"))
    # At level 0 the sketches are the whole sets.
    union = F.when(F.col("level") == 0, F.col("merged").cast("double")).otherwise((F.col("merged") - 1) / F.greatest("ta", "tb"))
    p = p.withColumn("union", union).withColumn("intersection", F.col("shared") / F.col("merged") * F.col("union"))
    return p.select("a", "b", "na", "nb", "shared", "merged", "union", "intersection")


def strong(sizes: DataFrame, rows: DataFrame, share: float, k: int = K) -> DataFrame:
    """Pairs whose estimated intersection is at least `share` of the smaller set: (a, b, na, nb, intersection).

    Estimates within four standard errors of that limit are decided by the exact count instead, if there are any.
    """
    error = 4 / (share * k) ** 0.5
    e = estimates(sizes, rows, k, share * max(0.0, 1 - error)).withColumn("part", F.col("intersection") / F.col("na"))
    e = materialize(e.where(F.col("part") >= share * (1 - error)), "strong")
    exact = (F.col("merged") == F.col("union")) | (F.col("part") > share * (1 + error))
    sure = e.where(exact & (F.col("part") >= share)).select("a", "b", "na", "nb", "intersection")
    close = materialize(e.where(~exact).select("a", "b", "na", "nb"), "close")
    if close.isEmpty():
        return sure
    both = close.join(rows.select(F.col("u").alias("a"), "v").hint("merge"), "a").join(rows.select(F.col("u").alias("b"), "v").hint("merge"), ["b", "v"])
    counted = both.groupBy("a", "b", "na", "nb").agg(F.count("*").cast("double").alias("intersection"))
    return sure.unionByName(counted.where(F.col("intersection") / F.col("na") >= share))
