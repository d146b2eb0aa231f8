"""Edge cleaning, orientation, degrees and node numbering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.operators.order import global_index, prefix_sum


def undirected(raw: DataFrame, u: str, v: str) -> DataFrame:
    """Clean undirected edges (src < dst), each once: null ends, self loops and repeats dropped."""
    e = raw.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, deg) of undirected edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))


def degree_oriented(edges: DataFrame) -> DataFrame:
    """Edges from the end of lower (degree, id) to the higher: out-degrees stay below sqrt(2 m) on any graph."""
    d = degrees(edges)
    e = edges.join(d.toDF("src", "ds").hint("merge"), "src").join(d.toDF("dst", "dd").hint("merge"), "dst")
    forward = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def pruned_dag(edges: DataFrame) -> DataFrame:
    """Edges from higher degree rank to lower (rank by degree desc, id asc), nodes of degree below 2 cut in one pass."""
    d = degrees(edges).where("deg >= 2")
    e = edges.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    src_first = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    # a node keeps the neighbours ranked before it
    return e.select(F.when(src_first, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(src_first, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def vertex_rank(edges: DataFrame) -> DataFrame:
    """(node, deg, rank), rank from 0 by degree desc, id asc."""
    return global_index(degrees(edges), [F.desc("deg"), F.asc("node")], "rank")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(node, id) with ids 0.. in the order of nodes."""
    return global_index(degrees(edges).select("node"), [F.asc("node")], "id")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(node, deg, begin): where a node's neighbours begin in the column array of the symmetric graph."""
    return prefix_sum(degrees(edges), [F.asc("node")], "deg", "begin")


def coprime_step(n: int, step: int = 10007) -> int:
    """The first step from `step` on that shares no factor with n."""
    while math.gcd(step, max(n, 1)) != 1:
        step += 1
    return step


def permuted(ids: DataFrame, n: int, times: int = 1) -> DataFrame:
    """Adds `permuted`: ids dispersed over 0..n-1 by a step coprime to n, applied `times` times."""
    s = pow(coprime_step(n), times, max(n, 1))
    return ids.withColumn("permuted", F.pmod(F.col("id") * F.lit(s), F.lit(max(n, 1))))


def range_partition(node: Column, n: int, parts: int) -> Column:
    """Number of the node's range of 0..n-1 cut into parts."""
    return F.floor(node * parts / F.lit(n)).cast("long")


def plain_bucket(x: Column, length: Column) -> Column:
    return x.bitwiseAND(length - 1)


def hierarchical_bucket(x: Column, length: Column, longest: int) -> Column:
    """Bucket by high bits of x mod longest; both lengths are powers of two."""
    return F.floor(F.pmod(x, F.lit(longest)) / (F.lit(longest) / length)).cast("long")


def table_length(deg: Column, load: float, bucket: int) -> Column:
    """Buckets of a set's table: the power of two strictly above deg / load / bucket, at least 8."""
    return F.greatest(F.lit(8), F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1), F.floor(deg / load / bucket)))) + 1)).cast("long")


def edge_key(u: Column, v: Column) -> Column:
    """The unordered pair as one number."""
    return F.shiftleft(F.least(u, v), 32).bitwiseOR(F.greatest(u, v))
