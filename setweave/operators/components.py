"""Connected components by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators.skew import skew_join
from setweave.session import drop_path, materialize, table_path


#: Edges (16 bytes each) that one task finishes by union-find instead of further rounds; the result is the same.
FEW = 1 << 20


def _union_find(batches):
    """All edges (u, v) with u > v -> (u, v) with v the least node of u's component, u > v."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    root = np.array(parent)
    while (root[root] != root).any():
        root = root[root]
    inner = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], names=["u", "v"])


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star; e holds (u, v) with u > v. The hub of a component, on whom most edges hang, is joined by broadcast."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    star = skew_join(both, low.select("u", "m"), "u", low.select("u", "n"))
    large = star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(star.where("v < u").select("u", F.col("m").alias("v")))
    large = large.distinct()
    least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    small = skew_join(large, least.select("u", "m"), "u", least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """edges (a, b) of long ids -> (node, root) for every node with an edge; root is the component's least node.

    Edges that fit one task, at most `few`, are finished there. Rounds grow with the logarithm of the longest path. Each round is a table in the shared folder, so lineage
    stays short and a lost executor costs only its tasks. Null ends and self loops are ignored; no rows, no result.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, path = None, None
    for _ in range(max_rounds):
        new = table_path(spark, "components")
        e.write.parquet(new)
        if path:
            drop_path(spark, path)
        path = new
        e = spark.read.schema("u long, v long").parquet(path)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            break
        if now[0] <= few:
            e = materialize(e.coalesce(1).mapInArrow(_union_find, "u long, v long"), "components")
            break
        seen, e = now, _round(e)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
