"""Per-node and per-block results of a skewed edge stream, and the keys that carry most of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators.skew import skew_join
from setweave.operators.tree import tree_aggregate
from setweave.session import materialize


def node_results(edges: DataFrame, fan_in: int = 8) -> DataFrame:
    """Per non-null u: rows, self loops, rows with null v, least and greatest v, first seen, last loaded."""
    e = edges.where("u is not null")
    states = {
        "n_rows": ("count", F.lit(1)),
        "self_loops": ("sum", F.when(F.col("u") == F.col("v"), 1).otherwise(0).cast("long")),
        "null_v": ("sum", F.when(F.col("v").isNull(), 1).otherwise(0).cast("long")),
        "min_v": ("min", F.col("v")),
        "max_v": ("max", F.col("v")),
        "first_seen": ("min", F.col("seen_at")),
        "last_loaded": ("max", F.col("loaded_at")),
    }
    return tree_aggregate(e, ["u"], states, fan_in)


def heavy_nodes(edges: DataFrame, share: float = 0.01, fan_in: int = 8) -> DataFrame:
    """Nodes u holding at least `share` of all delivered rows, those with null u included in the total: (u, n_rows)."""
    per = tree_aggregate(edges, ["u"], {"n_rows": ("count", F.lit(1))}, fan_in)
    total = per.agg(F.sum("n_rows").alias("_total"))
    return per.where("u is not null").join(F.broadcast(total), F.col("n_rows") >= F.col("_total") * F.lit(share)).select("u", "n_rows")


def block_bytes(blocks: DataFrame) -> DataFrame:
    """Bytes of each block: (shard, block_no, first_node, block_offset, bytes, shard_bytes).

    Block b reaches to the offset of block b + 1, found by an equi-join on the number, so no shard is gathered
    in one task. Repeated rows count once; rows with null shard, number or offset are no blocks; the closing
    row, and a block whose successor is missing, have no bytes and are left out.
    """
    b = blocks.where("shard is not null and block_no is not null and block_offset is not null")
    b = b.groupBy("shard", "block_no").agg(F.max("first_node").alias("first_node"), F.max("block_offset").alias("block_offset"))
    after = b.select("shard", (F.col("block_no") - 1).alias("block_no"), F.col("block_offset").alias("_next"))
    sized = b.join(after, ["shard", "block_no"]).withColumn("bytes", F.col("_next") - F.col("block_offset")).drop("_next")
    per = materialize(tree_aggregate(blocks.where("shard is not null"), ["shard"], {"shard_bytes": ("max", F.col("block_offset")), "n": ("count", F.lit(1))}), "shards")
    return skew_join(sized, per.select("shard", "shard_bytes"), "shard", per.select("shard", "n"))


def heavy_blocks(blocks: DataFrame, share: float = 0.05) -> DataFrame:
    """Blocks with at least `share` of their shard's bytes (its greatest block_offset)."""
    return block_bytes(blocks).where(F.col("bytes") >= F.col("shard_bytes") * F.lit(share)).where("shard_bytes > 0")


def block_results(edges: DataFrame, blocks: DataFrame, nodes_per_block: int = 256, fan_in: int = 8) -> DataFrame:
    """Per block of a shard: bytes and the pairs delivered for its nodes: (shard, block_no, bytes, n_pairs).

    A block without pairs has 0; pairs of nodes in no block are left out.
    """
    e = edges.where("u is not null and shard is not null").withColumn("first_node", F.col("u") - F.pmod("u", F.lit(nodes_per_block)))
    per = tree_aggregate(e, ["shard", "first_node"], {"n_pairs": ("count", F.lit(1))}, fan_in)
    b = block_bytes(blocks).where("first_node is not null")
    return b.join(per, ["shard", "first_node"], "left").select("shard", "block_no", "bytes", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))
