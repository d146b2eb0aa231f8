"""Queries on skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import heavy
from setweave.session import tune


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{d}/{table}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with 1 % of all rows or more and blocks with 5 % of their shard's bytes or more."""
    u = heavy.heavy_nodes(_read(spark, d, "edge_pairs")).select(F.lit("u").alias("kind"), F.lit("all").alias("shard"), F.col("u").alias("id"))
    b = heavy.heavy_blocks(_read(spark, d, "bcsr_blocks")).select(F.lit("block").alias("kind"), "shard", F.col("block_no").cast("long").alias("id"))
    return u.unionByName(b)


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Results of every node."""
    return heavy.node_results(_read(spark, d, "edge_pairs"))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and pairs of every block."""
    return heavy.block_results(_read(spark, d, "edge_pairs"), _read(spark, d, "bcsr_blocks"))


_BLOCKS = """b as (select shard, block_no, max(first_node) as first_node, max(block_offset) as o from bcsr_blocks
  where shard is not null and block_no is not null and block_offset is not null group by 1, 2),
 s as (select shard, max(block_offset) as t from bcsr_blocks group by 1),
 z as (select b.shard, b.block_no, b.first_node, n.o - b.o as bytes, s.t from b join b n on n.shard = b.shard and n.block_no = b.block_no + 1
  join s on s.shard = b.shard)"""

SQL = {
    "p3_found": f"""with {_BLOCKS} select 'u' as kind, 'all' as shard, u as id from edge_pairs where u is not null group by u
  having count(*) >= 0.01 * (select count(*) from edge_pairs)
 union all select 'block', shard, block_no::bigint from z where t > 0 and bytes >= 0.05 * t""",
    "p3_nodes": """select u, count(*) as n_rows, (count(*) filter (u = v))::bigint as self_loops, (count(*) filter (v is null))::bigint as null_v,
  min(v) as min_v, max(v) as max_v, min(seen_at) as first_seen, max(loaded_at) as last_loaded from edge_pairs where u is not null group by u""",
    "p3_blocks": f"""with {_BLOCKS}, e as (select shard, u - u % 256 as first_node, count(*) as n from edge_pairs where u is not null and shard is not null group by 1, 2)
 select z.shard, z.block_no, z.bytes, coalesce(e.n, 0)::bigint as n_pairs from z left join e using (shard, first_node) where z.first_node is not null""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_nodes, p3_blocks)}
