"""Per-key aggregation through a tree of bounded fan-in.

A chunk is one input split, whose size spark.sql.files.maxPartitionBytes fixes. Every chunk is combined where it
is read (the map side of the first round); each further round merges `fan_in` neighbouring groups of chunks, so
after log(chunks) rounds a key has one state, and no task ever receives more than fan_in states of a key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How partial states merge: the aggregate of the first round, then that of the following ones.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def rounds(chunks: int, fan_in: int) -> int:
    """Merge rounds until one group is left."""
    r, groups = 1, -(-chunks // fan_in)
    while groups > 1:
        r, groups = r + 1, -(-groups // fan_in)
    return r


def tree_aggregate(rows: DataFrame, keys: list[str], states: Mapping[str, tuple[str, Column]], fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """One row a key: keys and states. states: name -> (count|sum|min|max, value).

    Null keys form a key of their own, as in GROUP BY; null values are skipped; no rows give no result. Columns of
    `rows` other than keys may carry any name, those of states and `_chunk` included.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    # Asked of the plan: no job runs for a plain scan, nor for anything without a sort or a broadcast.
    chunks = chunks or max(1, rows._jdf.queryExecution().toRdd().getNumPartitions())
    taken = rows.select(*keys, *(v.alias(f"_v{i}") for i, (_, v) in enumerate(states.values())), F.spark_partition_id().alias("_chunk"))
    n = rounds(chunks, fan_in)
    width = 1
    for r in range(n):
        width *= fan_in
        group = [*keys] if r == n - 1 else [*keys, F.floor(F.col("_chunk") / fan_in).cast("int").alias("_chunk")]
        how = [(_FIRST if r == 0 else MERGE)[kind](F.col(f"_v{i}")).alias(f"_v{i}") for i, (kind, _) in enumerate(states.values())]
        taken = taken.groupBy(*group).agg(*how)
    return taken.select(*keys, *(F.col(f"_v{i}").alias(name) for i, name in enumerate(states)))
