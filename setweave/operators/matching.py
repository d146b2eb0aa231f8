"""Subgraph matching from pattern tables: any pattern, level by level.

A pattern lists, per level, the earlier levels its node must be adjacent to. -1 stands for the candidates of the
level that `reuse` names, which are carried along instead of intersected again. A restriction r asks for a smaller
id than the node at level r, which breaks symmetry. Each level is a join with neighbour lists and an array
intersection; the last level is counted, not built.

The closed forms of operators.patterns are faster for the nine standard patterns; this runs all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.operators.graph import degree_oriented, symmetric
from setweave.session import materialize


@dataclass(frozen=True)
class Pattern:
    """`orders` and `offsets`: levels 1.. need orders[offsets[L - 1] : offsets[L]]. `oriented` matches along the
    degree orientation (cliques, each once); `distinct` asks for nodes not used before, where adjacency does not."""

    orders: Sequence[int]
    offsets: Sequence[int]
    restriction: Sequence[int] = ()
    reuse: Sequence[int] = ()
    oriented: bool = False
    distinct: bool = False

    @property
    def levels(self) -> int:
        return len(self.offsets)

    def needs(self, level: int) -> list[int]:
        return list(self.orders[self.offsets[level - 1] : self.offsets[level]])

    def limit(self, level: int) -> int:
        return self.restriction[level] if self.restriction else -1

    def check(self) -> None:
        for level in range(1, self.levels):
            needs = self.needs(level)
            if not needs or any(x >= level or x < -1 for x in needs) or (-1 in needs and not (self.reuse and 0 < self.reuse[level] < level)) or self.limit(level) >= level:
                raise ValueError(f"level {level} of the pattern asks for levels that come later, or for none")


#: The tables of the nine standard patterns.
PATTERNS = {
    "Q0": Pattern([0, 0, 1], [0, 1, 3], oriented=True),
    "Q1": Pattern([0, 0, 1, 2], [0, 1, 2, 4], [-1, 0, 1, 0], distinct=True),
    "Q2": Pattern([0, 0, 1, 1, 2], [0, 1, 3, 5], [-1, -1, 1, 0], distinct=True),
    "Q3": Pattern([0, 0, 1, -1, 2], [0, 1, 3, 5], reuse=[-1, -1, -1, 2], oriented=True),
    "Q4": Pattern([0, 0, 1, -1, 2, -1], [0, 1, 3, 5, 6], [-1, 0, -1, 2, -1], [-1, -1, -1, 2, 2], distinct=True),
    "Q5": Pattern([0, 0, 1, -1, 2, -1, 3], [0, 1, 3, 5, 7], reuse=[-1, -1, -1, 2, 3], oriented=True),
    "Q6": Pattern([0, 0, 1, -1, 2, 3], [0, 1, 3, 4, 6], [-1, 0, -1, 2, -1], [-1, -1, -1, 2, -1], distinct=True),
    "Q7": Pattern([0, 0, 1, -1, 2, -1, 3, -1, 4], [0, 1, 3, 5, 7, 9], reuse=[-1, -1, -1, 2, 3, 4], oriented=True),
    "Q8": Pattern([0, 0, 1, -1, 2, -1], [0, 1, 3, 5, 6], [-1, 0, -1, -1, 3], [-1, -1, -1, 2, 3], distinct=True),
}


def violates(item: Column, mapping: Sequence[Column], limit: int, distinct: bool) -> Column:
    """Whether a candidate breaks the order against mapping[limit], or repeats a node of the mapping."""
    bad = [item >= mapping[limit]] if limit >= 0 else []
    bad += [item == m for m in mapping] if distinct else []
    return reduce(lambda a, b: a | b, bad) if bad else F.lit(False)


def _matched(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows v0..v{k-2} with `last`, the candidates of the last level."""
    pattern.check()
    lines = degree_oriented(edges) if pattern.oriented else symmetric(edges)
    adjacency = materialize(lines.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")), "adjacency")
    rows, kept = adjacency.select(F.col("node").alias("v0")), {}
    for level in range(1, pattern.levels):
        needs = pattern.needs(level)
        lists = [kept[pattern.reuse[level]]] if -1 in needs else []
        # The latest node first: of an oriented graph it drops rows before they carry a list.
        for x in sorted((x for x in needs if x >= 0), reverse=True):
            rows = rows.join(adjacency.select(F.col("node").alias(f"v{x}"), F.col("nbrs").alias(f"n{x}")).hint("merge"), f"v{x}")
            lists.append(f"n{x}")
        raw = reduce(lambda a, b: F.array_intersect(a, b), (F.col(c) for c in lists))
        mapping = [F.col(f"v{i}") for i in range(level)]
        # What a later level reuses is the intersection, before this level's own restriction.
        later = level in pattern.reuse
        chosen = F.filter(f"c{level}", lambda i: ~violates(i, mapping, pattern.limit(level), pattern.distinct))
        rows = rows.withColumn(f"c{level}", raw).withColumn("last", chosen).where(F.size("last") > 0)
        kept |= {level: f"c{level}"} if later else {}
        columns = [f"v{i}" for i in range(level)] + [c for at, c in kept.items() if at in pattern.reuse[level + 1 :]]
        rows = rows.select(*columns, "last" if level == pattern.levels - 1 else F.explode("last").alias(f"v{level}"))
    return rows


def match_count(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """One row: n, the matches of the pattern in undirected edges (src, dst). Not induced; no edges give 0."""
    return _matched(edges, pattern).agg(F.coalesce(F.sum(F.size("last").cast("long")), F.lit(0)).cast("long").alias("n"))


def match_rows(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """Every match: v0..v{k-1}."""
    k = pattern.levels
    return _matched(edges, pattern).select(*(f"v{i}" for i in range(k - 1)), F.explode("last").alias(f"v{k - 1}"))
