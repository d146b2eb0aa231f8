"""What the bucketed layouts of sets would cost: displaced keys, segment order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def displacement(filled: DataFrame, slots: int) -> DataFrame:
    """filled (set, len, bucket, n): keys per occupied bucket of tables of len buckets -> (set, displaced).

    A key beyond its bucket's slots moves to the next bucket, round the end; `displaced` counts all such moves, which
    do not depend on the order of insertion. Occupied buckets are folded twice over: the first lap brings the carry
    that enters bucket 0, the second is counted; runs of empty buckets are summed in closed form. A table without
    room for its keys never settles and is counted as after one lap.
    """
    per = filled.groupBy("set", "len").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    twice = F.concat(F.transform("b", lambda x: F.struct(x["bucket"].cast("long").alias("at"), x["n"].cast("long").alias("n"))), F.transform("b", lambda x: F.struct((x["bucket"] + F.col("len")).cast("long").alias("at"), x["n"].cast("long").alias("n"))))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("total"))

    def step(s, x):
        gap = x["at"] - s["at"] - 1
        # Empty bucket t of the gap passes on carry - t * slots while that is positive.
        m = F.least(gap, F.greatest(F.lit(0), F.ceil(s["carry"] / slots) - 1)).cast("long")
        moved = m * s["carry"] - slots * F.floor(m * (m + 1) / 2).cast("long")
        out = F.greatest(F.lit(0), F.greatest(F.lit(0), s["carry"] - gap * slots) + x["n"] - slots).cast("long")
        counted = F.when(x["at"] >= F.col("len"), moved + out).otherwise(F.lit(0))
        return F.struct(x["at"].alias("at"), out.alias("carry"), (s["total"] + counted).cast("long").alias("total"))

    return per.select("set", F.aggregate(twice, start, step)["total"].alias("displaced"))


def segment_order(members: DataFrame, longest: int) -> DataFrame:
    """members (set, elem) -> (set, elem, place): place in the set ordered by elem mod longest, then elem.

    Sets are ordered as arrays; a window would hold the same rows.
    """
    key = F.struct(F.pmod("elem", F.lit(longest)).alias("segment"), F.col("elem").alias("elem"))
    per = members.groupBy("set").agg(F.sort_array(F.collect_list(key)).alias("s"))
    return per.select("set", F.posexplode("s").alias("place", "e")).select("set", "e.elem", F.col("place").cast("long").alias("place"))
