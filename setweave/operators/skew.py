"""Joins and running sums that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def heavy_keys(counts: DataFrame, key: str, n: str = "n", share: float = 0.01) -> DataFrame:
    """Keys holding at least `share` of all rows: at most 1/share of them, whatever the data."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.join(F.broadcast(total), F.col(n) >= F.col("_total") * F.lit(share)).select(key, n)


def skew_join(rows: DataFrame, per_key: DataFrame, key: str, counts: DataFrame, how: str = "inner", share: float = 0.01) -> DataFrame:
    """rows join per_key (one row a key) on `key`, where a few keys may hold most rows.

    Keys with at least `share` of the rows, at most 1/share, are joined by broadcast where they lie; only the
    rest is shuffled, by a sort-merge join, whose partitions AQE splits where one is still large. counts: (key, n)
    over rows. Null keys never join (left: kept).
    """
    hot = heavy_keys(counts.where(F.col(key).isNotNull()), key, share=share).select(key, F.lit(True).alias("_hot"))
    hot_side = per_key.join(F.broadcast(hot), key)
    keyed = rows.join(F.broadcast(hot), key, "left")
    a = keyed.where("_hot").drop("_hot").join(F.broadcast(hot_side.drop("_hot")), key, how)
    b = keyed.where("_hot is null").drop("_hot").join(per_key.join(F.broadcast(hot), key, "left_anti").hint("merge"), key, how)
    return a.unionByName(b)


def running_sum(rows: DataFrame, group: list[str], order: str, value: str, out: str, buckets: int) -> DataFrame:
    """Exclusive running sum of `value` per group in the order of `order`, a uniform 64-bit hash.

    A group is cut into `buckets` ranges of the hash; each range is summed in its own task and the ranges'
    totals (groups x buckets rows) give its start. No task holds a whole group. Equal hashes follow one
    another in any order.
    """
    share = F.col(order).cast("double") / F.lit(float(2**64)) + 0.5
    b = rows.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int")))
    totals = b.groupBy(*group, "_b").agg(F.sum(value).alias("_t"))
    starts = totals.withColumn("_s", F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_t")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return b.withColumn("_i", inside).join(starts, [*group, "_b"]).withColumn(out, F.col("_s") + F.col("_i")).drop("_b", "_s", "_i")


def sift(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 22) -> DataFrame:
    """The rows whose 64-bit `key` may be among `wanted` (one column of the same name), dropped before any shuffle.

    A bitmap of 2**bits bits, whatever the number of keys, is broadcast as at most 2**(bits - 6) words. It lets
    every wanted row pass and few others; the join that follows decides.
    """
    at = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    w = wanted.select(at(F.col(key)).alias("_at"))
    words = w.groupBy(F.shiftrightunsigned("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
    tagged = rows.withColumn("_at", at(F.col(key))).withColumn("_word", F.shiftrightunsigned("_at", 6))
    kept = tagged.join(F.broadcast(words), "_word").where(F.expr("(shiftrightunsigned(_bits, cast(_at & 63 as int)) & 1) = 1"))
    return kept.drop("_at", "_word", "_bits")
