"""Pairwise operations on set families (set_id, elem)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators.graph import table_length
from setweave.session import discard, materialize

#: Meetings of sets at shared members that may be sent at once, in all or a member, about 10 bytes each on disk.
PASS, MEMBER = 1 << 25, 2


def pair_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) -> sizes, shared, united and the members of a alone; sets without members count as empty."""
    s = sets.select("set_id", "elem").where("set_id is not null and elem is not null").distinct()
    n = s.groupBy("set_id").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").distinct()
    hit = p.join(s.toDF("a", "x"), "a").join(s.toDF("b", "x"), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = p.join(hit, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left").fillna(0, ["shared", "na", "nb"])
    return j.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("united"), (F.col("na") - F.col("shared")).alias("only_a"))


def group_pair_counts(groups: DataFrame, sets: DataFrame, salts: int = 16) -> DataFrame:
    """pair_counts of all pairs a < b of sets of one group; groups (set_id, group).

    Sets of a group meet at the members they share, so no pair lists its members. Pairs are built in salts x groups
    cells, which a few large groups fill evenly. Steps are written, so the shuffle files of one step only are held;
    meetings go in passes over the first set, bounded by PASS or MEMBER a member.
    """
    spark = groups.sparkSession
    s = sets.select("set_id", "elem").where("set_id is not null and elem is not null").distinct()
    g = groups.toDF("set_id", "k").where("set_id is not null and k is not null").groupBy("set_id").agg(F.collect_set("k").alias("ks"))
    # A pair that shares several groups is built in the least of them; `ks` is null for sets of one group.
    g = g.select("set_id", F.explode("ks").alias("k"), F.when(F.size("ks") > 1, F.col("ks")).alias("ks"))
    once = F.expr("a < b and (ka is null or kb is null or k = array_min(array_intersect(ka, kb)))")
    inside = materialize(s.join(g.hint("merge"), "set_id").select("set_id", "k", "elem", "ks"), "inside")
    g = g.join(inside.groupBy("set_id", "k").agg(F.count("*").alias("n")), ["set_id", "k"], "left").fillna(0, ["n"]).select("set_id", "k", "ks", "n")
    g = materialize(g, "groups")
    at = inside.groupBy("elem", "k").agg(F.count("*").alias("n"))
    sent = at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("meetings")).first()
    passes = max(1, -(-sent.meetings // max(PASS, MEMBER * sent.members)))
    hit = None
    for i in range(passes):
        mine = inside.where(F.pmod(F.xxhash64("set_id"), F.lit(passes)) == i)
        met = mine.toDF("a", "k", "elem", "ka").join(inside.toDF("b", "k", "elem", "kb").hint("merge"), ["elem", "k"]).where(once)
        part = materialize(met.groupBy("a", "b").agg(F.count("*").alias("shared")), "shared")
        hit = part if hit is None else hit.unionByName(part)
    discard(inside)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = g.toDF("a", "k", "ka", "na").withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    y = g.toDF("b", "k", "kb", "nb").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = x.repartition(n, "k", "_s").join(y.repartition(n, "k", "_s").hint("merge"), ["k", "_s"]).where(once).select("a", "b", "na", "nb")
    j = p.join(hit, ["a", "b"], "left").fillna(0, ["shared"])
    return j.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("united"), (F.col("na") - F.col("shared")).alias("only_a"))


def members_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (elem), repeats kept, whose element is in right (elem)."""
    return left.join(right.select("elem").distinct(), "elem", "left_semi")


def random_sets(spark, sets: int, size: int, top: int, seed: int = 1) -> DataFrame:
    """(set_id, elem): uniform elements in 0..top."""
    r = spark.range(sets * size).withColumn("elem", F.floor(F.rand(seed) * (top + 1)).cast("long"))
    return r.select(F.floor(F.col("id") / size).cast("long").alias("set_id"), "elem")


def insert(members: DataFrame, new: DataFrame) -> DataFrame:
    """(set_id, elem) of both, each once; null sets and elements are none."""
    both = members.select("set_id", "elem").unionByName(new.select("set_id", "elem"))
    return both.where("set_id is not null and elem is not null").distinct()


def remove(members: DataFrame, gone: DataFrame) -> DataFrame:
    """(set_id, elem) of members without those in gone."""
    return insert(members, members.limit(0)).join(gone.select("set_id", "elem"), ["set_id", "elem"], "left_anti")


def contains(members: DataFrame, asked: DataFrame) -> DataFrame:
    """(set_id, elem, found) of every row asked for, repeats kept."""
    m = insert(members, members.limit(0)).withColumn("_in", F.lit(True))
    return asked.select("set_id", "elem").join(m, ["set_id", "elem"], "left").select("set_id", "elem", F.coalesce("_in", F.lit(False)).alias("found"))


def fill(members: DataFrame, load: float, bucket: int) -> DataFrame:
    """(set_id, size, capacity, load_factor) of the bucketed tables that would hold the sets."""
    n = insert(members, members.limit(0)).groupBy("set_id").agg(F.count("*").alias("size"))
    capacity = (table_length(F.col("size"), load, bucket) * bucket).alias("capacity")
    return n.select("set_id", "size", capacity, (F.col("size") / capacity).alias("load_factor"))
