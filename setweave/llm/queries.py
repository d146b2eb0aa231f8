"""The pN_ queries of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import distinctive, leaks, mixture, near_duplicates, overlap, similar_sets, spam_pages
from setweave.llm.sql import SQL  # noqa: F401
from setweave.llm.term_counts import TermCounts, changes, newest, term_deltas
from setweave.operators.skew import skew_join
from setweave.session import materialize, tune


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{d}/{table}.parquet")


def _texts(spark: SparkSession, d: str, text) -> DataFrame:
    """Delivered corpus rows (id, at, text)."""
    return read(spark, d, "corpus").where("_id is not null").select(F.col("_id").alias("id"), F.col("fetched_at").cast("timestamp").alias("at"), text.alias("text"))


def _p1(spark: SparkSession, d: str, finish, threshold: float = 0.6) -> DataFrame:
    out = None
    both = (("corpus", similar_sets.similar_texts(_texts(spark, d, F.col("text")), threshold, 8)), ("node", similar_sets.similar_nodes(read(spark, d, "edge_pairs"), threshold, 5)))
    for kind, (pairs, members) in both:
        one = finish(materialize(pairs, "pairs"), members).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Record pairs with shared / union >= 0.6."""
    return _p1(spark, d, similar_sets.expand)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """One row a record with its class of equal sets and its number of partners."""
    return _p1(spark, d, similar_sets.links)


def _p5(spark: SparkSession, d: str, threshold: float = 0.5, size: int = 3, min_tokens: int = 8) -> tuple[DataFrame, DataFrame]:
    """(components (node, root) over class keys, members (id, key))."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return near_duplicates.near_groups(_texts(spark, d, text), threshold, size, min_tokens)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a record of at least 8 tokens: (group_id, member_id), alone in its group where nothing is near."""
    components, members = _p5(spark, d)
    per_key = members.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    rooted = per_key.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("n_members"), F.count("*").alias("n"))
    keyed = skew_join(rooted.select("key", "n", "root"), groups.select("root", "group_id", "n_members"), "root", groups.select("root", "n"))
    return skew_join(members, keyed.select("key", "group_id", "n_members"), "key", per_key.select("key", "n")).select("group_id", F.col("id").alias("member_id"), "n_members")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the groups of two or more."""
    return p5_groups(spark, d).where("n_members > 1").select("group_id", "member_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes with at least 100 neighbours whose shared neighbours are 20 % of the smaller set or more."""
    s = overlap.strong(*overlap.large_sets(read(spark, d, "edge_pairs"), 100), 0.2)
    return s.select(F.least("a", "b").alias("u_a"), F.greatest("a", "b").alias("u_b"))


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Estimated intersection and union of every pair of large nodes whose sketches share a member."""
    e = overlap.estimates(*overlap.large_sets(read(spark, d, "edge_pairs"), 100))
    return e.select(F.least("a", "b").alias("u_a"), F.greatest("a", "b").alias("u_b"), F.round("intersection", 3).alias("intersection"), F.round("union", 3).alias("union_size"))


def _term_counts(spark: SparkSession, d: str) -> TermCounts:
    """Counts of corpus.text after two batches of deliveries: those up to the middle of the time covered, then the later ones."""
    corpus = read(spark, d, "corpus")
    seconds = F.col("fetched_at").cast("timestamp").cast("double")
    span = corpus.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    middle = F.lit(((span.a or 0) + (span.b or 0)) / 2)
    at = F.coalesce(seconds, F.lit(0.0))
    early, late = (newest(corpus.where(c), "_id", "text", "fetched_at") for c in (at <= middle, at > middle))
    counts = TermCounts(spark)
    counts.merge(term_deltas(early.withColumn("sign", F.lit(1)), counts.buckets))
    return counts.merge(term_deltas(changes(early, late), counts.buckets))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms in fewer than 3 records or in more than 40 % of them."""
    return _term_counts(spark, d).marked(3, 0.4).where("mark is not null").select("term", "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    return _term_counts(spark, d).marked(3, 0.4)


def _weights(spark: SparkSession, d: str, best=None) -> DataFrame:
    corpus = newest(read(spark, d, "corpus"), "_id", "text", "fetched_at").select(F.lit("corpus").alias("origin"), F.col("id").alias("record_id"), "text")
    queries = newest(read(spark, d, "queries").withColumn("o", F.lit(0)), "_id", "text", "o").select(F.lit("queries").alias("origin"), F.col("id").alias("record_id"), "text")
    return distinctive.weigh(corpus, queries, best)


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weight of every term in every record of corpus and queries."""
    return _weights(spark, d).select("origin", "record_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


def _inverse_frequency(tf, df, n):
    return tf * np.log((n + 1) / (1 + df))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms of highest tf * ln((N + 1) / (1 + df)) of every record, all of them on a tie."""
    score = F.round(F.col("tf") * F.log((F.col("n_records") + 1) / (1 + F.col("df"))), 9)
    w = _weights(spark, d, _inverse_frequency).withColumn("score", score)
    tied = w.groupBy("origin", "record_id", "score").agg(F.collect_list("term").alias("terms"))
    best = tied.groupBy("origin", "record_id").agg(F.max_by("terms", "score").alias("terms"))
    return best.select("origin", "record_id", F.explode("terms").alias("term"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every document with an item it holds a passage of, and how many of the item's windows it holds."""
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding 10 consecutive tokens of an item."""
    return p7_passages(spark, d).select("doc_id", "item_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return materialize(mixture.count_tokens(read(spark, d, "documents").select("doc_id", "source", "text")), "sized")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized, targets = _sized(spark, d), read(spark, d, "source_targets")
    return mixture.mix(sized, targets), sized, targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix in training order."""
    return _mixed(spark, d)[0].orderBy("position")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares the mix reaches."""
    return mixture.shares(*_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the mix cannot give their share: repeated as often as they may, they hold fewer tokens than that."""
    return p8_shares(spark, d).where("capped").select("source")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Distance, direction and spam share of every document."""
    return spam_pages.scores(read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of keywords, links or product tags."""
    return spam_pages.spam_pages(read(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_counts, p4_found, p4_weights, p5_found, p5_groups, p6_found, p6_overlaps, p7_found, p7_passages, p8_found, p8_mix, p8_shares, p9_found, p9_scores)}
