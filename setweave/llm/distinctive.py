"""How distinctive a term is per record: divergence from randomness.

Weight of a term in a record: information content under the geometric model of the collection times the Laplace
after-effect gain, over the length-normalised frequency
    tfn = tf log2(1 + average length / length),  l = occurrences / records,
    weight = (log2(1 + l) + tfn log2((1 + l) / l)) / (tfn + 1).

Terms in at least 1/HOT of the records, at most HOT times the mean number of distinct terms of a record, whatever
the collection's size, are looked up where the records lie; only the rest is shuffled by term.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm import words
from setweave.llm.term_counts import ALL, _signed_terms
from setweave.session import materialize

HOT = 5000


def weight_of(tf, df, cf, length, n_records: int, average: float) -> np.ndarray:
    tfn = tf * np.log2(1 + average / length)
    mean = cf / n_records
    return (np.log2(1 + mean) + tfn * np.log2((1 + mean) / mean)) / (tfn + 1)


def collection_terms(records: DataFrame) -> DataFrame:
    """records (record_id, text), one row each -> (term, df, cf); the row of ALL has the number of records as df."""
    r = records.select("text", F.lit(1).alias("sign")).mapInArrow(_signed_terms, "term string, cf long, df long")
    return r.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class _Frequent:
    """Looks up the frequent terms' counts by hash."""

    def __init__(self, terms: pa.Table):
        hashes = words.hash_of(terms.column("term").combine_chunks())
        order = np.argsort(hashes)
        self.hashes, self.df, self.cf = hashes[order], *(terms.column(c).to_numpy()[order] for c in ("df", "cf"))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, df, cf), 0 and 1 where not found."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, np.where(found, self.df[at], 0), np.where(found, self.cf[at], 1)


def _rows(shipped, n_records: int, average: float, best: Callable | None):
    """Batches (origin, record_id, text) -> (origin, record_id, term, tf, length, df, weight), the last two null for rarer terms."""

    def run(batches):
        for origin, record_id, texts in words.gathered(batches, ["origin", "record_id", "text"]):
            terms, rec, term, tf, lengths = words.counted(texts)
            if not len(rec):
                continue
            found, df, cf = (x[term] for x in shipped.value.find(words.hash_of(terms)))
            length = lengths[rec]
            weight = weight_of(tf, df, cf, length, n_records, average)
            keep = np.ones(len(rec), bool)
            if best is not None:
                # The most a rarer term can score is its score with a df of 1.
                most = best(tf, np.where(found, df, 1), n_records)
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, rec[found], most[found])
                keep = most >= top[rec] - 1e-8  # the logarithms of two libraries differ in the last digits
            none = ~found[keep]
            cols = [pa.array(x, pa.string()).take(pa.array(rec[keep])) for x in (origin, record_id)] + [terms.take(pa.array(term[keep]))]
            cols += [pa.array(tf[keep].astype(np.int64)), pa.array(length[keep].astype(np.int64)), pa.array(df[keep].astype(np.int64), mask=none), pa.array(weight[keep], mask=none)]
            yield pa.RecordBatch.from_arrays(cols, names=["origin", "record_id", "term", "tf", "length", "df", "weight"])

    return run


def weigh(collection: DataFrame, others: DataFrame | None = None, best: Callable | None = None) -> DataFrame:
    """(origin, record_id, term, tf, df, n_records, weight) of the terms of `collection` and `others` the collection holds.

    Both are (origin, record_id, text), one row a record; records with null or blank text have no terms. With
    best, a score(tf, df, n_records) that falls with df, terms that cannot reach their record's highest score
    may be missing, so that rows of frequent terms needn't leave the task that reads them.
    """
    spark = collection.sparkSession
    counted = materialize(collection_terms(collection), "terms")
    whole = counted.agg(F.max(F.when(F.col("term") == ALL, F.col("df"))).alias("n"), F.sum("cf").alias("cf")).first()
    n, terms = whole.n or 0, counted.where(F.col("term") != ALL)
    average = (whole.cf or 0) / max(n, 1)
    # At most HOT times the mean number of distinct terms of a record.
    frequent = spark.sparkContext.broadcast(_Frequent(terms.where(F.col("df") * HOT >= n).toArrow()))
    schema = "origin string, record_id string, term string, tf long, length long, df long, weight double"
    parts = [r.select("origin", "record_id", "text").mapInArrow(_rows(frequent, max(n, 1), average, best), schema) for r in ([collection] if others is None else [collection, others])]
    rows = reduce(DataFrame.unionByName, parts)
    if best is not None:
        rows = materialize(rows, "best")
    near = rows.where("df is not null").select("origin", "record_id", "term", "tf", "df", "weight")
    tfn = F.col("tf") * F.log2(1 + F.lit(average) / F.col("length"))
    mean = F.col("cf") / F.lit(n)
    far = rows.where("df is null").drop("df", "weight").join(terms.where(F.col("df") * HOT < n).hint("merge"), "term").withColumn("_f", tfn).withColumn("_l", mean)
    weight = (F.log2(1 + F.col("_l")) + F.col("_f") * F.log2((1 + F.col("_l")) / F.col("_l"))) / (F.col("_f") + 1)
    both = near.unionByName(far.select("origin", "record_id", "term", "tf", "df", weight.alias("weight")))
    return both.withColumn("n_records", F.lit(n))
