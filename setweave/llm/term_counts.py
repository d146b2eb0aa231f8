"""Frequency of every distinct term, kept up by signed deltas.

State: per term its occurrences and the records holding it, plus the number of records, as a table split by a
hash of the term into fixed partitions. A batch of deliveries changes records; only records added, changed or
deleted are tokenised, once with sign + for the new and once with sign - for the old text, summed per term, and
merged into the state partition by partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import words
from setweave.session import discard, drop_path, materialize, table_path

STATE = "term string, occurrences long, records long, bucket int"
#: The row of the state that counts the records themselves; no token is blank.
ALL = " "


def newest(deliveries: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """(id, text): the newest delivery of every non-null id; ties go to the greatest text."""
    r = deliveries.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("text"))).alias("r"))
    return r.select("id", "r.text")


def changes(before: DataFrame, after: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Signed versions (id, text, sign) of what `after` (and `deleted` ids) does to `before`; both hold one row an id.

    Ids only in `after` are added, ids in both with another text changed, ids in `deleted` removed. Ids that
    `after` doesn't name stay as they are. Equal texts, null ones included, change nothing.
    """
    sides = after.select("id", "text", F.lit(1).alias("side"))
    if deleted is not None:
        sides = sides.unionByName(deleted.select("id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("side")).distinct())
    touched = sides.groupBy("id").agg(F.max(F.when(F.col("side") == 1, F.struct("text"))).alias("new"), F.max("side").alias("side"))
    j = touched.join(before.select("id", F.struct("text").alias("old")), "id", "left").withColumn("new", F.when(F.col("side") == 1, F.col("new")))
    moved = j.where(~F.col("old").eqNullSafe(F.col("new")))
    both = F.array(F.struct(F.col("old").alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("r"), F.lit(1).alias("sign")))
    return moved.select("id", F.explode(both).alias("x")).where("x.r is not null").select("id", "x.r.text", "x.sign")


def _signed_terms(batches):
    """Signed texts -> (term, occurrences, records), summed over many texts; the row of ALL counts the texts."""
    for texts, signs in words.gathered(batches, ["text", "sign"]):
        sign = np.array(signs, np.int64)
        terms, text, term, tf, _ = words.counted(texts)
        occurrences, records = (np.bincount(term, x, len(terms)).astype(np.int64) for x in (sign[text] * tf, sign[text]))
        cols = [pa.concat_arrays([terms, pa.array([ALL])]), pa.array(np.append(occurrences, 0)), pa.array(np.append(records, sign.sum()))]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "occurrences", "records"])


def term_deltas(signed: DataFrame, buckets: int) -> DataFrame:
    """Signed texts -> the state's columns, as changes. Unchanged sums fall away."""
    rows = signed.select("text", F.col("sign").cast("int").alias("sign")).mapInArrow(_signed_terms, "term string, occurrences long, records long")
    sums = rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")
    return sums.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


class TermCounts:
    """The persistent counts of one collection under `path`, which may hold those of an earlier session.

    The table is split by `buckets`. A merge rewrites the buckets its deltas touch, under a new version, and then
    writes the version's list of where each bucket lies; the newest complete list is the state. A merge that fails
    before that changes nothing and can be repeated. Lists and buckets of older versions stay until `clean`.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets, self.version = spark, path or table_path(spark, "term-counts"), buckets, 0
        self.places: dict[int, int] = {}
        done = [v for v in self._names("lists") if self._exists(f"lists/{v}/_SUCCESS")]
        if done:
            self.version = max(done)
            rows = spark.read.schema("bucket int, version int, buckets int").parquet(f"{self.path}/lists/{self.version}").collect()  # one row a bucket
            self.places = {r.bucket: r.version for r in rows if r.bucket >= 0}
            self.buckets = rows[0].buckets

    def _fs(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, at: str) -> bool:
        fs, p = self._fs(at)
        return fs.exists(p)

    def _names(self, at: str) -> list[int]:
        fs, p = self._fs(at)
        return [int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()] if fs.exists(p) else []

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in places.items()]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        read = self.spark.read.schema("term string, occurrences long, records long").parquet(*paths)
        return read.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))

    def table(self) -> DataFrame:
        return self._read(self.places)

    def merge(self, deltas: DataFrame) -> TermCounts:
        """Add the deltas (term_deltas with this table's `buckets`). Terms that no record holds any more leave the state."""
        deltas = materialize(deltas.select("term", "occurrences", "records", "bucket"), "deltas")
        touched = {r.bucket for r in deltas.select("bucket").distinct().collect()}  # at most `buckets`
        new = self.version + 1
        both = self._read({b: v for b, v in self.places.items() if b in touched}).unionByName(deltas)
        # Every task writes whole buckets: one file each.
        sums = both.repartition("bucket").groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        kept = sums.where("occurrences <> 0 or records <> 0").select("term", "occurrences", "records", "bucket")
        kept.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{new}")
        discard(deltas)
        # A bucket that lost its last term has no folder.
        self.places = {b: v for b, v in self.places.items() if b not in touched} | {b: new for b in touched if self._exists(f"data/{new}/bucket={b}")}
        rows = [(b, v, self.buckets) for b, v in self.places.items()] or [(-1, new, self.buckets)]
        self.spark.createDataFrame(rows, "bucket int, version int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{new}")
        self.version = new
        return self

    def clean(self) -> None:
        """Remove the lists of older versions and the data no list names."""
        for v in self._names("lists"):
            if v != self.version:
                drop_path(self.spark, f"{self.path}/lists/{v}")
        for v in self._names("data"):
            if v not in self.places.values():
                drop_path(self.spark, f"{self.path}/data/{v}")

    def counts(self) -> DataFrame:
        """(term, occurrences, records)."""
        return self.table().where(F.col("term") != ALL).select("term", "occurrences", "records")

    def total(self) -> DataFrame:
        """One row: the number of records."""
        return self.table().where(F.col("term") == ALL).agg(F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("n_records"))

    def marked(self, rare_below: int, common_above: float) -> DataFrame:
        """(term, occurrences, records, mark): 'rare' below rare_below records, 'common' above the share, else null."""
        m = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("n_records") * F.lit(common_above), "common")
        return self.counts().join(F.broadcast(self.total())).select("term", "occurrences", "records", m.alias("mark"))
