"""Global positions and running sums without a single-task window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from setweave.session import materialize


def _ranged(df: DataFrame, order: list, value: str) -> DataFrame:
    """df in ranges of the order, numbered by `_p`, with the running sum `_i` inside a range taken as it is written.

    One shuffle: a task sorts its range and sums along it, batch by batch. The table is written so that the totals
    and the result read the same cut.
    """

    def run(batches):
        before = 0
        for b in batches:
            if b.num_rows:
                v = pc.fill_null(b.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = before + np.cumsum(v)
                before = int(ends[-1])
                part = pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v), part], names=[*b.schema.names, "_i", "_p"])

    schema = T.StructType([*df.schema.fields, T.StructField("_i", T.LongType()), T.StructField("_p", T.IntegerType())])
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranged")


def prefix_sum(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Adds the exclusive running sum of `value`, a whole number, over the whole table in `order` (a total order); null counts as 0."""
    r = _ranged(df, order, value)
    totals = r.groupBy("_p").agg(F.sum(value).alias("_t"))  # one row a range: as many as shuffle partitions
    starts = totals.select("_p", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return r.join(F.broadcast(starts), "_p").withColumn(out, (F.col("_s") + F.col("_i")).cast("long")).drop("_p", "_s", "_i")


def global_index(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds dense numbers 0.. in `order`."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")
