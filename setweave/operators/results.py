"""Measurement tables: upsert, best points, statistics, pivots, ratios."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.session import versions


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both, by key; non-null new values win."""
    n = new.select(*keys, *(F.col(v).alias(f"_n_{v}") for v in values))
    return old.join(n, keys, "full").select(*keys, *(F.coalesce(f"_n_{v}", v).alias(v) for v in values))


def both_layouts(rows: DataFrame, column: str = "table_type") -> DataFrame:
    """A row without a layout stands for N and H."""
    kinds = F.when(F.col(column).isNull(), F.array(F.lit("N"), F.lit("H"))).otherwise(F.array(column))
    return rows.withColumn(column, F.explode(kinds))


def statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """mean, population deviation, min, max and median of the finite values."""
    v = F.col(value)
    r = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return r.groupBy(group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile(v, F.lit(0.5)).alias("median"))


def best_points(rows: DataFrame, group: list[str], by: str, cost: str, order: str, eps: float = 1e-12) -> DataFrame:
    """(group.., kind, by, order, cost): per group the cheapest point ('global'), and per value of `by` its cheapest ('local').

    Costs within eps of the least tie, and the least `order` wins; the global point is no local one. Rows without a
    cost are no points.
    """
    r = rows.where(F.col(cost).isNotNull() & ~F.isnan(cost))

    def first(keys: list[str], *rank) -> DataFrame:
        least = r.groupBy(*keys).agg(F.min(cost).alias("_least"))
        near = r.join(least, keys).where(F.col(cost) <= F.col("_least") + eps)
        return near.groupBy(*keys).agg(F.min(F.struct(*rank, cost)).alias("_b"))

    top = first(group, by, order).select(*group, F.lit("global").alias("kind"), F.col(f"_b.{by}"), F.col(f"_b.{order}"), F.col(f"_b.{cost}"))
    each = first([*group, by], order).select(*group, F.lit("local").alias("kind"), by, F.col(f"_b.{order}"), F.col(f"_b.{cost}"))
    return top.unionByName(each.join(top.select(*group, by, order), [*group, by, order], "left_anti"))


def geometric_mean(value: Column) -> Column:
    """Of the finite positive values."""
    return F.exp(F.avg(F.when((value > 0) & (value < float("inf")), F.log(value))))


def incomplete(rows: DataFrame, group: list[str], item: str, expected: list[str]) -> DataFrame:
    """Groups that don't hold exactly the expected items."""
    want = F.array(*(F.lit(x) for x in sorted(expected)))
    return rows.groupBy(*group).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.col("items") != want)


def milliseconds(value: Column, unit: Column) -> Column:
    return F.when(unit == "ns", value / 1e6).when(unit == "us", value / 1e3).when(unit == "ms", value).when(unit == "s", value * 1e3)


def quantile_edges(rows: DataFrame, value: str, steps: int) -> DataFrame:
    """(i, edge): bin edges at even quantiles, exact."""
    q = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    e = rows.agg(F.percentile(F.col(value), q).alias("e"))
    return e.select(F.posexplode("e").alias("i", "edge"))


def bin_edges(rows: DataFrame, value: str, bins: int, mode: str = "quantile", clip: tuple[float, float] = (0.02, 0.98), keep_clip: bool = True, min_step: float = 1e-6) -> DataFrame:
    """(i, edge): at most bins + 1 rising bin edges over the clipped range of the finite values.

    mode: quantile (even quantiles), log-quantile (even quantiles of the logarithms of the positive values) or
    linear. Equal edges become one, or are pushed apart by min_step; without keep_clip the data's ends are added.
    No values give the edges 0 and 1. Only 2 bins + 10 numbers reach the driver.
    """
    if mode not in ("quantile", "log-quantile", "linear"):
        raise ValueError(f"mode {mode}")
    lo_q, hi_q = (min(1.0, max(0.0, q)) for q in clip)
    lo_q, hi_q = (lo_q, hi_q) if lo_q < hi_q else (0.02, 0.98)
    qs = [lo_q + (hi_q - lo_q) * i / bins for i in range(bins + 1)]
    v = F.col(value).cast("double")
    r = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.alias("v"))
    positive = F.when(F.col("v") > 0, F.col("v"))
    at = lambda c, q: F.percentile(c, F.array(*(F.lit(x) for x in q)))
    m = r.agg(F.min("v").alias("least"), F.max("v").alias("most"), at(F.col("v"), qs).alias("q"), at(positive, [lo_q, hi_q]).alias("ends"), at(F.log(positive), qs).alias("logs"), F.count(positive).alias("n")).first()
    edges = _edges(m, bins, mode, keep_clip, min_step)
    return rows.sparkSession.createDataFrame(list(enumerate(edges)), "i int, edge double")


def _edges(m, bins: int, mode: str, keep_clip: bool, min_step: float) -> list[float]:
    if m.least is None:
        return [0.0, 1.0]
    lo, hi = (m.q[0], m.q[-1]) if m.q[0] != m.q[-1] else (m.least, m.most)
    if lo == hi:
        return [lo, lo + 1.0]
    if mode == "quantile":
        edges = list(m.q)
    elif mode == "linear" or m.n < 2:
        edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    else:
        low = max(m.ends[0], min_step)
        edges = [low, *(math.exp(x) for x in m.logs[1:-1]), max(m.ends[1], low + min_step)]
    edges = sorted(set(edges))
    if len(edges) < 2:
        return [m.least, m.most]
    if not keep_clip:
        edges = [m.least] * (edges[0] > m.least) + edges + [m.most] * (edges[-1] < m.most)
    out = edges[:1]
    for e in edges[1:]:
        out.append(e if e > out[-1] else out[-1] + min_step)
    return out


def merge_runs(measured: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Measured rows, completed from the predicted row of the same keys; measured values win where both have a column."""
    p = predicted.select(*keys, *(F.col(c).alias(f"_p_{c}") for c in predicted.columns if c not in keys))
    cols = [F.coalesce(c, f"_p_{c}").alias(c) if c in predicted.columns else F.col(c) for c in measured.columns if c not in keys]
    extra = [F.col(f"_p_{c}").alias(c) for c in predicted.columns if c not in measured.columns]
    return measured.join(p, keys, "left").select(*keys, *cols, *extra)


def merge_layouts(tasks: DataFrame, normal: DataFrame, hierarchical: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """Per task both layouts' values as text, 'Missing' where one is absent, and the speed-up where both are there."""
    n, h = (df.select(*keys, F.col(value).alias(x)) for df, x in ((normal, "_n"), (hierarchical, "_h")))
    j = tasks.select(*keys).distinct().join(n, keys, "left").join(h, keys, "left")
    shown = lambda c: F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("Missing")
    speed = F.coalesce(F.when(F.col("_h") > 0, F.col("_n") / F.col("_h")), F.lit(0.0))
    return j.select(*keys, shown(F.col("_n")).alias("normal"), shown(F.col("_h")).alias("hierarchical"), F.when(F.col("_n").isNotNull() & F.col("_h").isNotNull(), speed).alias("speedup"))


def to_rerun(rows: DataFrame, success: str, time: str, status: str) -> DataFrame:
    """Rows whose timing failed or is missing, or whose status is not OK."""
    return rows.where(~F.coalesce(F.col(success), F.lit(False)) | F.col(time).isNull() | (F.coalesce(F.col(status), F.lit("")) != "OK"))


def over_parts(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group the sum, least, greatest and mean over its partitions."""
    return rows.groupBy(*group).agg(F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def compared(rows: DataFrame, group: list[str], method: str, base: str, values: Mapping[str, str]) -> DataFrame:
    """Per group and method, base / own of the mean of every value: values maps a ratio's name to its column."""
    g = rows.groupBy(*group, method).agg(*(F.avg(c).alias(f"_{name}") for name, c in values.items()))
    b = g.where(F.col(method) == base).select(*group, *(F.col(f"_{name}").alias(f"_b_{name}") for name in values))
    return g.join(b, group).select(*group, method, *(F.try_divide(f"_b_{name}", F.col(f"_{name}")).alias(name) for name in values))


def wide(rows: DataFrame, index: str, column: str, names: list[str], value: str, how: Callable[[str], Column] = F.first) -> DataFrame:
    """One row an index, one column per name in the order given; a cell takes `how` of its rows, null where none."""
    return rows.groupBy(index).pivot(column, names).agg(how(value)).select(index, *names)


def element_ratio(rows: DataFrame, index: str, column: str, over: str, under: str, value: str) -> DataFrame:
    """Mean of `over` by mean of `under`, where an index has both."""
    return wide(rows.where(F.col(value).isNotNull()), index, column, [over, under], value, F.avg).dropna().select(index, F.try_divide(over, F.col(under)).alias("ratio"))


def per_request(sectors: Column, requests: Column) -> Column:
    """Sectors a request; null without requests."""
    return F.when(requests > 0, sectors / requests)


def consistency(answers: DataFrame, method: str, value: str, base: str) -> DataFrame:
    """(method, value, agrees): whether each method gives the base method's answer."""
    b = answers.where(F.col(method) == base).agg(F.first(value).alias("_b"))
    return answers.join(F.broadcast(b)).select(method, value, F.col(value).eqNullSafe(F.col("_b")).alias("agrees"))


def fixed_width(rows: DataFrame, columns: Mapping[str, str], sep: str = "\t") -> DataFrame:
    """(line) of rows: columns maps a name to its format (%-12s, %.3f, ..); null shows as '-'."""
    return rows.select(F.concat_ws(sep, *(F.when(F.col(c).isNotNull(), F.format_string(f, c)).otherwise("-") for c, f in columns.items())).alias("line"))


class ResultStore:
    """Measurements by (alpha, b, table_type) under a path, as versions of one table; an upsert writes the next one."""

    KEYS = ["alpha", "b", "table_type"]

    def __init__(self, spark, path: str, values: list[str]):
        self.spark, self.path, self.values = spark, path, values
        self.version = max([0, *versions(spark, path)])

    def table(self) -> DataFrame:
        schema = "alpha double, b int, table_type string, " + ", ".join(f"`{v}` double" for v in self.values)
        read = self.spark.read.schema(schema)
        return read.parquet(f"{self.path}/{self.version}") if self.version else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame) -> ResultStore:
        """Insert or update; rows without a table_type stand for N and H, null values leave the old ones."""
        known = [F.col(v).cast("double").alias(v) if v in rows.columns else F.lit(None).cast("double").alias(v) for v in self.values]
        kind = F.col("table_type") if "table_type" in rows.columns else F.lit(None).cast("string")
        new = both_layouts(rows.select(F.col("alpha").cast("double"), F.col("b").cast("int"), kind.alias("table_type"), *known))
        upsert(self.table(), new, self.KEYS, self.values).write.mode("overwrite").parquet(f"{self.path}/{self.version + 1}")
        self.version += 1
        return self

    def best(self, cost: str = "cost") -> DataFrame:
        return best_points(self.table(), ["table_type"], "alpha", cost, "b")

    def statistics(self, value: str = "cost") -> DataFrame:
        return statistics(self.table(), "table_type", value)

    def summary(self, cost: str = "cost") -> DataFrame:
        """One row a table_type: rows, the best point and the statistics of its costs, also as one JSON text."""
        best = self.best(cost).where("kind = 'global'").select("table_type", F.struct("alpha", "b", cost).alias("best_config"))
        n = self.table().groupBy("table_type").agg(F.count("*").alias("total_rows"))
        s = self.statistics(cost).select("table_type", F.struct("mean", "std", "low", "high", "median").alias("statistics"))
        j = n.join(best, "table_type", "left").join(s, "table_type", "left")
        return j.withColumn("json", F.to_json(F.struct("total_rows", "best_config", "statistics")))
