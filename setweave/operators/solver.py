"""Analytic cost of bucketed hash tables: expected probe steps per load factor and bucket size.

For every grid point a bucket's load follows a binomial law, its overflow a stationary law of
pi' = overflow(pi * load), and the cost is (1 + expected buckets past the first) * reads per step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.session import drop_path, versions

#: The grid and the constants of the cost model.
ALPHAS = [round(0.1 + 0.05 * i, 2) for i in range(19)]
BUCKETS = list(range(1, 10))
K_MAX = 256
FULL, NEARLY_FULL, TOO_FULL = 1e10, 1e9, 0.95


def load_law(size: int, mean: float) -> np.ndarray:
    """Binomial probabilities that 0..K_MAX of `size` keys hash to one bucket of the given mean load; the last cell takes the tail."""
    p, top = mean / size, min(size, K_MAX)
    out = np.zeros(K_MAX + 1)
    if p >= 1:
        out[top] = 1.0
        return out
    k = np.arange(1, top + 1)
    ratios = (size - k + 1) / k * (p / (1 - p))
    out[: top + 1] = np.concatenate([[1.0], np.cumprod(ratios)]) * (1 - p) ** size
    out[top] += max(0.0, 1.0 - out.sum())
    return out


def poisson_law(mean: float) -> np.ndarray:
    """The limit of load_law for many keys."""
    return np.concatenate([[1.0], np.cumprod(mean / np.arange(1, K_MAX + 1))]) * math.exp(-mean)


def overflow_law(load: np.ndarray, b: int, tolerance: float = 1e-6) -> np.ndarray:
    """Stationary law of the keys a bucket passes on; the last iterate but one, as the published figures use."""
    now = np.zeros(K_MAX + 1)
    now[0] = 1.0
    for _ in range(10_000):
        arrived = np.convolve(now, load)
        after = np.append(arrived[: b + 1].sum(), arrived[b + 1 : b + K_MAX + 1])
        after = after / after.sum()
        if np.abs(after - now).max() < tolerance:
            break
        now = after
    return now


def cost(size: int, alpha: float, b: int, w: int, s_trans: int, s_slot: int, law: str = "binomial") -> float:
    """Predicted cost of a grid point."""
    load = load_law(size, alpha * b) if law == "binomial" else poisson_law(alpha * b)
    held = np.convolve(overflow_law(load, b), load)[: K_MAX + 1]
    full, mean = float(held[b:].sum()), float(np.arange(K_MAX + 1) @ held)
    if full >= 1 or mean <= 0:
        return FULL
    if full > TOO_FULL:
        return NEARLY_FULL
    steps = (b * full + float(np.arange(1, b + 1) @ held[:b])) / (1 - full)
    return steps * (math.ceil(w * s_slot / (mean * s_trans)) + 1)


def penalty(alpha: float, center: float = 0.2, width: float = 0.12, scale: float = 1.0) -> float:
    """Squared distance of a load factor from the centre on a logarithmic scale; off unless asked for."""
    return FULL if alpha <= 0 else scale * (math.log(alpha / center) / math.log(1 + width / center)) ** 2


def grid(spark: SparkSession, level: int = 0) -> DataFrame:
    """(alpha, b) of every grid point; level 1 and 2 are the smaller grids for quick runs."""
    low, high, most = [(0.1, 1.0, 9), (0.2, 0.8, 10), (0.35, 0.4, 4)][min(level, 2)]
    n = round((high - low) / 0.05)
    a = spark.sql(f"select explode(sequence(0, {n})) as i").select(F.round(F.lit(low) + F.col("i") * 0.05, 2).alias("alpha"))
    return a.crossJoin(spark.sql(f"select explode(sequence(1, {most})) as b"))  # constants, 190 points at most


def load_laws(spark: SparkSession, size: int | None = None, keys: int = 12) -> DataFrame:
    """(alpha, b, k, p): chance that k keys hash to a bucket, k up to `keys`; for many keys (no size) the Poisson law."""

    def run(batches):
        for p in batches:
            laws = [load_law(size, a * b) if size else poisson_law(a * b) for a, b in zip(p.alpha, p.b)]
            out = p.loc[p.index.repeat(keys + 1)].reset_index(drop=True)
            out["k"], out["p"] = np.tile(np.arange(keys + 1, dtype=np.int32), len(p)), np.concatenate([x[: keys + 1] for x in laws])
            yield out

    return grid(spark).mapInPandas(run, "alpha double, b int, k int, p double")


def solve(spark: SparkSession, problems: DataFrame, level: int = 0, with_penalty: bool = False) -> DataFrame:
    """problems (size, w, s_trans, s_slot) -> one row a grid point with its cost."""

    def run(batches):
        for p in batches:
            p["cost"] = [cost(int(r.size_), float(r.alpha), int(r.b), int(r.w), int(r.s_trans), int(r.s_slot)) + (penalty(float(r.alpha)) if with_penalty else 0.0) for r in p.rename(columns={"size": "size_"}).itertuples()]
            yield p

    g = problems.select("size", "w", "s_trans", "s_slot").distinct().join(F.broadcast(grid(spark, level)))
    return g.repartition(F.col("alpha")).mapInPandas(run, "size long, w int, s_trans int, s_slot int, alpha double, b int, cost double")


def best(costs: DataFrame) -> DataFrame:
    """Cheapest grid point of each problem; ties go to the smaller alpha, then b."""
    return costs.groupBy("size", "w", "s_trans", "s_slot").agg(F.min(F.struct("cost", "alpha", "b")).alias("m")).select("size", "w", "s_trans", "s_slot", "m.alpha", "m.b", "m.cost")


KEYS = ["mode", "size", "w", "s_trans", "s_slot"]


class Recommendations:
    """Best grid points by (mode, size, w, s_trans, s_slot), kept under a path; a put writes the next version."""

    SCHEMA = "mode string, size long, w int, s_trans int, s_slot int, alpha double, b int, cost double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version = max([0, *versions(spark, path)])

    def table(self) -> DataFrame:
        read = self.spark.read.schema(self.SCHEMA)
        return read.parquet(f"{self.path}/{self.version}") if self.version else self.spark.createDataFrame([], self.SCHEMA)

    def put(self, rows: DataFrame) -> Recommendations:
        """Add recommendations; those of the same key are replaced."""
        new = rows.select(*KEYS, "alpha", "b", "cost")
        kept = self.table().join(new.select(*KEYS), KEYS, "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{self.path}/{self.version + 1}")
        self.version += 1
        return self

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Keys still to solve."""
        return wanted.select(*KEYS).distinct().join(self.table(), KEYS, "left_anti")

    def get(self, wanted: DataFrame) -> DataFrame:
        """Known answers to every key, (0, 0, inf) where there is none."""
        j = wanted.select(*KEYS).distinct().join(self.table(), KEYS, "left")
        return j.select(*KEYS, F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("cost", F.lit(float("inf"))).alias("cost"))

    def solve(self, wanted: DataFrame) -> DataFrame:
        """Answers to every key; those not known are solved and kept. The mode does not change a solution."""
        todo = self.missing(wanted)
        if not todo.isEmpty():
            self.put(todo.join(best(solve(self.spark, todo)), ["size", "w", "s_trans", "s_slot"]))
        return self.get(wanted)

    def precompute(self, sizes: list[int], ws: list[int], trans: list[int], slots: list[int], modes: list[str]) -> DataFrame:
        """Solve all combinations of the lists."""
        one = [(m, n, w, t, s) for m in modes for n in sizes for w in ws for t in trans for s in slots]
        return self.solve(self.spark.createDataFrame(one, "mode string, size long, w int, s_trans int, s_slot int"))

    def clear(self) -> None:
        for v in versions(self.spark, self.path):
            drop_path(self.spark, f"{self.path}/{v}")
        self.version = 0

    def stats(self) -> DataFrame:
        """Entries by mode."""
        return self.table().groupBy("mode").agg(F.count("*").alias("entries"), F.min("cost").alias("least_cost"))
