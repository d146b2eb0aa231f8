"""Prepare data sets for the table engines: read, clean, export; skipped where it was done before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from setweave.operators import graph
from setweave.session import tune
from setweave.sources import catalogue, exports, files

MARK = "_DONE"


def _graph(spark: SparkSession, source: str):
    return graph.undirected(files.edge_list(spark, source, "*.{edges,txt}"), "u", "v")


def build_sss(spark: SparkSession, source: str, target: str) -> None:
    exports.export_csr(_graph(spark, source), target)


def build_tc(spark: SparkSession, source: str, target: str) -> None:
    exports.export_csr(_graph(spark, source), target, oriented=True)


def build_ir(spark: SparkSession, source: str, target: str) -> None:
    docs, queries = (files.json_lines(spark, f"{source}/{f}.jsonl").where("_id is not null").groupBy(F.col("_id").alias(n)).agg(F.max("text").alias("text")) for f, n in (("corpus", "doc"), ("queries", "query")))
    exports.export_index(docs, queries, target)


def processor(mode: str) -> Callable[[SparkSession, str, str], None]:
    """The preparation of a mode: sss, tc or ir."""
    known = {"sss": build_sss, "tc": build_tc, "ir": build_ir}
    if mode.lower() not in known:
        raise ValueError(f"unknown mode {mode}")
    return known[mode.lower()]


def build(spark: SparkSession, mode: str, source: str, target: str) -> bool:
    """Prepare one data set; False where the target is marked as done. The mark is written last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{MARK}")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    processor(mode)(tune(spark), source, target)
    with files.opened(f"{target}/{MARK}", "wb") as f:
        f.write(mode.encode())
    return True


def build_all(spark: SparkSession, root: str, target: str) -> dict[str, bool]:
    """Prepare every data set under root by its kind, graphs for sss and tc: what was built now, by name and mode."""
    out = {}
    for r in catalogue.discover(spark, root).orderBy("name").collect():  # a row a data set
        for mode in ("ir",) if r.kind == "ir" else ("sss", "tc"):
            out[f"{r.name}/{mode}"] = build(spark, mode, f"{root}/{r.name}", f"{target}/{r.name}/{mode}")
    return out
