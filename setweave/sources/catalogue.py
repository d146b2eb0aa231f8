"""Configuration files and the data sets of a folder."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.sources.files import opened

#: Short names of the known data sets and their kind.
KNOWN = {"ce": "ir", "fe": "ir", "hp": "ir", "lt": "ir", "ms": "ir", "nq": "ir", "bm": "graph", "gp": "graph", "sc18": "graph", "sc19": "graph", "sc20": "graph", "wt": "graph"}


def load_config(path: str) -> dict:
    """A JSON object."""
    with opened(path) as f:
        c = json.loads(f.read().decode())
    if not isinstance(c, dict):
        raise ValueError(f"{path}: no object")
    return c


def setting(config: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path (a.b.c), the default where a step is missing."""
    at: Any = config
    for step in path.split("."):
        if not isinstance(at, dict) or step not in at:
            return default
        at = at[step]
    return at


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(name, kind, files, bytes) of the folders under root: ir with a corpus.jsonl, graph with .edges, .txt, .tsv or .mmio files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    f = f.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    kind = F.when(F.col("file") == "corpus.jsonl", "ir").when(F.col("file").rlike(r"\.(edges|txt|tsv|mmio)(\.gz)?$"), "graph")
    return f.groupBy("name").agg(F.max(kind).alias("kind"), F.count("*").alias("files"), F.sum("length").alias("bytes")).where("kind is not null")
