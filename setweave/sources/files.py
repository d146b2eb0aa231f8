"""File sources and sinks: edge lists, JSON lines, integer vectors, block-compressed adjacency, result tables.

Text goes through Spark's readers with fixed schemas. Binary files are read by executors, one file a row, and
decoded in Arrow batches; nothing passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "text", "title")])
#: Layouts of vector files: has a leading count, element type.
VECTORS = {"int32": (True, "<i4"), "int64": (True, "<i8"), "raw_int32": (False, "<i4"), "raw_uint32": (False, "<u4")}
SCALARS = {"int32": "<i4", "float32": "<f4", "uint64": "<u8"}
#: Values of a vector file that one task reads.
RANGE = 1 << 22


def edge_list(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(u, v) of text lines `u v [w]`; comments, malformed lines and self loops are dropped."""
    line = F.trim(F.col("value"))
    t = spark.read.option("pathGlobFilter", glob).text(path).where(~line.startswith("#")).select(F.split(line, r"\s+").alias("p")).where(F.size("p") >= 2)
    e = t.select(F.expr("try_cast(p[0] as long)").alias("u"), F.expr("try_cast(p[1] as long)").alias("v"))
    return e.where("u is not null and v is not null and u <> v")


def weighted_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of digit-led lines `u v w`; a file's first such line counts as a header unless u or v is 1."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    t = t.where(F.col("value").rlike(r"^\s*\d"))
    first = t.groupBy("f").agg(F.min("i").alias("i"), F.lit(True).alias("first"))
    p = t.join(F.broadcast(first), ["f", "i"], "left").select(F.split(F.trim("value"), r"\s+").alias("p"), F.coalesce("first", F.lit(False)).alias("first"))
    e = p.select(F.expr("try_cast(p[0] as long)").alias("u"), F.expr("try_cast(try_element_at(p, 2) as long)").alias("v"), "first").where("u is not null and v is not null")
    return e.where("not first or u = 1 or v = 1").select("u", "v")


def json_lines(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """One object a line; blank and undecodable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query_id, 0, doc_id, relevance."""
    return spark.read.schema("query_id string, iter int, doc_id string, relevance int").option("sep", "\t").csv(path)


def opened(uri: str, mode: str = "rb"):
    """A file of any file system the library knows (local, HDFS, object stores), by its URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + os.path.abspath(uri))
    if mode == "rb":
        return system.open_input_file(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def vector(spark: SparkSession, path: str, layout: str = "int32") -> DataFrame:
    """(file, pos, value) of integer vector files; a file whose count disagrees with its length is an error.

    Files of any length: ranges of RANGE values are read by seeking, each by its own task.
    """
    counted, kind = VECTORS[layout]
    head, width = 8 * counted, np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            for name, length, lo in zip(*(b.column(c).to_pylist() for c in ("path", "length", "lo"))):
                n = (length - head) // width
                with opened(name) as f:
                    if length < head or (length - head) % width or (counted and lo == 0 and int.from_bytes(f.read_at(8, 0), "little") != n):
                        raise ValueError(f"{name}: count and length disagree")
                    v = np.frombuffer(f.read_at(min(RANGE, n - lo) * width, head + lo * width), kind).astype(np.int64)
                for at in range(0, len(v), 1 << 16):
                    part = v[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(lo + at, lo + at + len(part))), pa.array(part)], names=["file", "pos", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.greatest(F.lit(0), F.floor((F.col("length") - head) / width) - 1)
    ranges = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RANGE).cast("long"))))
    return ranges.repartition("path", "lo").mapInArrow(run, "file string, pos long, value long")


def write_vector(values: Iterable[int], path: str, layout: str = "int32") -> None:
    """Write a small vector file from the driver; exports.write_vector writes tables."""
    counted, kind = VECTORS[layout]
    v = np.asarray(list(values), kind)
    with opened(path, "wb") as f:
        f.write((len(v).to_bytes(8, "little") if counted else b"") + v.tobytes())


def write_scalar(value: float, path: str, kind: str = "int32") -> None:
    with opened(path, "wb") as f:
        f.write(np.asarray([value], SCALARS[kind]).tobytes())


def read_scalar(path: str, kind: str = "int32") -> int | float:
    """One number; a file of another length is an error."""
    with opened(path) as f:
        data = f.read()
    if len(data) != np.dtype(SCALARS[kind]).itemsize:
        raise ValueError(f"{path}: {len(data)} bytes are no {kind}")
    return np.frombuffer(data, SCALARS[kind])[0].item()


def summary_rows(spark: SparkSession, path: str, columns: list[str], pairs: Iterable[str] = ()) -> DataFrame:
    """Rows of a report of white-space separated columns; a field `a/b` of `pairs` becomes name_1 and name_2.

    The header line (which begins with the first column's name, any case), rules of dashes and lines with fewer
    fields are skipped.
    """
    line = F.trim("value")
    t = spark.read.text(path).where(~line.startswith("---") & (F.length(line) > 0)).select(F.split(line, r"\s+").alias("p")).where(F.size("p") >= len(columns))
    t = t.where(F.lower(F.get("p", F.lit(0))) != columns[0].lower())
    out = []
    for i, c in enumerate(columns):
        field = F.get("p", F.lit(i))
        out += [F.get(F.split(field, "/"), F.lit(k)).alias(f"{c}_{k + 1}") for k in (0, 1)] if c in pairs else [field.alias(c)]
    return t.select(*out)


def _varint(x: int, out: bytearray) -> None:
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)


def encode_nodes(neighbours: list[list[int]]) -> bytes:
    """Per node its degree, then the zigzag differences of its neighbours, as base-128 numbers."""
    out = bytearray()
    for nbrs in neighbours:
        _varint(len(nbrs), out)
        before = 0
        for v in nbrs:
            d = v - before
            _varint(2 * d if d >= 0 else -2 * d - 1, out)
            before = v
    return bytes(out)


def _numbers(data: bytes) -> np.ndarray:
    """All base-128 numbers of a byte string at once."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    if not len(raw):
        return np.zeros(0, np.int64)
    if not len(last) or last[-1] != len(raw) - 1:
        raise ValueError("a number is cut off")
    begin = np.append(0, last[:-1] + 1)
    shift = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * shift), begin)


def decode_nodes(first: int, data: bytes) -> list[tuple[int, np.ndarray]]:
    """(node, neighbours) of a block that begins with node `first`."""
    n, at, out = _numbers(data), 0, []
    while at < len(n):
        deg = int(n[at])
        z = n[at + 1 : at + 1 + deg]
        if len(z) < deg:
            raise ValueError("a node is cut off")
        v = np.cumsum((z >> 1) ^ -(z & 1))
        if len(v) and v.min() < 0:
            raise ValueError("negative neighbour")
        out.append((first + len(out), v))
        at += 1 + deg
    return out


def read_blocks(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """blocks (path, first_node, begin, end) of a block-compressed column file -> edges (u, v).

    Every block is a unit of work that seeks to its own bytes.
    """

    def run(batches):
        for b in batches:
            for path, first, begin, end in zip(*(b.column(c).to_pylist() for c in ("path", "first_node", "begin", "end"))):
                with opened(path) as f:
                    data = f.read_at(end - begin, begin) if end > begin else b""
                if len(data) != end - begin:
                    raise ValueError(f"{path}: block {begin}..{end} reaches past the end")
                nodes = decode_nodes(first, data)
                u = np.repeat([x for x, _ in nodes], [len(v) for _, v in nodes]).astype(np.int64)
                v = np.concatenate([v for _, v in nodes]) if nodes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v.astype(np.int64))], names=["u", "v"])

    return blocks.select("path", "first_node", "begin", "end").repartition("begin").mapInArrow(run, "u long, v long")


def encode_blocks(adjacency: DataFrame, nodes_per_block: int = 65536, num_nodes: int | None = None) -> DataFrame:
    """adjacency (node, nbrs) with every node once -> (block_no, first_node, data); nodes absent from it have degree 0.

    With num_nodes, blocks go on to that node, empty ones included; else the last block ends with the last node.
    """
    spark = adjacency.sparkSession

    def run(batches):
        for b in batches:
            out = []
            for no, held in zip(b.column("block_no").to_pylist(), b.column("held").to_pylist()):
                have, first = {h["node"]: h["nbrs"] for h in held or []}, no * nodes_per_block
                end = min(first + nodes_per_block, num_nodes) if num_nodes else max(have) + 1
                out.append((no, first, encode_nodes([sorted(have.get(i, [])) for i in range(first, end)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["block_no", "first_node", "data"])

    per = adjacency.groupBy(F.floor(F.col("node") / nodes_per_block).cast("long").alias("block_no")).agg(F.collect_list(F.struct("node", "nbrs")).alias("held"))
    if num_nodes:
        per = spark.range(-(-num_nodes // nodes_per_block)).withColumnRenamed("id", "block_no").join(per, "block_no", "left")
    return per.mapInArrow(run, "block_no long, first_node long, data binary")


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed result table; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_results_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """Known columns first, the others by name."""
    rest = sorted(c for c in df.columns if c not in first)
    df.select(*[c for c in first if c in df.columns], *rest).write.mode("overwrite").option("header", True).csv(path)
