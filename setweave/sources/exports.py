"""Exports for other tools: CSR vectors, inverted indexes, block-compressed streams.

Tables are cut into ranges of their order; every task writes the raw values of its range as a part file, and the
parts are then joined, header first, as a stream of fixed memory. Counts are checked on the way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import graph, retrieval
from setweave.operators.order import global_index, prefix_sum
from setweave.session import drop_path, materialize
from setweave.sources.files import RANGE, VECTORS, encode_blocks, opened, read_blocks, read_scalar, vector, write_scalar

_CHUNK = 1 << 23


def _stream(uri: str) -> Iterator[bytes]:
    with opened(uri) as f:
        while data := f.read(_CHUNK):
            yield data


def _join(spark: SparkSession, parts: list[str], out: str, head: bytes = b"") -> int:
    """One file of the head and the parts one after another; the parts are removed. Bytes without the head."""
    total = 0
    with opened(out, "wb") as f:
        f.write(head)
        for p in parts:
            for data in _stream(p):
                f.write(data)
                total += len(data)
    for p in parts:
        drop_path(spark, p)
    return total


def write_vector(values: DataFrame, out: str, layout: str = "int32") -> int:
    """values (pos, value), pos 0.. without gaps -> a vector file; the number of values."""
    counted, kind = VECTORS[layout]
    limits = np.iinfo(np.dtype(kind))

    def run(batches):
        part, n, first = TaskContext.get().partitionId(), 0, None
        name = f"{out}.part-{part:06d}"
        with opened(name, "wb") as f:
            for b in batches:
                v, pos = b.column("value").to_numpy(), b.column("pos").to_numpy()
                if len(v):
                    first = int(pos[0]) if first is None else first
                    if v.min() < limits.min or v.max() > limits.max or (pos != first + n + np.arange(len(v))).any():
                        raise ValueError(f"{out}: a value that does not fit {kind}, or a gap in the order")
                    f.write(v.astype(kind).tobytes())
                    n += len(v)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first if n else -1]), pa.array([n])], names=["name", "first", "n"])

    ordered = values.select("pos", "value").repartitionByRange("pos").sortWithinPartitions("pos")
    written = sorted(ordered.mapInArrow(run, "name string, first long, n long").collect(), key=lambda r: (r.first, r.name))  # a row a task
    total = 0
    for r in written:
        if r.n and r.first != total:
            raise ValueError(f"{out}: part {r.name} begins at {r.first}, not {total}")
        total += r.n
    size = _join(values.sparkSession, [r.name for r in written], out, total.to_bytes(8, "little") if counted else b"")
    if size != total * np.dtype(kind).itemsize:
        raise ValueError(f"{out}: {size} bytes for {total} values")
    return total


def _write_lines(lines: DataFrame, outs: dict[str, str]) -> int:
    """lines (src, dst) in their order, sorted once, as an int32 vector file for each column named; the number of lines."""
    limits = np.iinfo(np.int32)

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        with ExitStack() as held:
            f = {c: held.enter_context(opened(f"{out}.part-{part:06d}", "wb")) for c, out in outs.items()}
            for b in batches:
                for c in outs:
                    v = b.column(c).to_numpy()
                    if len(v) and (v.min() < limits.min or v.max() > limits.max):
                        raise ValueError(f"{outs[c]}: a value that does not fit int32")
                    f[c].write(v.astype("<i4").tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], names=["part", "n"])

    ordered = lines.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    written = sorted(ordered.mapInArrow(run, "part long, n long").collect())  # a row a task; ranges are numbered in their order
    total = sum(r.n for r in written)
    for out in outs.values():
        if (size := _join(lines.sparkSession, [f"{out}.part-{r.part:06d}" for r in written], out, total.to_bytes(8, "little"))) != 4 * total:
            raise ValueError(f"{out}: {size} bytes for {total} values")
    return total


def _offsets(degrees: DataFrame) -> DataFrame:
    """degrees (id, deg), ids 0.. -> (pos, value): where each id begins, and the end of the last."""
    begun = materialize(prefix_sum(degrees, [F.asc("id")], "deg", "begin"), "offsets")
    end = begun.agg(F.count("*").alias("pos"), F.coalesce(F.sum("deg"), F.lit(0)).cast("long").alias("value"))
    return begun.select(F.col("id").alias("pos"), F.col("begin").alias("value")).unionByName(end)


def _dense(edges: DataFrame, both: bool) -> tuple[DataFrame, int]:
    """(lines (src, dst) with dense ids, number of nodes): both directions, or src < dst."""
    ids = materialize(graph.dense_ids(edges), "ids")
    e = edges.join(ids.toDF("src", "_s"), "src").join(ids.toDF("dst", "_d"), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"))
    return (graph.symmetric(e) if both else e), ids.count()


def export_csr(edges: DataFrame, folder: str, oriented: bool = False) -> None:
    """Undirected edges (src < dst) as csr_cols, csr_offsets, num_nodes and num_edges, and vertexs unless oriented.

    Nodes get dense ids in their order. Oriented files hold the neighbours of greater id only, and end in _tri.
    """
    lines, n = _dense(edges, not oriented)
    spark, tail = edges.sparkSession, "_tri" if oriented else ""
    lines = materialize(lines, "csr")
    m = _write_lines(lines, {"dst": f"{folder}/csr_cols{tail}.bin"} | ({} if oriented else {"src": f"{folder}/vertexs.bin"}))
    deg = spark.range(n).join(lines.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left").fillna(0, ["deg"])
    write_vector(_offsets(deg), f"{folder}/csr_offsets{tail}.bin")
    write_scalar(n, f"{folder}/num_nodes{tail}.bin")
    write_scalar(m, f"{folder}/num_edges{tail}.bin")


def export_index(docs: DataFrame, queries: DataFrame, folder: str, terms_kept: float = 0.0001) -> None:
    """docs (doc, text) and queries (query, text) as inverted_index, its offsets, query, its offsets and their numbers.

    Documents and queries are numbered in the order of their ids; document numbers are then dispersed by a step
    coprime to their count, applied twice. The terms of lowest idf leave; the rest get dense ids in their order.
    """
    spark = docs.sparkSession
    numbered = materialize(global_index(docs, [F.asc("doc")], "id").select("id", "text"), "documents")
    count = numbered.count()
    p = materialize(retrieval.postings(numbered.withColumnRenamed("id", "doc")), "postings")
    v = materialize(retrieval.vocabulary(p), "vocabulary")
    kept = materialize(global_index(retrieval.drop_low_idf(v, v.count(), terms_kept).select("term", "df"), [F.asc("term")], "term_id"), "terms")
    rows = p.join(kept.select("term", "term_id"), "term").select("term_id", F.col("doc").alias("id"))
    rows = graph.permuted(rows, count, 2)
    placed = materialize(global_index(rows, [F.asc("term_id"), F.asc("id")], "pos"), "index")
    write_vector(placed.select("pos", F.col("permuted").alias("value")), f"{folder}/inverted_index.bin")
    write_vector(_offsets(kept.select(F.col("term_id").alias("id"), F.col("df").alias("deg"))), f"{folder}/inverted_index_offsets.bin")
    write_scalar(kept.count(), f"{folder}/inverted_index_num.bin")
    q = materialize(global_index(queries, [F.asc("query")], "id").select("id", "text"), "queries")
    terms = retrieval.query_terms(q.withColumnRenamed("id", "query"), kept)
    placed = materialize(global_index(terms.withColumnRenamed("pos", "place"), [F.asc("query"), F.asc("place")], "pos"), "query")
    write_vector(placed.select("pos", F.col("term_id").alias("value")), f"{folder}/query.bin")
    size = q.select("id").join(placed.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("deg")), "id", "left").fillna(0, ["deg"])
    write_vector(_offsets(size), f"{folder}/query_offsets.bin")
    write_scalar(size.count(), f"{folder}/query_num.bin")


def export_partitions(edges: DataFrame, folder: str, parts: int, oriented: bool = False) -> tuple[list[str], list[str], int]:
    """CSR by ranges of the dense ids: per range its columns (int32) and its own offsets (uint32), from 0.

    (column files, offset files, number of nodes). A task writes whole ranges, streaming.
    """
    lines, n = _dense(edges, not oriented)
    ranged = lines.withColumn("part", graph.range_partition(F.col("src"), max(n, 1), parts).cast("int"))
    bounds = [-(-k * n // parts) for k in range(parts + 1)]  # the ids x with x * parts // n = k

    def run(batches):
        part, held = None, None

        def finish():
            held[0].close()
            with opened(f"{folder}/offsets-{part:05d}.bin", "wb") as f:
                f.write(np.concatenate([[0], np.cumsum(held[1])]).astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

        for b in batches:
            p, src, dst = (b.column(c).to_numpy() for c in ("part", "src", "dst"))
            for lo, hi in zip(edges_at := np.flatnonzero(np.diff(p, prepend=-1)), np.append(edges_at[1:], len(p))):
                if p[lo] != part:
                    if held:
                        yield finish()
                    part = int(p[lo])
                    held = (opened(f"{folder}/cols-{part:05d}.bin", "wb"), np.zeros(bounds[part + 1] - bounds[part], np.int64))
                held[0].write(dst[lo:hi].astype("<i4").tobytes())
                np.add.at(held[1], src[lo:hi] - bounds[part], 1)
        if held:
            yield finish()

    done = {r.part for r in ranged.repartition("part").sortWithinPartitions("part", "src", "dst").select("part", "src", "dst").mapInArrow(run, "part int").collect()}
    for k in set(range(parts)) - done:  # ranges without a line
        opened(f"{folder}/cols-{k:05d}.bin", "wb").close()
        with opened(f"{folder}/offsets-{k:05d}.bin", "wb") as f:
            f.write(bytes(4 * (bounds[k + 1] - bounds[k] + 1)))
    return [f"{folder}/cols-{k:05d}.bin" for k in range(parts)], [f"{folder}/offsets-{k:05d}.bin" for k in range(parts)], n


def merge_partitions(spark: SparkSession, cols: list[str], offsets: list[str], n: int, folder: str) -> int:
    """Join range files into csr_cols.bin (int32) and csr_offsets.bin (int64) of n nodes; the number of columns.

    Offsets that do not begin with 0 or are cut off, a number of nodes other than n, and columns that disagree with
    the offsets are errors.
    """
    before, nodes = 0, 0
    with opened(f"{folder}/csr_offsets.bin", "wb") as f:
        f.write((n + 1).to_bytes(8, "little") + bytes(8))
        for name in offsets:
            first, rest, last = True, b"", 0
            for data in _stream(name):
                data = rest + data
                rest = data[len(data) - len(data) % 4 :]
                v = np.frombuffer(data[: len(data) - len(rest)], "<u4").astype("<i8")
                if first and (not len(v) or v[0] != 0):
                    raise ValueError(f"{name}: offsets begin with 0")
                v, first = v[1:] if first else v, False
                f.write((v + before).tobytes())
                nodes, last = nodes + len(v), int(v[-1]) if len(v) else last
            if first or rest:
                raise ValueError(f"{name}: empty, or cut off")
            before += last
    if nodes != n:
        raise ValueError(f"offsets of {nodes} nodes, not {n}")
    sizes = 0
    for name in cols:
        with opened(name) as f:
            sizes += f.size()
    if sizes != 4 * before:
        raise ValueError(f"{sizes} bytes of columns for {before} offsets")
    _join(spark, cols, f"{folder}/csr_cols.bin", before.to_bytes(8, "little"))
    return before


def write_stream(adjacency: DataFrame, folder: str, num_nodes: int, nodes_per_block: int = 65536) -> None:
    """adjacency (node, nbrs) as a block-compressed column stream with block_offsets, num_nodes and num_edges."""
    spark = adjacency.sparkSession
    blocks = materialize(encode_blocks(adjacency, nodes_per_block, num_nodes), "blocks")

    def run(batches):
        part, first = TaskContext.get().partitionId(), -1
        name = f"{folder}/stream.part-{part:06d}"
        with opened(name, "wb") as f:
            for b in batches:
                for no, data in zip(b.column("block_no").to_pylist(), b.column("data").to_pylist()):
                    first = no if first < 0 else first
                    f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first])], names=["name", "first"])

    ordered = blocks.select("block_no", "data").repartitionByRange("block_no").sortWithinPartitions("block_no")
    parts = sorted(ordered.mapInArrow(run, "name string, first long").collect(), key=lambda r: (r.first, r.name))
    size = _join(spark, [r.name for r in parts], f"{folder}/stream.bin")
    written = write_vector(_offsets(blocks.select(F.col("block_no").alias("id"), F.length("data").cast("long").alias("deg"))), f"{folder}/block_offsets.bin", "int64")
    if written != -(-num_nodes // nodes_per_block) + 1:
        raise ValueError(f"{written} block offsets for {num_nodes} nodes")
    m = adjacency.agg(F.coalesce(F.sum(F.size("nbrs")), F.lit(0)).alias("m")).first().m
    write_scalar(num_nodes, f"{folder}/num_nodes.bin", "uint64")
    write_scalar(m, f"{folder}/num_edges.bin", "uint64")
    write_scalar(size, f"{folder}/num_bytes.bin", "uint64")


def read_stream(spark: SparkSession, folder: str, nodes_per_block: int = 65536) -> DataFrame:
    """Edges (u, v) of a block-compressed column stream, one task a block."""
    n = read_scalar(f"{folder}/num_nodes.bin", "uint64")
    o = materialize(vector(spark, f"{folder}/block_offsets.bin", "int64").select("pos", "value"), "block_offsets")
    if o.count() != -(-n // nodes_per_block) + 1:
        raise ValueError(f"{folder}: block offsets and number of nodes disagree")
    after = o.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    blocks = o.join(after, "pos").select(F.lit(f"{folder}/stream.bin").alias("path"), (F.col("pos") * nodes_per_block).alias("first_node"), F.col("value").alias("begin"), "end")
    return read_blocks(spark, blocks)


def read_csr(spark: SparkSession, folder: str, tail: str = "") -> DataFrame:
    """Edges (u, v) of CSR files: a task reads a range of the columns and the offsets that cut it; nothing is joined.

    Offsets that do not end with the number of columns are an error.
    """
    cols, offsets = f"{folder}/csr_cols{tail}.bin", f"{folder}/csr_offsets{tail}.bin"
    with opened(cols) as f, opened(offsets) as g:
        (m, n), sizes = (int.from_bytes(x.read_at(8, 0), "little") for x in (f, g)), (f.size(), g.size())
        last = int.from_bytes(g.read_at(4, sizes[1] - 4), "little", signed=True) if n else 0
    if sizes != (8 + 4 * m, 8 + 4 * n) or last != m:
        raise ValueError(f"{folder}: {m} columns, offsets up to {last}, or count and length disagree")

    def run(batches):
        for b in batches:
            for lo in b.column(0).to_pylist():
                with opened(cols) as f, opened(offsets) as g:
                    v = np.frombuffer(f.read_at(4 * min(RANGE, m - lo), 8 + 4 * lo), "<i4").astype(np.int64)
                    at = lambda i: int.from_bytes(g.read_at(4, 8 + 4 * i), "little", signed=True)  # noqa: E731,B023
                    first = bisect_right(range(n), lo, key=at) - 1
                    end = bisect_left(range(n), lo + len(v), key=at)
                    o = np.frombuffer(g.read_at(4 * (end - first + 1), 8 + 4 * first), "<i4").astype(np.int64)
                u = np.repeat(np.arange(first, end), np.diff(np.clip(o, lo, lo + len(v))))
                for k in range(0, len(v), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["u", "v"])

    starts = spark.range(0, max(m, 1), RANGE, -(-max(m, 1) // RANGE)) if m else spark.range(0)
    return starts.mapInArrow(run, "u long, v long")
