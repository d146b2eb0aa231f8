"""Round trips of files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from setweave.operators import graph
from setweave.plans import build
from setweave.sources import catalogue, exports, files


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.edges").write_text("# x\n1 2 0.5\n2\t3\n7 7\nbad line\n5\n\n")
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "a.edges")).collect())) == [(1, 2), (2, 3)]
    (tmp_path / "b.tsv").write_text("% c\n4 4 9\n2 3 1\n1 2 1\n")
    assert sorted(map(tuple, files.weighted_tsv(spark, str(tmp_path / "b.tsv")).collect())) == [(1, 2), (2, 3)]
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "text": "t"}\n\nnot json\n{"_id": "2"}\n')
    assert sorted((r._id, r.text) for r in files.json_lines(spark, str(tmp_path / "c.jsonl")).collect()) == [("1", "t"), ("2", None)]


@pytest.mark.parametrize("layout", list(files.VECTORS))
def test_vectors(spark, tmp_path, layout):
    values = [5, 3 if layout == "raw_uint32" else -3, 2**31 - 1, 0]
    files.write_vector(values, str(tmp_path / "v.bin"), layout)
    assert [r.value for r in files.vector(spark, str(tmp_path / "v.bin"), layout).orderBy("pos").collect()] == values


def test_blocks_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    adjacency = [(n, sorted(rnd.sample(range(100_000), rnd.randrange(9)))) for n in range(40) if n % 7]
    blocks = files.encode_blocks(spark.createDataFrame(adjacency, "node long, nbrs array<long>"), 16).orderBy("block_no").collect()
    path, rows, at = tmp_path / "cols.bin", [], 0
    path.write_bytes(b"".join(bytes(b.data) for b in blocks))
    for b in blocks:
        rows.append((str(path), b.first_node, at, at + len(b.data)))
        at += len(b.data)
    got = files.read_blocks(spark, spark.createDataFrame(rows, "path string, first_node long, begin long, end long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, v) for n, nbrs in adjacency for v in nbrs)
    with pytest.raises(ValueError):
        files.decode_nodes(0, b"\x82")


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "b int, z double, a string")
    files.write_results_csv(df, str(tmp_path / "r"), ["b"])
    back = files.results_csv(spark, str(tmp_path / "r"), "b int, a string, z double")
    assert [tuple(r) for r in back.collect()] == [(1, "x", None)]


def test_vectors_in_ranges(spark, tmp_path, monkeypatch):
    """Ranges of a long file, exported from a table, and what is wrong with files and tables."""
    monkeypatch.setattr(files, "RANGE", 100)
    values = spark.range(1050).select(F.col("id").alias("pos"), (F.col("id") * 7 % 1000).alias("value")).repartition(5)
    out = str(tmp_path / "v.bin")
    assert exports.write_vector(values, out) == 1050
    assert [r.value for r in files.vector(spark, out).orderBy("pos").collect()] == [i * 7 % 1000 for i in range(1050)]
    assert exports.write_vector(values.limit(0), out) == 0 and files.vector(spark, out).count() == 0
    for bad in (values.where("pos <> 500"), values.withColumn("value", F.col("value") + 2**31)):
        with pytest.raises(Exception, match="does not fit|begins at"):
            exports.write_vector(bad, out)
    (tmp_path / "w.bin").write_bytes((3).to_bytes(8, "little") + bytes(8))
    with pytest.raises(Exception, match="disagree"):
        files.vector(spark, str(tmp_path / "w.bin")).count()
    files.write_scalar(0.25, out, "float32")
    assert files.read_scalar(out, "float32") == 0.25
    with pytest.raises(ValueError):
        files.read_scalar(out, "uint64")


def small_graph(spark):
    rnd = random.Random(6)
    return graph.undirected(spark.createDataFrame([(rnd.randrange(40), rnd.randrange(40)) for _ in range(90)], "a long, b long"), "a", "b")


def test_csr_and_ranges(spark, tmp_path):
    e, folder = small_graph(spark), str(tmp_path / "csr")
    exports.export_csr(e, folder)
    ids = {x: i for i, x in enumerate(sorted({v for r in e.collect() for v in r}))}
    want = {(ids[a], ids[b]) for r in e.collect() for a, b in ((r.src, r.dst), (r.dst, r.src))}
    got = [tuple(r) for r in exports.read_csr(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want) == files.read_scalar(f"{folder}/num_edges.bin") and files.read_scalar(f"{folder}/num_nodes.bin") == len(ids)
    cols, offsets, n = exports.export_partitions(e, str(tmp_path / "ranges"), 7)
    assert exports.merge_partitions(spark, cols, offsets, n, str(tmp_path / "ranges")) == len(want)
    assert (tmp_path / "ranges/csr_cols.bin").read_bytes() == (tmp_path / "csr/csr_cols.bin").read_bytes()
    with pytest.raises(ValueError, match="nodes"):
        exports.merge_partitions(spark, [], offsets, n + 1, str(tmp_path / "ranges"))
    (tmp_path / "o.bin").write_bytes(b"\x01\0\0\0")
    with pytest.raises(ValueError, match="begin with 0"):
        exports.merge_partitions(spark, [], [str(tmp_path / "o.bin")], 0, str(tmp_path / "ranges"))


def test_csr_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "RANGE", 7)
    e, folder = small_graph(spark), str(tmp_path)
    exports.export_csr(e, folder)
    exports.export_csr(e, folder, oriented=True)
    ids = {x: i for i, x in enumerate(sorted({v for r in e.collect() for v in r}))}
    up = sorted((ids[r.src], ids[r.dst]) for r in e.collect())
    assert sorted(map(tuple, exports.read_csr(spark, folder, "_tri").collect())) == up
    both = exports.read_csr(spark, folder)
    assert [tuple(r) for r in both.collect()] == sorted(up + [(b, a) for a, b in up])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    exports.export_csr(e.limit(0), str(tmp_path / "none"))
    assert exports.read_csr(spark, str(tmp_path / "none")).count() == 0
    files.write_vector([0, 3], f"{folder}/csr_offsets.bin")
    with pytest.raises(ValueError, match="offsets up to 3"):
        exports.read_csr(spark, folder)


def test_stream(spark, tmp_path):
    adjacency = spark.createDataFrame([(3, [9, 1]), (17, [2]), (40, [])], "node long, nbrs array<long>")
    exports.write_stream(adjacency, str(tmp_path), 100, 16)
    assert sorted(map(tuple, exports.read_stream(spark, str(tmp_path), 16).collect())) == [(3, 1), (3, 9), (17, 2)]
    assert files.read_scalar(f"{tmp_path}/num_edges.bin", "uint64") == 3
    with pytest.raises(ValueError, match="disagree"):
        exports.read_stream(spark, str(tmp_path), 8)


def test_build_all(spark, tmp_path):
    (tmp_path / "in/g").mkdir(parents=True)
    (tmp_path / "in/g/a.edges").write_text("1 2\n2 3\n")
    (tmp_path / "in/g/b.txt").write_text("# more\n3 1\n")
    (tmp_path / "in/t").mkdir()
    (tmp_path / "in/t/corpus.jsonl").write_text("".join(json.dumps({"_id": str(i), "text": t}) + "\n" for i, t in enumerate(["a b", "b c", "c"])))
    (tmp_path / "in/t/queries.jsonl").write_text('{"_id": "q", "text": "C a zzz"}\n{"_id": "r", "text": ""}\n')
    done = build.build_all(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert done == {"g/sss": True, "g/tc": True, "t/ir": True}
    assert build.build_all(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {k: False for k in done}
    assert files.read_scalar(str(tmp_path / "out/g/tc/num_edges_tri.bin")) == 3
    read = lambda n: [r.value for r in files.vector(spark, str(tmp_path / f"out/t/ir/{n}.bin")).orderBy("pos").collect()]
    assert read("inverted_index_offsets") == [0, 1, 3, 5] and read("query") == [0, 2] and read("query_offsets") == [0, 2, 2]
    with pytest.raises(ValueError):
        build.processor("other")


def test_config_and_reports(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": {"c": 3}}, "x": null}')
    c = catalogue.load_config(str(tmp_path / "c.json"))
    assert catalogue.setting(c, "a.b.c") == 3 and catalogue.setting(c, "a.q.c", 7) == 7 and catalogue.setting(c, "x", 1) is None
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        catalogue.load_config(str(tmp_path / "list.json"))
    (tmp_path / "r.txt").write_text("Dataset  Time  Sec\n-----\nwt  1.5/2.5  7\nshort\n\n")
    assert [tuple(r) for r in files.summary_rows(spark, str(tmp_path / "r.txt"), ["dataset", "time", "sec"], ["time"]).collect()] == [("wt", "1.5", "2.5", "7")]
