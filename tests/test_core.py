"""Operators of the core on small fixtures and against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from setweave.catalog import QUERIES, SQL, reports
from setweave.functions import bits
from setweave.functions.text import graph_name, slug, tokens
from setweave.operators import diagnostics, graph, heavy, matching, order, patterns, results, retrieval, setops, skew, solver, tree
from setweave.operators.components import connected_components
from setweave.session import materialize

EDGES = "a long, b long"


def graph_of(spark, pairs):
    return graph.undirected(spark.createDataFrame(pairs, EDGES), "a", "b")


def complete(n):
    return list(itertools.combinations(range(1, n + 1), 2))


def one(df):
    return df.first().n


def test_tokens_match_python(spark):
    texts = ["Ére le, x_y — don't", None, "", "    ", "a\tb\r\nc\x85d　e", "éx Straße ÅB ١٢ 顶点，x", "x" * 100_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tokens(F.col("text")).alias("t")).collect()
    for r in rows:
        # In Python \w lacks combining marks just as [LN_] does.
        assert r.t == [x for x in (re.sub(r"[^\w]", "", w).lower() for w in (texts[r.i] or "").split()) if x]


def test_clean_edges(spark):
    dirty = [(1, 2), (2, 1), (1, 2), (7, 7), (None, 3), (3, None)]
    assert [tuple(r) for r in graph_of(spark, dirty).collect()] == [(1, 2)]


@pytest.mark.parametrize("pairs,counts", [(complete(3), (1, 0, 0)), (complete(4), (4, 1, 0)), (complete(5), (10, 5, 1)), ([(0, i) for i in range(1, 6)], (0, 0, 0)), ([], (0, 0, 0))])
def test_cliques(spark, pairs, counts):
    g = graph_of(spark, pairs)
    assert tuple(one(patterns.clique_count(g, k)) for k in (3, 4, 5)) == counts


def brute(pairs, shape, nodes):
    """Distinct subgraphs of the shape (pairs of 0..nodes-1)."""
    e = {frozenset(p) for p in pairs}
    all_nodes = sorted({x for p in pairs for x in p})
    return len({frozenset(frozenset((m[a], m[b])) for a, b in shape) for m in itertools.permutations(all_nodes, nodes) if all(frozenset((m[a], m[b])) in e for a, b in shape)})


def test_patterns_against_brute_force(spark):
    rnd = random.Random(5)
    pairs = [p for p in complete(8) if rnd.random() < 0.65]
    g = graph_of(spark, pairs).cache()
    k4 = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert one(patterns.four_cycles(g)) == brute(pairs, [(0, 1), (0, 2), (1, 3), (2, 3)], 4)
    assert one(patterns.diamonds(g)) == brute(pairs, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 4)
    assert one(patterns.clique_count(g, 4)) == brute(pairs, k4, 4)
    assert one(patterns.k4_with_triangle(g)) == brute(pairs, [*k4, (0, 4), (1, 4)], 5)
    assert one(patterns.k23_with_edge(g)) == brute(pairs, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 4), (3, 4)], 5)
    r = patterns.k5_minus_edge(g).first()
    assert r.distinct_count == brute(pairs, [p for p in itertools.combinations(range(5), 2) if p != (3, 4)], 5) and r.n == 3 * r.distinct_count
    assert one(patterns.clique_count(graph_of(spark, complete(7)), 6)) == 7


def test_passes_agree(spark, monkeypatch):
    """Lists go to the other end in bounded passes, and the end with the shorter list sends it."""
    rnd = random.Random(11)
    g = graph_of(spark, [p for p in complete(14) if rnd.random() < 0.7])
    written = []
    want = [one(patterns.clique_count(g, k)) for k in (3, 4, 5, 6)], sorted(tuple(r) for r in patterns.support(g).collect())
    monkeypatch.setattr(patterns, "PASS", 16)
    monkeypatch.setattr(patterns, "EDGE", 1)
    monkeypatch.setattr(patterns, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    assert ([one(patterns.clique_count(g, k)) for k in (3, 4, 5, 6)], sorted(tuple(r) for r in patterns.support(g).collect())) == want
    assert written.count("pass") > 10
    e = {tuple(r) for r in g.collect()}
    assert want[0] == [sum(all(p in e for p in itertools.combinations(c, 2)) for c in itertools.combinations(range(1, 15), k)) for k in (3, 4, 5, 6)]


def test_similarity_variants_agree(spark):
    rnd = random.Random(2)
    g = graph_of(spark, [(rnd.randrange(30), rnd.randrange(30)) for _ in range(150)]).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(patterns.similar_edges(g, 0.25)) == rows(patterns.similar_edges_partitioned(g, 0.25, 2)) == rows(patterns.similar_edges_partitioned(g, 0.25, 7))
    assert rows(patterns.support(g)) == rows(patterns.support_by_bitmap(g))
    assert sum(r.n for r in patterns.triangles_partitioned(g, 3).collect()) == one(patterns.clique_count(g, 3))


def test_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, x long")
    assert [r.at for r in order.global_index(df, [F.asc("k")], "at").orderBy("k").collect()] == list(range(101))
    got = order.prefix_sum(df, [F.asc("k")], "x", "s").orderBy("k").collect()
    assert all(b.s == a.s + a.x for a, b in zip(got, got[1:])) and got[0].s == 0


def test_running_sum(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(50)], "g string, x long").withColumn("h", F.xxhash64("x", "g"))
    for r in skew.running_sum(df, ["g"], "h", "x", "s", 7).groupBy("g").agg(F.max(F.col("s") + F.col("x")).alias("top"), F.min("s").alias("low")).collect():
        assert (r.top, r.low) == (1225, 0)


def test_skew_join_and_sift(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 0)], "k long, x long")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    per = counts.where("k is not null").select("k", F.col("n").alias("m"))
    assert skew.skew_join(rows, per, "k", counts).count() == 300
    wanted = spark.createDataFrame([(3,), (1,)], "k long")
    kept = {r.k for r in skew.sift(rows, "k", wanted, bits=20).collect()}
    assert {1, 3} <= kept and None not in kept and len(kept) < 5


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, EDGES)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], EDGES)).count() == 0


E_COLS = "u long, v long, shard string, seen_at timestamp, loaded_at timestamp, _chunk int, n_rows string"


def test_tree_aggregation(spark):
    rows = [(7 if i % 2 else i, i % 10, "s", None, None, 0, "x") for i in range(1000)] + [(None, 1, None, None, None, 0, None), (5, None, "s", None, None, 0, "")]
    df = spark.createDataFrame(rows, E_COLS).repartition(9)
    for fan_in in (2, 3, 8):
        got = {r.u: r.n for r in tree.tree_aggregate(df, ["u"], {"n": ("count", F.lit(1))}, fan_in).collect()}
        assert got == {r.u: r["count"] for r in df.groupBy("u").count().collect()}
    assert tree.rounds(1, 8) == 1 and tree.rounds(65, 8) == 3
    assert [(r.u, r.n_rows) for r in heavy.heavy_nodes(df).collect()] == [(7, 500)]
    assert heavy.node_results(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tree.tree_aggregate(df, ["u"], {}, 1)


def test_blocks(spark):
    cols = "shard string, block_no int, first_node long, block_offset long, num_nodes long, num_edges long"
    rows = [("a", 0, 0, 0, 512, None), ("a", 1, 256, 90, 512, 5), ("a", 1, 256, 90, 512, 5), ("a", 2, None, 100, None, 5), (None, 0, 0, 0, 0, 0), ("b", 0, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, cols)
    assert sorted((r.block_no, r.bytes) for r in heavy.block_bytes(df).collect()) == [(0, 90), (1, 10)]
    assert {r.block_no for r in heavy.heavy_blocks(df).collect()} == {0, 1} and heavy.heavy_blocks(df.limit(0)).count() == 0


def test_retrieval(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b"), (2, "B, c!"), (3, None)], "doc int, text string")
    p = retrieval.postings(docs)
    v = retrieval.vocabulary(p)
    q = spark.createDataFrame([(1, "b c"), (2, "zzz"), (3, "a zzz"), (4, None)], "query int, text string")
    terms = retrieval.query_terms(q, v)
    found = retrieval.conjunctive(terms, p)
    long = spark.createDataFrame([(7, "c b a"), (8, "A b")], "query int, text string")
    assert sorted(map(tuple, retrieval.conjunctive(retrieval.query_terms(long, v), p).collect())) == [(7, 0), (8, 0), (8, 1)]
    assert retrieval.conjunctive_partitioned(terms, p, 3).agg(F.sum("hits")).first()[0] == 4
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 2), (3, 0), (3, 1)]
    assert sorted(map(tuple, retrieval.hit_counts(q, found).collect())) == [(1, 2), (2, 0), (3, 2), (4, 0)]
    assert {r.term for r in retrieval.drop_most_frequent(v, 1).collect()} == {"a", "c"}


def test_set_operations(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 3), (2, 4), (None, 1), (1, None)], "set_id long, elem long")
    r = setops.pair_counts(spark.createDataFrame([(1, 2), (1, 9)], EDGES), s).orderBy("b").collect()
    assert [tuple(x) for x in r] == [(1, 2, 1, 4, 1), (1, 9, 0, 2, 2)]
    r = setops.random_sets(spark, 30, 50, 10)
    assert r.count() == 1500 and {x.elem for x in r.collect()} == set(range(11)) and r.groupBy("set_id").count().where("count = 50").count() == 30
    assert r.exceptAll(setops.random_sets(spark, 30, 50, 10)).count() == 0


def test_matches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    rnd = random.Random(4)
    texts = {f"d{i}": " ".join(rnd.choices("abcdefgh", k=rnd.randrange(7))) for i in range(400)}
    asked = {f"q{i}": " ".join(rnd.choices("abcdefghz", k=rnd.randrange(4))) for i in range(20)}
    sets = retrieval.term_sets(spark.createDataFrame(list(texts.items()), "doc string, text string").coalesce(2))
    queries = spark.createDataFrame(list(asked.items()), "query string, text string")
    known = materialize(retrieval.known_sets(queries, sets), "asked")
    need = {q: set(t.split()) - {"z"} for q, t in asked.items()}
    want = sorted((q, d) for q, n in need.items() if n for d, t in texts.items() if n <= set(t.split()))
    assert sorted(map(tuple, retrieval.matches(known, sets).collect())) == want
    counts = {q: sum(x == q for x, _ in want) for q in asked}
    assert {r.query: r.hits for r in retrieval.every_query(queries, retrieval.match_counts(known, sets)).collect()} == counts
    assert sum(r.hits for r in retrieval.match_counts_partitioned(known, sets, 3).collect()) == len(want)
    judged = spark.createDataFrame([(q, d, 1) for q in asked for d in list(texts)[::9]], "query string, doc string, relevance int")
    assert sorted((r.query, r.doc) for r in retrieval.judged_matches(known, sets, judged).collect()) == [x for x in want if x[1] in list(texts)[::9]]


def shuffled_rows(df):
    """Rows that the exchanges of a plan wrote, after it ran."""
    df.collect()
    text, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(text)
    return sum(out)


def test_pairs_of_groups(spark):
    rnd = random.Random(6)
    groups = [(i, i % 3) for i in range(12)] + [(3, 1), (4, 0), (None, 0), (5, None)]
    sets = [(rnd.randrange(11), rnd.randrange(9)) for _ in range(60)] + [(None, 1), (1, None)]
    g, s = spark.createDataFrame(groups, "set_id long, k long"), spark.createDataFrame(sets, "set_id long, elem long")
    x = g.where("set_id is not null")
    pairs = x.toDF("a", "k").join(x.toDF("b", "k"), "k").where("a < b").select("a", "b")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(setops.group_pair_counts(g, s, 4)) == rows(setops.pair_counts(pairs, s)) != []
    # 60 sets of one group, each with 200 members of its own: pairs don't list their members
    apart = spark.range(12_000).selectExpr("id div 200 as set_id", "id as elem")
    one_group = spark.range(60).selectExpr("id as set_id", "0L as k")
    assert shuffled_rows(setops.group_pair_counts(one_group, apart, 2)) < 60_000


def test_pairs_are_counted_in_steps(spark, monkeypatch):
    """Members and counts are written, so the last query does not hold the files of the steps before; members go when counted."""
    written, gone = [], []
    monkeypatch.setattr(setops, "materialize", lambda df, name: written.append(name) or materialize(df, name), raising=False)
    monkeypatch.setattr(setops, "discard", lambda df: gone.append(df.columns), raising=False)
    g = spark.range(4).selectExpr("id as set_id", "0L as k")
    s = spark.range(12).selectExpr("id % 4 as set_id", "id div 5 as elem")
    setops.group_pair_counts(g, s)
    assert written == ["inside", "groups", "shared"] and gone == [["set_id", "k", "elem", "ks"]]


def test_meetings_of_pairs_go_in_passes(spark, monkeypatch):
    """Members that many sets of a group share make many meetings, of which a bounded number is sent at once."""
    written = []
    monkeypatch.setattr(setops, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(setops, "PASS", 5, raising=False)
    monkeypatch.setattr(setops, "MEMBER", 0, raising=False)
    g = spark.range(12).selectExpr("id as set_id", "id % 2 as k").unionByName(spark.range(3).selectExpr("id as set_id", "1L as k"))
    s = spark.range(60).selectExpr("id % 10 as set_id", "(id * id) % 4 as elem").distinct()
    pairs = g.toDF("a", "k").join(g.toDF("b", "k"), "k").where("a < b").select("a", "b")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(setops.group_pair_counts(g, s, 4)) == rows(setops.pair_counts(pairs, s)) != []
    assert written.count("shared") > 1


@pytest.mark.parametrize("name", ["set_difference", "set_intersection_count"])
def test_pair_queries_list_no_members(spark, tmp_path, name):
    spark.range(60).selectExpr("id as s_suppkey", "1 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(12_000).selectExpr("id div 200 as l_suppkey", "id as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    assert shuffled_rows(df) < 60_000
    want = {"set_difference": 200, "set_intersection_count": 0}[name]
    assert df.count() == 60 * 59 // 2 and {r[2] for r in df.collect()} == {want}


@pytest.mark.parametrize("problem,want", [((10_000, 32, 32, 4), (9.006586103162421, 0.25, 8)), ((1_000_000, 32, 128, 4), (4.007380077760372, 0.2, 5))])
def test_solver_golden(problem, want):
    best = min((solver.cost(problem[0], a, b, *problem[1:]), a, b) for a in solver.ALPHAS for b in solver.BUCKETS)
    assert best[1:] == want[1:] and best[0] == pytest.approx(want[0], rel=1e-12)


def test_solver_cache(spark, tmp_path):
    cols = "mode string, size long, w int, s_trans int, s_slot int"
    wanted = spark.createDataFrame([("sss", 50, 32, 32, 4), ("tc", 50, 32, 32, 4), ("ir", 60, 32, 32, 4)], cols)
    path = "file://" + str(tmp_path / "cache")
    c = solver.Recommendations(spark, path)
    assert c.get(wanted).where("alpha = 0 and cost = double('inf')").count() == 3
    assert c.solve(wanted.limit(2)).where("alpha > 0").count() == 2 and c.version == 1
    again = solver.Recommendations(spark, path)
    assert again.missing(wanted).count() == 1 and again.stats().agg(F.sum("entries")).first()[0] == 2
    assert again.precompute([50], [32], [32], [4], ["sss", "tc"]).count() == 2 and again.version == 1  # nothing to do
    again.clear()
    assert solver.Recommendations(spark, path).table().count() == 0
    assert solver.penalty(0.2) == 0 and solver.penalty(0) == solver.FULL and solver.grid(spark, 2).count() == 8


def test_result_store(spark, tmp_path):
    path = "file://" + str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "alpha double, b int, table_type string, cost double")
    s = results.ResultStore(spark, path, ["cost", "kernel_time"])
    s.put(rows((0.1, 1, None, 5.0), (0.1, 2, "N", 4.0), (0.2, 1, "N", 4.0), (0.2, 3, "N", 9.0))).put(rows((0.1, 1, "H", None), (0.2, 3, "N", 8.5), (0.3, 1, "N", float("nan"))))
    t = {(r.alpha, r.b, r.table_type): r.cost for r in results.ResultStore(spark, path, ["cost", "kernel_time"]).table().collect()}
    assert t[(0.1, 1, "N")] == t[(0.1, 1, "H")] == 5.0 and t[(0.2, 3, "N")] == 8.5 and len(t) == 6
    best = {(r.table_type, r.kind, r.alpha, r.b) for r in s.best().collect()}
    assert best == {("N", "global", 0.1, 2), ("N", "local", 0.2, 1), ("H", "global", 0.1, 1)}
    assert '"total_rows":5' in s.summary().where("table_type = 'N'").first().json
    assert results.ResultStore(spark, path + "-none", ["cost"]).best().count() == 0


def test_bin_edges(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "v double")
    edges = lambda d, *a, **k: [r.edge for r in results.bin_edges(d, "v", *a, **k).orderBy("i").collect()]
    assert edges(df(), 4) == edges(df(None, float("nan")), 4) == [0.0, 1.0] and edges(df(3.0, 3.0), 4) == [3.0, 4.0]
    values = [float(i) for i in range(101)]
    assert edges(df(*values), 4, clip=(0, 1)) == [0, 25, 50, 75, 100] and edges(df(*values), 2, "linear", (0.1, 0.9), False) == [0, 10, 50, 90, 100]
    logs = edges(df(*[10.0**k for k in range(5)], -1.0), 2, "log-quantile", (0, 1))
    assert logs == pytest.approx([1, 100, 10_000])
    assert edges(df(1.0, 1.0, 1.0, 2.0), 4, clip=(0, 1)) == [1.0, 1.25, 2.0] or len(set(edges(df(1.0, 1.0, 1.0, 2.0), 4, clip=(0, 1)))) > 1
    with pytest.raises(ValueError):
        results.bin_edges(df(1.0), "v", 2, "other")


def test_displacement_against_insertion(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for t in range(30):
        size, slots = rnd.choice([8, 16]), 3
        keys = [rnd.randrange(size) if rnd.random() < 0.6 else size - 1 for _ in range(rnd.randrange(1, size * slots))]
        used, moves = [0] * size, 0
        for k in keys:
            while used[k] == slots:
                k, moves = (k + 1) % size, moves + 1
            used[k] += 1
        want[t] = moves
        rows += [(t, size, k, keys.count(k)) for k in set(keys)]
    got = diagnostics.displacement(spark.createDataFrame(rows, "set long, len long, bucket long, n long"), 3)
    assert {r.set: r.displaced for r in got.collect()} == want and max(want.values()) > 10


def test_general_matcher(spark):
    rnd = random.Random(7)
    pairs = [p for p in complete(8) if rnd.random() < 0.6]
    g = graph_of(spark, pairs).cache()
    shapes = {"Q0": [(0, 1), (0, 2), (1, 2)], "Q1": [(0, 1), (0, 2), (1, 3), (2, 3)], "Q2": [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], "Q6": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 4), (3, 4)]}
    nodes = {"Q0": 3, "Q1": 4, "Q2": 4, "Q6": 5}
    for q, shape in shapes.items():
        assert one(matching.match_count(g, matching.PATTERNS[q])) == brute(pairs, shape, nodes[q])
    path = matching.Pattern([0, 1], [0, 1, 2], [-1, -1, 0], distinct=True)
    assert one(matching.match_count(g, path)) == brute(pairs, [(0, 1), (1, 2)], 3) == matching.match_rows(g, path).count()
    assert one(matching.match_count(graph_of(spark, []), path)) == 0
    for wrong in (matching.Pattern([1], [0, 1]), matching.Pattern([0, -1], [0, 1, 2]), matching.Pattern([0], [0, 1, 1])):
        with pytest.raises(ValueError):
            matching.match_count(g, wrong)


def test_hashes(spark):
    def mix(h):
        h ^= h >> 16
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        h = h * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    keys = [0, 1, 2, 12345, 2**31 - 1, 2**32 - 1]
    assert [r.h for r in spark.createDataFrame([(k,) for k in keys], "k long").select(bits.mix32(F.col("k")).alias("h")).collect()] == [mix(k) for k in keys]


def test_membership_and_names(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "set_id long, elem long")
    new = spark.createDataFrame([(1, 2), (2, 9), (2, None)], "set_id long, elem long")
    assert sorted(map(tuple, setops.insert(s, new).collect())) == [(1, 1), (1, 2), (2, 9)]
    assert [tuple(r) for r in setops.remove(s, new).collect()] == [(1, 1)]
    assert {tuple(r) for r in setops.contains(s, new).collect()} == {(1, 2, True), (2, 9, False), (2, None, False)}
    assert [tuple(r) for r in setops.fill(s, 0.2, 5).collect()] == [(1, 2, 40, 0.05)]
    names = spark.createDataFrame([("web-a_adj.mtx.gz",), ("b_adj",), ("c",), (None,)], "n string")
    assert [r[0] for r in names.select(graph_name(F.col("n"))).collect()] == ["web-a", "b", "c", None]
    assert [r[0] for r in names.select(slug(F.col("n"))).collect()] == ["web_a_adj_mtx_gz", "b_adj", "c", None]


def test_large_components_and_few_edges_agree(spark):
    rnd = random.Random(9)
    e = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)], EDGES)
    rows = lambda few: sorted(map(tuple, connected_components(e, few=few).collect()))
    assert rows(0) == rows(10**6)


def test_registry():
    assert "tc_count" in QUERIES and set(SQL) <= set(QUERIES)


def test_clique_patterns_over_a_view_with_cliques(spark, tmp_path):
    """K7 as (l_partkey, l_suppkey); the orders hold none of it."""
    rows = [(1000 + i, a, b) for i, (a, b) in enumerate(complete(7))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    shapes = {"match_q4_ps": 630, "match_q5_ps": 21, "match_q6_ps": 630, "match_q7_ps": 7, "match_q8_ps": 210}
    assert {q: QUERIES[q](spark, str(tmp_path)).first().distinct_count if q == "match_q8_ps" else one(QUERIES[q](spark, str(tmp_path))) for q in shapes} == shapes


@pytest.mark.parametrize("name", ["match_q0", "match_q3", "match_q5_ps", "match_q7_ps", "tc_consistency"])
def test_cliques_broadcast_no_table(spark, tmp_path, monkeypatch, name):
    """Joins of clique queries with tables that grow are merge joins, in written steps too; files small on disk hold long lists."""
    rows = [(1000 + i, a, b) for i, (a, b) in enumerate(complete(7))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans = []
    seen = lambda df, table: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, table)
    for module in (patterns, matching, reports, order):
        monkeypatch.setattr(module, "materialize", seen, raising=False)
    df = QUERIES[name](spark, str(tmp_path))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    keys = {k for p in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)", p)}
    # Ranges of the ranks have one row a shuffle partition.
    assert any("SortMergeJoin" in p for p in plans) and keys <= {"_p"}


def exchanged_rows(df):
    """Rows that the shuffles of a plan wrote, after it ran; unlike shuffled_rows it looks below the result stage of Spark 4.1."""
    df.collect()
    out = 0

    def walk(node):
        nonlocal out
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out += node.metrics().apply("shuffleRecordsWritten").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_bitmaps_send_no_neighbourhoods(spark, monkeypatch):
    """1000 sets of 20 members of their own choice out of 800: edges don't send the words of their ends' neighbourhoods."""
    rnd = random.Random(8)
    g = materialize(graph_of(spark, [(s, m) for s in range(1000, 2000) for m in rnd.sample(range(800), 20)] + [(1000, 1001), (1001, 1002), (1000, 1002)]), "sets")
    written = []
    monkeypatch.setattr(patterns, "materialize", lambda df, name: written.append(exchanged_rows(df)) or materialize(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = patterns.support_by_bitmap(g)
        assert 0 < exchanged_rows(df) < 120_000 and max(written) < 120_000
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, patterns.support(g).collect())) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_total_hits_send_counts_only(spark, tmp_path):
    """12 000 matches of 40 queries in 300 documents are counted where they are found."""
    spark.range(300).selectExpr("concat('d', id) as _id", "concat('a b w', id % 7) as text").write.parquet(str(tmp_path / "corpus.parquet"))
    spark.range(41).selectExpr("concat('q', id) as _id", "if(id < 40, 'B a', 'z') as text").write.parquet(str(tmp_path / "queries.parquet"))
    df = QUERIES["ir_total"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(41, 12_000)]
    assert 0 < exchanged_rows(df) < 1000


def test_shared_members_send_no_pairs_of_lists(spark, tmp_path):
    """60 suppliers of one nation, each sharing half of its 200 parts with the next: pairs meet at shared members."""
    spark.range(60).selectExpr("id as s_suppkey", "1 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(12_000).selectExpr("id div 200 as l_suppkey", "id % 200 + 100 * (id div 200) as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES["set_intersection_count"](spark, str(tmp_path))
    assert {(r.a, r.b): r.shared for r in df.collect()} == {(a, b): 100 * (b == a + 1) for a in range(60) for b in range(a + 1, 60)}
    assert 0 < exchanged_rows(df) < 6000
