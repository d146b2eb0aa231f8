"""Graph queries: views over lineitem, triangles, similarity, patterns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import graph, matching, patterns
from setweave.session import materialize, tune

VIEWS = {"ps": ("l_partkey", "l_suppkey"), "ol": ("l_orderkey", "l_partkey")}
PARTS = 7
LOAD, BUCKET = 0.2, 5


def _clean(spark: SparkSession, d: str, view: str) -> DataFrame:
    u, v = VIEWS[view]
    return graph.undirected(tune(spark).read.parquet(f"{d}/lineitem.parquet"), u, v)


def edges(spark: SparkSession, d: str, view: str = "ps") -> DataFrame:
    """Clean edges, written once because the operators read them several times."""
    return materialize(_clean(spark, d, view), "edges")


def _sql_edges(view: str) -> str:
    u, v = VIEWS[view]
    return f"""e as (select distinct least({u}, {v}) as src, greatest({u}, {v}) as dst from lineitem where {u} <> {v}),
 s as (select src, dst from e union all select dst, src from e),
 d as (select src as node, count(*)::bigint as deg from s group by 1)"""


PS, OL = _sql_edges("ps"), _sql_edges("ol")
_TRI = "t as (select a.src as x, a.dst as y, b.dst as z from e a join e b on a.dst = b.src join e c on c.src = a.src and c.dst = b.dst)"
_CN = "cn as (select e.src, e.dst, count(*)::bigint as shared from e join s a on a.src = e.src join s b on b.src = e.dst and b.dst = a.dst group by 1, 2)"
_K4 = f"{_TRI}, k4 as (select x, y, z, e1.dst as w from t join e e1 on e1.src = x join e e2 on e2.src = y and e2.dst = e1.dst join e e3 on e3.src = z and e3.dst = e1.dst)"
_PAIR = "pr as (select a.dst as p, b.dst as q, count(*)::bigint as c from s a join s b on a.src = b.src and a.dst < b.dst group by 1, 2)"
_LEN = f"greatest(8, 2 ** (floor(log2(greatest(1, floor(deg / {LOAD} / {BUCKET})))) + 1))::bigint"

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"with {PS} select src, dst from e")
def edges_clean(spark, d):
    return _clean(spark, d, "ps")


@query(f"with {PS} select src, dst from s")
def edges_symmetric(spark, d):
    return graph.symmetric(edges(spark, d))


@query(f"with {PS} select node, deg from d")
def degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"with {PS} select max(deg)::bigint as max_deg, round(avg(deg), 6) as avg_deg, (sum(deg) // count(*))::bigint as avg_deg_floor, round(avg((deg >= 32)::int) filter (deg < 100000), 6) as share_32 from d")
def degree_stats(spark, d):
    g = graph.degrees(edges(spark, d))
    return g.agg(F.max("deg").alias("max_deg"), F.round(F.avg("deg"), 6).alias("avg_deg"), F.expr("sum(deg) div count(*)").alias("avg_deg_floor"), F.round(F.avg(F.when(F.col("deg") < 100000, (F.col("deg") >= 32).cast("int"))), 6).alias("share_32"))


@query(f"""with {PS}, b as (select least(13, floor(log10(deg) * 14 / 5))::bigint as bin, count(*) as n from d where deg between 1 and 100000 group by 1)
 select bin, round(100 * n / sum(n) over (), 6) as percent from b""")
def degree_histogram(spark, d):
    g = graph.degrees(edges(spark, d)).where("deg between 1 and 100000")
    b = g.groupBy(F.least(F.lit(13), F.floor(F.log10("deg") * 14 / 5)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = b.agg(F.sum("n").alias("t"))  # at most 14 bins
    return b.join(F.broadcast(total)).select("bin", F.round(100 * F.col("n") / F.col("t"), 6).alias("percent"))


@query(f"with {PS} select greatest(1, floor(sum(deg * deg) / sum(deg)))::bigint as weighted, greatest(1, floor(avg(deg)))::bigint as mean_size from d")
def weighted_set_size(spark, d):
    g = graph.degrees(edges(spark, d))
    return g.agg(F.greatest(F.lit(1), F.floor(F.sum(F.col("deg") * F.col("deg")) / F.sum("deg"))).cast("long").alias("weighted"), F.greatest(F.lit(1), F.floor(F.avg("deg"))).cast("long").alias("mean_size"))


@query(f"""with {PS}, k as (select * from d where deg >= 2) select case when a.deg > b.deg or (a.deg = b.deg and src < dst) then dst else src end as src,
 case when a.deg > b.deg or (a.deg = b.deg and src < dst) then src else dst end as dst from e join k a on a.node = src join k b on b.node = dst""")
def dag_by_degree(spark, d):
    return graph.pruned_dag(edges(spark, d))


@query(f"with {PS} select node, deg, row_number() over (order by deg desc, node) - 1 as rank from d")
def vertex_rank(spark, d):
    return graph.vertex_rank(edges(spark, d))


@query(f"with {PS} select node, row_number() over (order by node) - 1 as id from d")
def dense_ids(spark, d):
    return graph.dense_ids(edges(spark, d))


@query(f"with {PS} select node, deg, coalesce(sum(deg) over (order by node rows between unbounded preceding and 1 preceding), 0)::bigint as begin from d")
def csr_offsets(spark, d):
    return graph.csr_offsets(edges(spark, d))


@query(f"""with recursive {PS}, n as (select count(*)::bigint as n from d), st as (select 10007::bigint as k union all select k + 1 from st, n where gcd(k, n) <> 1),
 i as (select node, row_number() over (order by node) - 1 as id from d) select node, id, (id * (select max(k) from st)) % (select n from n) as permuted from i""")
def coprime_permutation(spark, d):
    ids = materialize(graph.dense_ids(edges(spark, d)), "ids")
    return graph.permuted(ids, ids.count())


@query(f"with {PS}, i as (select node, row_number() over (order by node) - 1 as id from d) select node, id, (id * 4 // (select count(*) from d))::bigint as part from i")
def range_partition(spark, d):
    ids = materialize(graph.dense_ids(edges(spark, d)), "ids")
    return ids.withColumn("part", graph.range_partition(F.col("id"), max(1, ids.count()), 4))


@query(f"""with {PS}, l as (select node, deg, {_LEN} as len from d), m as (select max(len) as longest from l)
 select s.src, s.dst, s.dst & (len - 1) as plain, ((s.dst % longest) // (longest // len))::bigint as hierarchical from s join l on l.node = s.src, m""")
def hash_buckets(spark, d):
    e = edges(spark, d)
    lengths = materialize(graph.degrees(e).select("node", graph.table_length(F.col("deg"), LOAD, BUCKET).alias("len")), "lengths")
    longest = lengths.agg(F.max("len").alias("m")).first().m or 8
    s = graph.symmetric(e).join(lengths.withColumnRenamed("node", "src"), "src")
    return s.select("src", "dst", graph.plain_bucket(F.col("dst"), F.col("len")).alias("plain"), graph.hierarchical_bucket(F.col("dst"), F.col("len"), longest).alias("hierarchical"))


@query(f"""with {PS}, l as (select node, deg, {_LEN} as len from d), b as (select src, dst & (len - 1) as bucket, count(*) as n, any_value(len) as len from s join l on l.node = src group by 1, 2)
 select src as node, any_value(len) as len, max(n)::bigint as fullest, sum(greatest(0, n - {BUCKET}))::bigint as overflow from b group by 1""")
def table_layout(spark, d):
    """Per set: table length, fullest bucket and members beyond their bucket's slots."""
    e = edges(spark, d)
    lengths = graph.degrees(e).select(F.col("node").alias("src"), graph.table_length(F.col("deg"), LOAD, BUCKET).alias("len"))
    b = graph.symmetric(e).join(lengths, "src").groupBy("src", "len", graph.plain_bucket(F.col("dst"), F.col("len")).alias("bucket")).agg(F.count("*").alias("n"))
    return b.groupBy(F.col("src").alias("node"), "len").agg(F.max("n").alias("fullest"), F.sum(F.greatest(F.lit(0), F.col("n") - BUCKET)).cast("long").alias("overflow"))


@query(f"with {PS} select src, dst, (src << 32) | dst as pair from e")
def edge_key_encode(spark, d):
    return edges(spark, d).withColumn("pair", graph.edge_key(F.col("src"), F.col("dst")))


@query(f"with {PS}, {_TRI} select count(*)::bigint as n from t")
def tc_count(spark, d):
    return patterns.clique_count(edges(spark, d), 3)


@query(f"with {PS}, {_TRI} select count(*)::bigint as n from t")
def tc_partitioned(spark, d):
    return patterns.triangles_partitioned(edges(spark, d), PARTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"with {PS}, {_TRI}, v as (select x as node from t union all select y from t union all select z from t) select node, count(*)::bigint as triangles from v group by 1")
def tc_per_vertex(spark, d):
    return patterns.triangles_per_node(edges(spark, d))


_SSS = f"{PS}, {_CN}, j as (select cn.src, cn.dst, shared, a.deg + b.deg - shared as union_size from cn join d a on a.node = cn.src join d b on b.node = cn.dst)"


@query(f"with {_SSS} select src, dst, shared, union_size from j where shared / union_size >= 0.05")
def sss_pairs(spark, d):
    return patterns.similar_edges(edges(spark, d), 0.05)


@query(f"with {_SSS} select (2 * count(*))::bigint as n, (2 * count(*) filter (4 * shared >= union_size))::bigint as n_25 from j where shared / union_size >= 0.05")
def sss_count(spark, d):
    """Directed edges over the thresholds 0.05 and 0.25."""
    return patterns.similar_edges(edges(spark, d), 0.05).agg((2 * F.count("*")).alias("n"), (2 * F.count(F.when(F.expr("4 * shared >= union_size"), 1))).alias("n_25"))


@query(f"with {_SSS} select src, dst, shared, union_size from j where shared / union_size >= 0.05")
def sss_partitioned(spark, d):
    return patterns.similar_edges_partitioned(edges(spark, d, "ps"), 0.05, PARTS)


@query(f"with {PS}, {_CN} select src, dst, shared from cn")
def sss_bitmap(spark, d):
    return patterns.support_by_bitmap(edges(spark, d))




@query(f"with {PS}, {_TRI} select count(*)::bigint as n from t")
def match_q0(spark, d):
    return patterns.clique_count(edges(spark, d), 3)


@query(f"with {PS}, {_PAIR} select (sum(c * (c - 1) // 2) // 2)::bigint as n from pr")
def match_q1(spark, d):
    return patterns.four_cycles(edges(spark, d))


@query(f"with {PS}, {_CN} select coalesce(sum(shared * (shared - 1) // 2), 0)::bigint as n from cn")
def match_q2(spark, d):
    return patterns.diamonds(edges(spark, d))


@query(f"with {PS}, {_K4} select count(*)::bigint as n from k4")
def match_q3(spark, d):
    return patterns.clique_count(edges(spark, d), 4)


@query(f"""with {OL}, {_CN}, c as (select e.src, e.dst, a.dst as w from e join s a on a.src = e.src join s b on b.src = e.dst and b.dst = a.dst),
 i as (select c1.src, c1.dst, count(*) as k from c c1 join c c2 on c1.src = c2.src and c1.dst = c2.dst join e on e.src = c1.w and e.dst = c2.w group by 1, 2)
 select coalesce(sum(k * (shared - 2)), 0)::bigint as n from i join cn using (src, dst)""")
def match_q4(spark, d):
    return patterns.k4_with_triangle(edges(spark, d, "ol"))


@query(f"""with {OL}, {_K4}, k5 as (select x, y, z, w, e1.dst as r from k4 join e e1 on e1.src = x join e e2 on e2.src = y and e2.dst = e1.dst join e e3 on e3.src = z and e3.dst = e1.dst
 join e e4 on e4.src = w and e4.dst = e1.dst) select count(*)::bigint as n from k5""")
def match_q5(spark, d):
    return patterns.clique_count(edges(spark, d, "ol"), 5)


@query(f"""with {OL}, {_PAIR}, i as (select a.src as p, b.src as q, count(*) as k from e join s a on a.dst = e.src join s a2 on a2.src = a.src and a2.dst = e.dst
 join s b on b.dst = e.src and a.src < b.src join s b2 on b2.src = b.src and b2.dst = e.dst group by 1, 2)
 select coalesce(sum(k * (c - 2)), 0)::bigint as n from i join pr using (p, q)""")
def match_q6(spark, d):
    return patterns.k23_with_edge(edges(spark, d, "ol"))


@query(f"""with {OL}, {_K4}, k6 as (select 1 from k4 join e a on a.src = x join e b on b.src = y and b.dst = a.dst join e c on c.src = z and c.dst = a.dst join e f on f.src = w and f.dst = a.dst
 join e g on g.src = x join e h on h.src = y and h.dst = g.dst join e i on i.src = z and i.dst = g.dst join e j on j.src = w and j.dst = g.dst join e k on k.src = a.dst and k.dst = g.dst)
 select count(*)::bigint as n from k6""")
def match_q7(spark, d):
    return patterns.clique_count(edges(spark, d, "ol"), 6)


@query(f"""with {OL}, {_TRI}, c as (select x, y, z, count(*) as c from t join s a on a.src = x join s b on b.src = y and b.dst = a.dst join s f on f.src = z and f.dst = a.dst group by 1, 2, 3)
 select (3 * coalesce(sum(c * (c - 1) // 2), 0))::bigint as n, coalesce(sum(c * (c - 1) // 2), 0)::bigint as distinct_count from c""")
def match_q8(spark, d):
    return patterns.k5_minus_edge(edges(spark, d, "ol"))


# Q4 to Q8 over the view of Q0 to Q3, which holds 4-cliques; "ol" holds none. Their SQL goes through the 4-cliques.
_K5 = f"{_K4}, k5 as (select a.x, a.y, a.z, a.w, b.w as r from k4 a join k4 b on a.x = b.x and a.y = b.y and a.z = b.z and a.w < b.w join e on e.src = a.w and e.dst = b.w)"


@query(f"""with {PS}, {_K4}, {_CN}, sd as (select x as src, y as dst from k4 union all select x, z from k4 union all select x, w from k4 union all select y, z from k4 union all select y, w from k4 union all select z, w from k4),
 k as (select src, dst, count(*) as k from sd group by 1, 2) select coalesce(sum(k * (shared - 2)), 0)::bigint as n from k join cn using (src, dst)""")
def match_q4_ps(spark, d):
    return patterns.k4_with_triangle(edges(spark, d))


@query(f"with {PS}, {_K5} select count(*)::bigint as n from k5")
def match_q5_ps(spark, d):
    return patterns.clique_count(edges(spark, d), 5)


@query(f"""with {PS}, {_TRI}, a as (select x, y, z as p from t union all select x, z, y from t union all select y, z, x from t), {_PAIR},
 i as (select a.p, b.p as q, count(*) as k from a join a b on a.x = b.x and a.y = b.y and a.p < b.p group by 1, 2) select coalesce(sum(k * (c - 2)), 0)::bigint as n from i join pr using (p, q)""")
def match_q6_ps(spark, d):
    return patterns.k23_with_edge(edges(spark, d))


@query(f"with {PS}, {_K5} select count(*)::bigint as n from k5 a join k5 b on a.x = b.x and a.y = b.y and a.z = b.z and a.w = b.w and a.r < b.r join e on e.src = a.r and e.dst = b.r")
def match_q7_ps(spark, d):
    return patterns.clique_count(edges(spark, d), 6)


@query(f"""with {PS}, {_K4}, f as (select x, y, z from k4 union all select x, y, w from k4 union all select x, z, w from k4 union all select y, z, w from k4), c as (select x, y, z, count(*) as c from f group by 1, 2, 3)
 select (3 * coalesce(sum(c * (c - 1) // 2), 0))::bigint as n, coalesce(sum(c * (c - 1) // 2), 0)::bigint as distinct_count from c""")
def match_q8_ps(spark, d):
    return patterns.k5_minus_edge(edges(spark, d))


# The same patterns, and one more, by the general matcher over the sparser view.
def _by_table(name: str, of: str) -> None:
    def f(spark, d):
        return matching.match_count(edges(spark, d, "ol"), matching.PATTERNS[name])

    f.__name__ = f"pattern_{name.lower()}"
    query(SQL[of].replace(PS, OL) if name != "Q8" else f"select n from ({SQL[of]})")(f)


for _q in matching.PATTERNS:
    _by_table(_q, f"match_{_q.lower()}")


@query(f"with {OL}, {_TRI} select coalesce(sum(dx.deg + dy.deg + dz.deg - 6), 0)::bigint as n from t join d dx on dx.node = x join d dy on dy.node = y join d dz on dz.node = z")
def pattern_paw(spark, d):
    """A triangle with one more edge at a corner: a pattern outside the nine."""
    paw = matching.Pattern([0, 0, 1, 0], [0, 1, 3, 4], [-1, -1, 1, -1], distinct=True)
    return matching.match_count(edges(spark, d, "ol"), paw)
