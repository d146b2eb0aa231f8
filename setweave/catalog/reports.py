"""Result store, reports, hash functions and layout diagnostics over the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.catalog import graphs
from setweave.functions import bits, text
from setweave.operators import diagnostics, matching, patterns, results, setops, solver
from setweave.session import materialize, table_path, tune

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return tune(spark).read.parquet(f"{d}/{t}.parquet")


# Points of the store: discount is alpha, line number is b, line status the layout, mean price the cost.
_POINTS = """pt as (select l_discount as alpha, l_linenumber::int as b, case when l_linestatus = 'O' then 'N' else 'H' end as table_type, round(avg(l_extendedprice), 4) as cost,
 round(avg(l_quantity), 4) as kernel_time from lineitem group by 1, 2, 3)"""


def _points(spark, d) -> DataFrame:
    li = _read(spark, d, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "N").otherwise("H").alias("table_type")
    return li.groupBy(F.col("l_discount").alias("alpha"), F.col("l_linenumber").cast("int").alias("b"), kind).agg(F.round(F.avg("l_extendedprice"), 4).alias("cost"), F.round(F.avg("l_quantity"), 4).alias("kernel_time"))


def _store(spark, d) -> results.ResultStore:
    """A store after three upserts: costs of H only, all times, and costs without a layout for b = 1."""
    p = _points(spark, d)
    s = results.ResultStore(spark, table_path(spark, "store"), ["cost", "kernel_time"])
    s.put(p.where("table_type = 'H'").drop("kernel_time")).put(p.select("alpha", "b", "table_type", "kernel_time"))
    return s.put(p.where("b = 1 and table_type = 'N'").select("alpha", "b", "cost"))


_STORE = f"""{_POINTS}, st as (select p.alpha, p.b, p.table_type, case when p.b = 1 and n.cost is not null then n.cost when p.table_type = 'H' then p.cost end as cost, p.kernel_time
 from pt p left join pt n on n.alpha = p.alpha and n.b = p.b and n.table_type = 'N')"""


@query(f"with {_STORE} select * from st")
def store_upsert(spark, d):
    return _store(spark, d).table()


_BEST = f"""{_STORE}, ok as (select * from st where cost is not null), g as (select *, row_number() over (partition by table_type order by cost, alpha, b) as r from ok),
 l as (select *, row_number() over (partition by table_type, alpha order by cost, b) as q from g)"""


@query(f"with {_BEST} select table_type, 'global' as kind, alpha, b, cost from g where r = 1 union all select table_type, 'local', alpha, b, cost from l where q = 1 and r > 1")
def store_best(spark, d):
    """The cheapest point of each layout, and the cheapest b of every other alpha."""
    return _store(spark, d).best()


@query(f"""with {_BEST} select table_type, (select count(*) from st x where x.table_type = s.table_type)::bigint as total_rows, any_value(b.alpha) as alpha, any_value(b.b) as b,
 round(avg(s.cost), 6) as mean, round(stddev_pop(s.cost), 6) as std, min(s.cost) as low, max(s.cost) as high from ok s join (select * from g where r = 1) b using (table_type) group by 1""")
def store_summary(spark, d):
    s = _store(spark, d).summary()
    return s.select("table_type", "total_rows", "best_config.alpha", "best_config.b", F.round("statistics.mean", 6).alias("mean"), F.round("statistics.std", 6).alias("std"), "statistics.low", "statistics.high")


_SAMPLE = "v as (select value as x from events where value is not null and isfinite(value))"


@query(f"""with {_SAMPLE}, q as (select quantile_cont(x, 0.02) as lo, quantile_cont(x, 0.98) as hi from v), e as (select unnest([lo + (hi - lo) * i / 8 for i in range(9)]) as edge from q)
 select (row_number() over (order by edge) - 1)::int as i, round(edge, 6) as edge from (select distinct edge from e)""")
def bin_edges_linear(spark, d):
    return results.bin_edges(_read(spark, d, "events"), "value", 8, "linear").select("i", F.round("edge", 6).alias("edge"))


@query(f"""with {_SAMPLE}, p as (select x from v where x > 0), q as (select greatest(quantile_cont(x, 0.02), 1e-6) as lo, quantile_cont(x, 0.98) as hi, quantile_cont(ln(x), [0.02 + 0.96 * i / 8 for i in range(1, 8)]) as m from p),
 e as (select unnest([lo] || [exp(y) for y in m] || [greatest(hi, lo + 1e-6)] || [(select min(x) from v), (select max(x) from v)]) as edge from q)
 select (row_number() over (order by edge) - 1)::int as i, round(edge, 6) as edge from (select distinct edge from e)""")
def bin_edges_log(spark, d):
    """Even quantiles of the logarithms, with the data's ends."""
    return results.bin_edges(_read(spark, d, "events"), "value", 8, "log-quantile", keep_clip=False).select("i", F.round("edge", 6).alias("edge"))


@query(f"""with {_POINTS}, m as (select alpha, b, table_type, kernel_time, case when b < 3 then cost end as cost from pt), s as (select alpha, b, 2 * cost as cost, b * 10 as steps from pt where table_type = 'H')
 select m.alpha, m.b, m.table_type, m.kernel_time, coalesce(m.cost, s.cost) as cost, s.steps from m left join s on s.alpha = m.alpha and s.b = m.b""")
def runs_merged(spark, d):
    """Measured points completed from predicted ones."""
    p = _points(spark, d)
    measured = p.withColumn("cost", F.when(F.col("b") < 3, F.col("cost")))
    predicted = p.where("table_type = 'H'").select("alpha", "b", (F.col("cost") * 2).alias("cost"), (F.col("b") * 10).alias("steps"))
    return results.merge_runs(measured, predicted, ["alpha", "b"])


@query(f"""with {_POINTS}, n as (select * from pt where table_type = 'N' and b <> 2), h as (select * from pt where table_type = 'H' and b <> 5), t as (select distinct alpha, b from pt)
 select t.alpha, t.b, coalesce(printf('%.4f', n.cost), 'Missing') as normal, coalesce(printf('%.4f', h.cost), 'Missing') as hierarchical, round(n.cost / h.cost, 6) as speedup
 from t left join n on n.alpha = t.alpha and n.b = t.b left join h on h.alpha = t.alpha and h.b = t.b""")
def layouts_merged(spark, d):
    p = _points(spark, d)
    r = results.merge_layouts(p, p.where("table_type = 'N' and b <> 2"), p.where("table_type = 'H' and b <> 5"), ["alpha", "b"], "cost", 4)
    return r.withColumn("speedup", F.round("speedup", 6))


@query("select o_orderkey as key from orders where not (o_orderstatus = 'F' and o_totalprice >= 1000 and o_orderpriority like '1%')")
def reruns(spark, d):
    """Orders as runs: timed if finished, without a time below 1000, OK if urgent."""
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("timed"), F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice")).alias("ms"), F.when(F.col("o_orderpriority").like("1%"), "OK").alias("status"))
    return results.to_rerun(o, "timed", "ms", "status").select("key")


@query("with g as (select l_returnflag as app, l_linenumber as part, sum(l_quantity) as t from lineitem group by 1, 2) select app, sum(t) as total, min(t) as low, max(t) as high, round(avg(t), 6) as mean from g group by 1")
def parts_stats(spark, d):
    g = _read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("app"), F.col("l_linenumber").alias("part")).agg(F.sum("l_quantity").alias("t"))
    return results.over_parts(g, ["app"], "t").withColumn("mean", F.round("mean", 6))


_RUNS = "r as (select l_returnflag as app, l_linenumber as dataset, l_linestatus as method, l_extendedprice as ms, l_quantity as mb from lineitem)"
_COMPARED = f"{_RUNS}, g as (select app, dataset, method, avg(ms) as ms, avg(mb) as mb from r group by 1, 2, 3), c as (select app, dataset, g.method, b.ms / g.ms as speedup, b.mb / g.mb as memory_ratio from g join g b using (app, dataset) where b.method = 'O')"


def _compared(spark, d) -> DataFrame:
    li = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("app"), F.col("l_linenumber").alias("dataset"), F.col("l_linestatus").alias("method"), F.col("l_extendedprice").alias("ms"), F.col("l_quantity").alias("mb"))
    return results.compared(li, ["app", "dataset"], "method", "O", {"speedup": "ms", "memory_ratio": "mb"})


@query(f"with {_COMPARED} select app, dataset, method, round(speedup, 6) as speedup, round(memory_ratio, 6) as memory_ratio from c")
def speed_and_memory(spark, d):
    return _compared(spark, d).withColumns({c: F.round(c, 6) for c in ("speedup", "memory_ratio")})


@query(f"with {_COMPARED} select app, method, round(exp(avg(ln(speedup))), 6) as geomean from c group by 1, 2")
def speedup_by_app(spark, d):
    return _compared(spark, d).groupBy("app", "method").agg(F.round(results.geometric_mean(F.col("speedup")), 6).alias("geomean"))


@query(f"with {_COMPARED} select app, dataset, method, round(speedup, 6) as speedup, row_number() over (order by round(speedup, 6) desc, app, dataset, method) as place from c")
def speedup_sorted(spark, d):
    """Summary lines in the order of their speed-up; places come from the global order, not from one task's window."""
    c = _compared(spark, d).select("app", "dataset", "method", F.round("speedup", 6).alias("speedup"))
    from setweave.operators.order import global_index

    return global_index(c, [F.desc("speedup"), "app", "dataset", "method"], "place").withColumn("place", F.col("place") + 1)


@query("select o_custkey as custkey, o_orderkey as orderkey, row_number() over (partition by o_custkey order by md5(o_orderkey::varchar), o_orderkey) as place from orders")
def shuffled_order(spark, d):
    """Orders of a customer in a fixed random order, that of a digest of their keys."""
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return o.withColumn("place", F.row_number().over(W.partitionBy("custkey").orderBy(F.md5(F.col("orderkey").cast("string")), "orderkey")).cast("long"))


@query("select l_orderkey as orderkey, l_linenumber as line, case when l_tax > 0 then round(l_quantity / l_tax, 6) end as per_request from lineitem")
def sectors_per_request(spark, d):
    li = _read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.round(results.per_request(F.col("l_quantity"), F.col("l_tax")), 6).alias("per_request"))


@query("""select l_linenumber as device, round(avg(l_extendedprice) filter (l_linestatus = 'O') / avg(l_extendedprice) filter (l_linestatus = 'F'), 6) as ratio from lineitem group by 1
 having count(*) filter (l_linestatus = 'O') > 0 and count(*) filter (l_linestatus = 'F') > 0""")
def pivot_ratio(spark, d):
    li = _read(spark, d, "lineitem")
    return results.element_ratio(li, "l_linenumber", "l_linestatus", "O", "F", "l_extendedprice").select(F.col("l_linenumber").alias("device"), F.round("ratio", 6).alias("ratio"))


@query(f"with {graphs.PS}, {graphs._TRI}, n as (select count(*)::bigint as n from t) select unnest(['arrays', 'partitions', 'pattern', 'bitmaps']) as method, n, true as agrees from n")
def tc_consistency(spark, d):
    """Triangles by four methods, and whether each agrees with the first."""
    e = graphs.edges(spark, d)
    ways = {
        "arrays": patterns.clique_count(e, 3),
        "partitions": patterns.triangles_partitioned(e, graphs.PARTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        "pattern": matching.match_count(e, matching.PATTERNS["Q0"]),
        "bitmaps": patterns.support_by_bitmap(e).agg(F.expr("coalesce(sum(shared), 0) div 3").alias("n")),
    }
    answers = None
    for method, df in ways.items():
        # Written one by one, so the shuffle files of one method only are held.
        one = materialize(df.select(F.lit(method).alias("method"), F.col("n").cast("long").alias("n")), "answer")
        answers = one if answers is None else answers.unionByName(one)
    return results.consistency(answers, "method", "n", "arrays")


@query(f"with {_COMPARED} select printf('%-4s', app) || chr(9) || printf('%d', dataset) || chr(9) || printf('%s', method) || chr(9) || printf('%.2f', round(speedup, 6)) as line from c")
def fixed_width_report(spark, d):
    c = _compared(spark, d).select("app", F.col("dataset").cast("int").alias("dataset"), "method", F.round("speedup", 6).alias("speedup"))
    return results.fixed_width(c, {"app": "%-4s", "dataset": "%d", "method": "%s", "speedup": "%.2f"})


@query("""select p_partkey as partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as slug, split_part(split_part(p_name || '_adj.mtx', '.', 1), '_adj', 1) as graph from part""")
def names_cleaned(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name")
    return p.select("partkey", text.slug(F.col("p_name")).alias("slug"), text.graph_name(F.concat("p_name", F.lit("_adj.mtx"))).alias("graph"))


@query("""select event_id, round(case event_type when 'click' then value / 1e6 when 'view' then value / 1e3 when 'error' then value * 1e3 else value end, 9) as ms,
 ceil(value * 100) / 100 as up, replace(format('{:,}', event_id * 1000), ',', '')::double as number from events""")
def units_converted(spark, d):
    e = _read(spark, d, "events")
    unit = F.when(F.col("event_type") == "click", "ns").when(F.col("event_type") == "view", "us").when(F.col("event_type") == "error", "s").otherwise("ms")
    number = text.plain_number(F.format_number(F.col("event_id") * 1000, 0))
    return e.select("event_id", F.round(results.milliseconds(F.col("value"), unit), 9).alias("ms"), text.ceil_to(F.col("value")).alias("up"), number.alias("number"))


@query("select event_id, coalesce(case when json_valid(props) then json_extract_string(props, '$.k') end, '-') as k, coalesce(case when json_valid(props) then json_extract_string(props, '$.none') end, '-') as none from events")
def json_fields(spark, d):
    e = _read(spark, d, "events")
    return e.select("event_id", text.json_field(F.col("props"), "$.k", "-").alias("k"), text.json_field(F.col("props"), "$.none", "-").alias("none"))


def _mix_sql(x: str) -> str:
    step = lambda h, shift, factor: f"((xor({h}, ({h}) >> {shift}))::hugeint * {factor} % 4294967296)::bigint"
    inner = step(x, 16, 2246822507)
    return inner


@query(f"""with {graphs.PS}, a as (select src, dst, {_mix_sql('dst')} as h from s), b as (select src, dst, (xor(h, h >> 13)::hugeint * 3266489909 % 4294967296)::bigint as h from a)
 select src, dst, xor(h, h >> 16) as mixed, xor(xor(dst, dst >> 8), src) & 63 as first, xor(xor(xor(dst, dst >> 16), src << 1), 2863311530) & 63 as second,
 ((dst % 32) * 2 + dst // 32)::bigint as interleaved from b""")
def hash_functions(spark, d):
    """The layouts' hash functions of every neighbour in tables of 64 slots."""
    s = graphs.edges_symmetric(spark, d)
    c = F.lit(64).cast("long")
    return s.select("src", "dst", bits.mix32(F.col("dst")).alias("mixed"), bits.set_hash(F.col("dst"), F.col("src"), c).alias("first"), bits.second_hash(F.col("dst"), F.col("src"), c).alias("second"), bits.interleaved(F.col("dst"), c).cast("long").alias("interleaved"))


_SETS = "s as (select distinct l_suppkey as set_id, l_partkey as elem from lineitem)"
_FILLED = f"""{_SETS}, z as (select set_id, (2 ** (floor(log2(greatest(1, floor(count(*) / 5.0)))) + 1))::bigint as len from s group by 1),
 k as (select s.set_id, len, elem & (len - 1) as bucket, count(*) as n from s join z using (set_id) group by 1, 2, 3)"""


def _sets(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("elem")).distinct()


@query(f"""with {_FILLED}, i as (select set_id, len, unnest(range(2 * len)) as i from z), c as (select i.set_id, i.len, i.i, coalesce(k.n, 0) - 5 as x from i left join k on k.set_id = i.set_id and k.bucket = i.i % i.len),
 p as (select *, sum(x) over (partition by set_id order by i) as t from c), w as (select *, t - least(0, min(t) over (partition by set_id order by i)) as carry from p)
 select set_id as set, sum(carry) filter (i >= len)::bigint as displaced from w group by 1""")
def displaced_keys(spark, d):
    """Moves of linear probing in tables of 5 slots a bucket that are just large enough."""
    s = _sets(spark, d)
    n = s.groupBy("set_id").agg(F.count("*").alias("n"))
    length = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1), F.floor(F.col("n") / 5)))) + 1).cast("long")
    filled = s.join(n.select("set_id", length.alias("len")), "set_id").groupBy(F.col("set_id").alias("set"), "len", F.col("elem").bitwiseAND(F.col("len") - 1).alias("bucket")).agg(F.count("*").alias("n"))
    return diagnostics.displacement(filled, 5)


@query(f"with {_SETS} select set_id as set, elem, row_number() over (partition by set_id order by elem % 64, elem) - 1 as place from s")
def segment_sort(spark, d):
    return diagnostics.segment_order(_sets(spark, d).withColumnRenamed("set_id", "set"), 64)


# Sets by supplier; returned lines come in, lines of even order keys go.
_IN = "n as (select l_suppkey as set_id, l_partkey + 1 as elem from lineitem where l_returnflag = 'R')"


@query(f"with {_SETS}, {_IN} select set_id, elem from s union select set_id, elem from n")
def set_insert(spark, d):
    new = _read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("set_id"), (F.col("l_partkey") + 1).alias("elem"))
    return setops.insert(_sets(spark, d), new)


@query(f"with {_SETS} select set_id, elem from s except select l_suppkey, l_partkey from lineitem where l_returnflag = 'A'")
def set_remove(spark, d):
    gone = _read(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("elem"))
    return setops.remove(_sets(spark, d), gone)


@query(f"with {_SETS}, {_IN} select n.set_id, n.elem, s.elem is not null as found from n left join s using (set_id, elem)")
def set_contains(spark, d):
    asked = _read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("set_id"), (F.col("l_partkey") + 1).alias("elem"))
    return setops.contains(_sets(spark, d), asked)


@query(f"""with {_SETS}, n as (select set_id, count(*)::bigint as size from s group by 1), c as (select set_id, size, (5 * greatest(8, 2 ** (floor(log2(greatest(1, floor(size / 0.2 / 5)))) + 1)))::bigint as capacity from n)
 select set_id, size, capacity, round(size / capacity, 9) as load_factor from c""")
def set_fill(spark, d):
    return setops.fill(_sets(spark, d), 0.2, 5).withColumn("load_factor", F.round("load_factor", 9))


@query("""with g as (select round(0.1 + i * 0.05, 2) as alpha, b from range(19) t(i), range(1, 10) u(b)), k as (select alpha, b, alpha * b / 100 as p, unnest(range(0, 13)) as k from g)
 select alpha, b::int as b, k::int as k, round(exp((select 0) + lgamma(101) - lgamma(k + 1) - lgamma(101 - k) + k * ln(p) + (100 - k) * ln(1 - p)), 9) as p from k""")
def solver_binomial(spark, d):
    """Load of a bucket when 100 keys are hashed, at every grid point, up to 12 keys."""
    return solver.load_laws(tune(spark), 100).withColumn("p", F.round("p", 9))


#: Published recommendations (mode, size, w, s_trans, s_slot) -> (alpha, b, cost).
_KNOWN = "('sss', 10000, 32, 32, 4, 0.25, 8, 9.006586103162421), ('sss', 10000, 32, 128, 4, 0.2, 5, 4.007375440964838), ('sss', 1000000, 32, 32, 4, 0.25, 8, 9.006596359038998), ('sss', 1000000, 32, 128, 4, 0.2, 5, 4.007380077760372)"
_AS = "as t(mode, size, w, s_trans, s_slot, alpha, b, cost)"


@query(f"select mode, size::bigint as size, w, s_trans, s_slot, alpha::double as alpha, b, round(cost::double, 9) as cost from (values {_KNOWN}) {_AS} union all select 'sss', 7, 32, 32, 4, 0.0, 0, 'inf'::double")
def solver_cache(spark, d):
    """Recommendations precomputed, then looked up; a key never solved has none."""
    c = solver.Recommendations(tune(spark), table_path(spark, "recommendations"))
    known = c.precompute([10_000, 1_000_000], [32], [32, 128], [4], ["sss"])
    unknown = spark.createDataFrame([("sss", 7, 32, 32, 4)], "mode string, size long, w int, s_trans int, s_slot int")
    return known.unionByName(c.get(unknown)).withColumn("cost", F.round("cost", 9))
