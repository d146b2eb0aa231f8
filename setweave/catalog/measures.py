"""Set operations, solver and measurement queries over the star tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from setweave.operators import results, setops, solver
from setweave.session import materialize, tune

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


# Sets: the parts each supplier delivers; pairs: suppliers of the same nation.
_SETS = """s as (select distinct l_suppkey as set_id, l_partkey as elem from lineitem),
 pr as (select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey),
 n as (select set_id, count(*) as n from s group by 1),
 h as (select pr.a, pr.b, count(*) as shared from pr join s x on x.set_id = pr.a join s y on y.set_id = pr.b and x.elem = y.elem group by 1, 2),
 r as (select pr.a, pr.b, coalesce(shared, 0)::bigint as shared, (coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(shared, 0))::bigint as united, (coalesce(na.n, 0) - coalesce(shared, 0))::bigint as only_a
  from pr left join h using (a, b) left join n na on na.set_id = pr.a left join n nb on nb.set_id = pr.b)"""


def _pairs(spark, d) -> DataFrame:
    groups = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sets = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("elem"))
    return setops.group_pair_counts(groups, sets)


@query(f"with {_SETS} select a, b, shared from r")
def set_intersection_count(spark, d):
    return _pairs(spark, d).select("a", "b", "shared")


@query(f"with {_SETS} select a, b, united from r")
def set_union_size(spark, d):
    return _pairs(spark, d).select("a", "b", "united")


@query(f"with {_SETS} select a, b, only_a from r")
def set_difference(spark, d):
    return _pairs(spark, d).select("a", "b", "only_a")


@query("select count(*)::bigint as n from lineitem where l_partkey in (select p_partkey from part where p_size <= 10)")
def set_membership(spark, d):
    left = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("elem"))
    right = _read(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("elem"))
    return setops.members_in(left, right).agg(F.count("*").alias("n"))


# Measurements: event_type is the method, user_id mod 5 the data set, value the time.
def _measures(spark, d) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.col("event_type").alias("method"), F.pmod("user_id", F.lit(5)).alias("dataset"), F.col("value"), "event_id", "props")


_M = "m as (select event_type as method, user_id % 5 as dataset, value, event_id, props from events)"
_MEAN = f"{_M}, g as (select dataset, method, avg(value) as mean from m group by 1, 2)"


@query(f"with {_M} select method, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as low, max(value) as high, round(quantile_cont(value, 0.5), 6) as median from m where value is not null and isfinite(value) group by 1")
def result_stats(spark, d):
    s = results.statistics(_measures(spark, d), "method", "value")
    return s.select("method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high", F.round("median", 6).alias("median"))


@query(f"with {_M} select method, event_id, value from m where value is not null qualify row_number() over (partition by method order by value, event_id) = 1")
def result_best(spark, d):
    m = _measures(spark, d).where("value is not null").groupBy("method").agg(F.min(F.struct("value", "event_id")).alias("b"))
    return m.select("method", "b.event_id", "b.value")


@query(f"""with {_MEAN}, o as (select dataset, method, round(mean, 6) as mean from g where dataset < 3), w as (select dataset, method, case when dataset = 1 then null else round(mean * 2, 6) end as mean from g where dataset >= 1)
 select coalesce(o.dataset, w.dataset) as dataset, coalesce(o.method, w.method) as method, coalesce(w.mean, o.mean) as mean from o full join w on o.dataset = w.dataset and o.method = w.method""")
def result_upsert(spark, d):
    g = _measures(spark, d).groupBy("dataset", "method").agg(F.avg("value").alias("mean"))
    old = g.where("dataset < 3").withColumn("mean", F.round("mean", 6))
    new = g.where("dataset >= 1").withColumn("mean", F.when(F.col("dataset") != 1, F.round(F.col("mean") * 2, 6)))
    return results.upsert(old, new, ["dataset", "method"], ["mean"])


_METHODS_SQL = "(select min(method) from m)"


@query(f"with {_MEAN}, b as (select dataset, mean from g where method = {_METHODS_SQL}) select g.dataset, g.method, round(b.mean / nullif(g.mean, 0), 6) as speedup from g join b using (dataset)")
def speedup_pivot(spark, d):
    """Mean time of the first method over each method's, by data set."""
    g = _measures(spark, d).groupBy("dataset", "method").agg(F.avg("value").alias("mean"))
    # methods x data sets rows
    base = F.first("mean").over(W.partitionBy("dataset").orderBy("method"))
    return g.withColumn("base", base).select("dataset", "method", F.round(F.try_divide("base", F.col("mean")), 6).alias("speedup"))


@query(f"with {_M} select method, round(exp(avg(ln(value)) filter (value > 0 and isfinite(value))), 6) as geomean from m group by 1")
def geomean_speedup(spark, d):
    return _measures(spark, d).groupBy("method").agg(F.round(results.geometric_mean(F.col("value")), 6).alias("geomean"))


@query("""select l_returnflag as flag, 'quantity' as metric, round(sum(l_quantity), 2) as total from lineitem group by 1 union all select l_returnflag, 'price', round(sum(l_extendedprice), 2) from lineitem group by 1""")
def melt_metrics(spark, d):
    w = _read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    return w.unpivot("flag", ["quantity", "price"], "metric", "total").withColumn("total", F.round("total", 2))


_PRIORITIES = ["1", "2", "3", "4", "5"]


@query("select o_orderstatus as status, " + ", ".join(f"min(o_orderkey) filter (o_orderpriority like '{p}%') as p{p}" for p in _PRIORITIES) + " from orders group by 1")
def wide_pivot(spark, d):
    """First order of every status and priority."""
    o = _read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.min("o_orderkey").alias("key"))
    return results.wide(o, "status", "p", _PRIORITIES, "key").toDF("status", *(f"p{p}" for p in _PRIORITIES))


@query("""select o_custkey as custkey, list_sort(list(distinct o_orderstatus))::varchar as statuses from orders group by 1 having list_sort(list(distinct o_orderstatus)) <> ['F', 'O', 'P']""")
def completeness_check(spark, d):
    """Customers whose orders don't show exactly the statuses F, O and P."""
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    r = results.incomplete(o, ["custkey"], "status", ["F", "O", "P"])
    return r.select("custkey", F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("statuses"))


@query("select o_orderpriority as priority, round(avg((o_orderstatus = 'F')::int), 6) as rate from orders group by 1")
def success_rate(spark, d):
    return _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))


@query(f"with {_M}, q as (select quantile_cont(value, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) as e from m) select unnest(range(9))::int as i, round(unnest(e), 6) as edge from q")
def quantile_edges(spark, d):
    return results.quantile_edges(_measures(spark, d), "value", 8).select("i", F.round("edge", 6).alias("edge"))


@query("""with g as (select l_linenumber as device, sum(l_quantity) as t from lineitem group by 1) select device, round((select t from g where device = 1) / t, 6) as speedup from g""")
def scaling_speedup(spark, d):
    g = _read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("device")).agg(F.sum("l_quantity").alias("t"))
    base = g.agg(F.max(F.when(F.col("device") == 1, F.col("t"))).alias("base"))
    return g.join(F.broadcast(base)).select("device", F.round(F.col("base") / F.col("t"), 6).alias("speedup"))


@query(r"""with x as (select doc_id, unnest(regexp_extract_all(text, 'kernel_ms=([0-9.]+)', 1)) as ms from documents) select doc_id, count(*)::bigint as n, round(sum(ms::double), 4) as kernel_ms from x group by 1""")
def log_metric_extract(spark, d):
    """Metrics in log lines of documents."""
    x = _read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"kernel_ms=([0-9.]+)"), 1)).alias("ms"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ms").cast("double")), 4).alias("kernel_ms"))


@query("select event_id, coalesce(length(props), 0)::bigint as n, json_valid(props) as valid from events")
def json_props(spark, d):
    e = _read(spark, d, "events")
    parsed = F.from_json("props", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    return e.select("event_id", F.coalesce(F.length("props"), F.lit(0)).cast("long").alias("n"), F.when(F.col("props").isNotNull(), parsed.isNotNull()).alias("valid"))


@query("select round(0.1 + i * 0.05, 2) as alpha, b::int as b from range(19) t(i), range(1, 10) u(b)")
def grid_product(spark, d):
    return solver.grid(tune(spark))


@query("""with g as (select round(0.1 + i * 0.05, 2) as alpha, b from range(19) t(i), range(1, 10) u(b)), k as (select * from g, range(0, 13) v(k))
 select alpha, b::int as b, k::int as k, round(exp(-alpha * b) * (alpha * b) ** k / factorial(k::int), 9) as p from k""")
def solver_poisson(spark, d):
    """Poisson load of a bucket at every grid point, up to 12 keys."""
    return solver.load_laws(tune(spark)).withColumn("p", F.round("p", 9))


_PROBLEMS = [(n, 32, t, 4) for n in (10_000, 1_000_000) for t in (32, 128)]


@query(None)
def solver_grid(spark, d):
    return solver.solve(tune(spark), spark.createDataFrame(_PROBLEMS, "size long, w int, s_trans int, s_slot int"))


#: Published recommendations for these problems.
_KNOWN = "(10000, 32, 32, 4, 0.25, 8, 9.006586103162421), (10000, 32, 128, 4, 0.2, 5, 4.007375440964838), (1000000, 32, 32, 4, 0.25, 8, 9.006596359038998), (1000000, 32, 128, 4, 0.2, 5, 4.007380077760372)"


@query(f"select size::bigint as size, w, s_trans, s_slot, alpha::double as alpha, b, round(cost::double, 9) as cost from (values {_KNOWN}) as t(size, w, s_trans, s_slot, alpha, b, cost)")
def solver_best(spark, d):
    return solver.best(solver_grid(spark, d)).withColumn("cost", F.round("cost", 9))


@query(None)
def solver_for_sets(spark, d):
    """Recommended load factor and bucket size for the mean set size that the parts' supplier sets have, weighted by size."""
    s = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    size = s.agg(F.greatest(F.lit(1), F.floor(F.sum(F.col("n") * F.col("n")) / F.sum("n"))).cast("long").alias("size"))
    p = materialize(size.select("size", F.lit(32).alias("w"), F.lit(32).alias("s_trans"), F.lit(4).alias("s_slot")), "problem")
    return solver.best(solver.solve(tune(spark), p))
