"""Round trips of the exports: written to the shared folder, read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.catalog import graphs, texts
from setweave.operators.graph import dense_ids, symmetric
from setweave.session import materialize, table_path, tune
from setweave.sources import exports, files

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _vectors(spark: SparkSession, folder: str, names: list[str], layout: str = "int32") -> DataFrame:
    out = None
    for n in names:
        v = files.vector(spark, f"{folder}/{n}.bin", layout).select(F.lit(n).alias("file"), "pos", "value")
        out = v if out is None else out.unionByName(v)
    return out


_DENSE = f"{graphs.PS}, i as (select node, row_number() over (order by node) - 1 as id from d), x as (select a.id as src, b.id as dst from s join i a on a.node = src join i b on b.node = dst)"


def _csr_sql(lines: str, tail: str = "", part: str = "") -> str:
    return f"""{_DENSE}, l as (select src, dst from x {lines}), r as (select src, dst, row_number() over (order by src, dst) - 1 as pos from l),
 g as (select id, count(dst) as deg from i left join l on l.src = i.id group by 1), o as (select id as pos, coalesce(sum(deg) over (order by id rows between unbounded preceding and 1 preceding), 0) as value from g
  union all select count(*), sum(deg) from g)
 select 'csr_cols{tail}' as file, pos, dst as value from r union all select 'csr_offsets{tail}', pos, value::bigint from o"""


@query(f"with {_csr_sql('')} union all select 'vertexs', pos, src from r")
def export_sss(spark, d):
    folder = table_path(spark, "sss")
    exports.export_csr(graphs.edges(spark, d), folder)
    return _vectors(spark, folder, ["csr_cols", "csr_offsets", "vertexs"])


@query(f"with {_csr_sql('where src < dst', '_tri')}")
def export_tc(spark, d):
    folder = table_path(spark, "tc")
    exports.export_csr(graphs.edges(spark, d), folder, oriented=True)
    return _vectors(spark, folder, ["csr_cols_tri", "csr_offsets_tri"])


@query(f"with {_csr_sql('')}")
def export_merged(spark, d):
    """The same vectors from files of five ranges, merged."""
    folder = table_path(spark, "ranges")
    cols, offsets, n = exports.export_partitions(graphs.edges(spark, d), folder, 5)
    exports.merge_partitions(spark, cols, offsets, n, folder)
    return _vectors(spark, folder, ["csr_cols"]).unionByName(_vectors(spark, folder, ["csr_offsets"], "int64"))


@query(f"with {_DENSE} select src as u, dst as v from x")
def csr_scan(spark, d):
    folder = table_path(spark, "csr")
    exports.export_csr(graphs.edges(spark, d), folder)
    return exports.read_csr(spark, folder)


@query(f"with {_DENSE} select src as u, dst as v from x")
def stream_scan(spark, d):
    """Neighbours through a block-compressed stream of 256 nodes a block."""
    e, folder = graphs.edges(spark, d), table_path(spark, "stream")
    ids = materialize(dense_ids(e), "ids")
    s = symmetric(e).join(ids.toDF("src", "u"), "src").join(ids.toDF("dst", "v"), "dst")
    exports.write_stream(s.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("nbrs")), folder, ids.count(), 256)
    return exports.read_stream(spark, folder, 256)


@query(f"""with recursive {texts._IDX}, n as (select count(*)::bigint as n from docs), nd as (select doc, row_number() over (order by doc) - 1 as id from docs),
 sp as (select 10007::bigint as k union all select k + 1 from sp, n where gcd(k, n) <> 1), st as (select (max(k) * max(k)) % (select n from n) as step from sp),
 ks as (select term, df, row_number() over (order by term) - 1 as term_id from (select * from v qualify row_number() over (order by df desc, term_id) > floor((select count(*) from v) * 0.0001))),
 r as (select ks.term_id, nd.id, (nd.id * (select step from st)) % (select n from n) as value, row_number() over (order by ks.term_id, nd.id) - 1 as pos from p join ks using (term) join nd using (doc)),
 o as (select term_id as pos, coalesce(sum(df) over (order by term_id rows between unbounded preceding and 1 preceding), 0) as value from ks union all select count(*), sum(df) from ks),
 qs as (select _id as query, max(text) as text from queries where _id is not null group by 1), qn as (select query, row_number() over (order by query) - 1 as q from qs),
 qt as (select q, term_id, df from (select distinct query, unnest({texts.sql_tokens('text')}) as term from qs) join ks using (term) join qn using (query)),
 qr as (select term_id as value, row_number() over (order by q, df, term_id) - 1 as pos from qt),
 qg as (select qn.q, count(qt.q) as deg from qn left join qt on qt.q = qn.q group by 1),
 qo as (select q as pos, coalesce(sum(deg) over (order by q rows between unbounded preceding and 1 preceding), 0) as value from qg union all select count(*), sum(deg) from qg)
 select 'inverted_index' as file, pos, value from r union all select 'inverted_index_offsets', pos, value::bigint from o union all select 'query', pos, value from qr union all select 'query_offsets', pos, value::bigint from qo""")
def export_ir(spark, d):
    folder = table_path(spark, "ir")
    exports.export_index(texts._docs(spark, d), texts._docs(spark, d, "queries", "query"), folder)
    return _vectors(spark, folder, ["inverted_index", "inverted_index_offsets", "query", "query_offsets"])


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{d}/{name}.parquet")


@query("select l_partkey as u, l_suppkey as v from lineitem where l_partkey <> l_suppkey")
def edge_list_scan(spark, d):
    """Lines `u v weight` among comments and broken lines."""
    folder = table_path(spark, "edges")
    lines = _table(spark, d, "lineitem").select(F.explode(F.array(F.concat_ws(" ", "l_partkey", "l_suppkey", "l_quantity"), F.lit("# note"), F.lit("broken line"), F.col("l_orderkey").cast("string"))).alias("value"))
    lines.write.text(folder)
    return files.edge_list(spark, folder)


@query("select _id, text, title from corpus")
def json_lines_scan(spark, d):
    folder = table_path(spark, "json")
    _table(spark, d, "corpus").select("_id", "text", "title").write.option("ignoreNullFields", False).json(folder)
    return files.json_lines(spark, folder)


@query("select query_id, iter, doc_id, coalesce(relevance, -1) as relevance from qrels")
def judgements_scan(spark, d):
    folder = table_path(spark, "judgements")
    _table(spark, d, "qrels").select("query_id", "iter", "doc_id", "relevance").write.option("sep", "\t").csv(folder)
    return files.judgements(spark, folder).fillna(-1, ["relevance"])


@query("select event_id, event_type, value, user_id from events")
def results_csv_scan(spark, d):
    """A result table with its known columns first, read back by its schema."""
    folder = table_path(spark, "results")
    files.write_results_csv(_table(spark, d, "events").select("value", "user_id", "event_type", "event_id"), folder, ["event_id", "event_type"])
    return files.results_csv(spark, folder, "event_id long, event_type string, user_id long, value double")


@query("select distinct l_partkey as u, l_suppkey as v from lineitem")
def weighted_tsv_scan(spark, d):
    """Lines `u v w` after a header of sizes, in one file."""
    folder = table_path(spark, "tsv")
    e = _table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    head = spark.createDataFrame([("% about", 0), ("999999 999999 7", 1)], "value string, at int")
    rows = e.select(F.concat_ws("\t", "l_partkey", "l_suppkey", F.lit(1)).alias("value"), F.lit(2).alias("at"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(folder)
    return files.weighted_tsv(spark, folder)
