"""Queries over the sample tables, one for each operator, with the same in SQL."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Aggregate, Avg, Concat, Counts, Extend, GroupRows, Max, Median, Min, Sort, Sum, Top, Unique, UniqueCounts
from . import equal, from_dataframe, group, inner_join, left_outer_join, list_columns, named, right_outer_join, sort, typed
from .operators import criteria as C
from .sources.dataset import Dataset

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str, alias: str | None = None) -> Dataset:
    return typed(spark, alias or name, f"{sf}/{name}.parquet")


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf: f(spark, sf).df
        SQL[f.__name__] = sql
        return f

    return put


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def list_filter(spark, sf):
    d = _t(spark, sf, "lineitem").where(C.gt("l_quantity", 45)).where(C.eq("l_returnflag", "R"))
    return list_columns(d, "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_custkey, count(o_orderkey) AS counts_o_orderkey, max(o_totalprice) AS max_o_totalprice, min(o_totalprice) AS min_o_totalprice FROM orders GROUP BY o_custkey")
def group_count_max_min(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Counts(d["o_orderkey"]), Max(d["o_totalprice"]), Min(d["o_totalprice"]))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(l_orderkey) AS n, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 0) AS revenue FROM lineitem GROUP BY ALL")
def group_sum_avg(spark, sf):
    d = _t(spark, sf, "lineitem").compute(price=lambda c: c("l_extendedprice") * (1 - c("l_discount")))
    r = named(group(d).by("l_returnflag", "l_linestatus").select(d["l_returnflag"], d["l_linestatus"], Sum(d["l_quantity"]).rename("q"), Avg(d["l_discount"]).rename("a"), Counts(d["l_orderkey"]).rename("n"), Sum(d["price"]).rename("p")), "sums")
    r = r.compute(sum_qty=F.round("q", 2), avg_disc=F.round("a", 6), revenue=F.round(F.col("p") / 1000, 0))
    return list_columns(r, "l_returnflag", "l_linestatus", "sum_qty", "avg_disc", "n", "revenue")


@query("SELECT o_custkey, list_sort(list(o_orderkey), 'ASC', 'NULLS FIRST')[count(*) // 2 + 1] AS medium_o_orderkey FROM orders GROUP BY o_custkey")
def group_median(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Median(d["o_orderkey"]))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY CAST(o_orderkey AS VARCHAR)) AS concate_o_orderkey FROM orders GROUP BY o_custkey")
def group_concat(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Concat(d["o_orderkey"]))


@query("SELECT l_suppkey, count(DISTINCT (l_returnflag, l_linestatus)) AS uniquecounts_l_returnflag FROM lineitem GROUP BY l_suppkey")
def group_unique_counts(spark, sf):
    d = _t(spark, sf, "lineitem")
    return group(d).by("l_suppkey").select(d["l_suppkey"], UniqueCounts(d["l_returnflag"], d["l_linestatus"]))


@query("SELECT DISTINCT l_suppkey, l_returnflag AS unique_l_returnflag, l_linestatus AS unique_l_linestatus FROM lineitem")
def group_unique(spark, sf):
    d = _t(spark, sf, "lineitem")
    return group(d).by("l_suppkey").select(d["l_suppkey"], Unique(d["l_returnflag"], d["l_linestatus"]))


@query("SELECT o_custkey, o_orderkey AS top_o_orderkey, o_totalprice AS top_o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= 3")
def group_top(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Top([d["o_orderkey"], d["o_totalprice"]], 3, [Sort("o_totalprice", False), Sort("o_orderkey")]))


@query("""SELECT t.o_custkey, t.o_orderkey AS top_o_orderkey, u.o_orderpriority AS unique_o_orderpriority FROM
  (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) t
  JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) u USING (o_custkey)""")
def group_top_times_unique(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Top([d["o_orderkey"]], 2), Unique(d["o_orderpriority"]))


@query("SELECT o_custkey, o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey) AS counts_o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS max_o_totalprice FROM orders")
def group_detail_with_aggregate(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], d["o_orderkey"], Counts(d["o_orderkey"]), Max(d["o_totalprice"]))


@query("SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) >= 12")
def group_having(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Counts(d["o_orderkey"]).rename("n"), having=C.ge("n", 12))


@query("SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_suppkey")
def group_user_aggregate(spark, sf):
    d = _t(spark, sf, "lineitem")
    return group(d).by("l_suppkey").select(d["l_suppkey"], Aggregate(d["l_quantity"], build=lambda c: F.max(c) - F.min(c)).rename("spread"))


@query("SELECT n_regionkey, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS place FROM nation")
def group_user_rows(spark, sf):
    d = _t(spark, sf, "nation")

    def places(rows):
        out = rows.sort_values("n_name").reset_index(drop=True)
        return out.assign(place=out.index + 1)

    return group(d).by("n_regionkey").select(d["n_regionkey"], GroupRows(d["n_name"], function=places, schema="name string, place bigint"))


@query("SELECT avg_ms FROM (SELECT o_custkey, CAST(floor(avg(epoch_ms(o_orderdate))) AS BIGINT) AS avg_ms FROM orders GROUP BY o_custkey)")
def group_avg_time(spark, sf):
    d = _t(spark, sf, "orders")
    r = named(group(d).by("o_custkey").select(d["o_custkey"], Avg.of_time(d["o_orderdate"]).rename("t")), "times")
    return list_columns(r.compute(avg_ms=F.unix_millis("t")), "avg_ms")


@query("SELECT o_custkey, round(avg(CAST(o_totalprice AS DECIMAL(38, 18))), 1) AS mean FROM orders GROUP BY o_custkey")
def group_avg_scale(spark, sf):
    d = _t(spark, sf, "orders")
    r = named(group(d).by("o_custkey").select(d["o_custkey"], Avg(d["o_totalprice"], scale=1).rename("m")), "means")
    return list_columns(r.compute(mean=F.col("m").cast("double")), "o_custkey", "mean")


@query("SELECT c_custkey, c_name, n AS counts_o_orderkey FROM customer JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def join_inner_aggregate(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return inner_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], c["c_name"], Counts(o["o_orderkey"]))


@query("SELECT c_custkey AS customer, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner_detail(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return inner_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"].rename("customer"), o["o_orderkey"], o["o_totalprice"])


@query("""SELECT n_name, nc AS customers, ns AS suppliers FROM nation JOIN (SELECT c_nationkey, count(c_custkey) AS nc FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
  JOIN (SELECT s_nationkey, count(s_suppkey) AS ns FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""")
def join_inner_three(spark, sf):
    n, c, s = _t(spark, sf, "nation"), _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    return inner_join(n, c, s).on(equal(n["n_nationkey"], c["c_nationkey"], s["s_nationkey"])).select(n["n_name"], Counts(c["c_custkey"]).rename("customers"), Counts(s["s_suppkey"]).rename("suppliers"))


@query("""SELECT a.l_orderkey, a.l_suppkey, a.q AS max_q, b.n FROM (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL) a
  JOIN (SELECT l_orderkey, l_suppkey, count(l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey""")
def join_composite_self(spark, sf):
    a, b = _t(spark, sf, "lineitem", "every"), _t(spark, sf, "lineitem", "returned").where(C.eq("l_returnflag", "R"))
    on = (equal(a["l_orderkey"], b["l_orderkey"]), equal(a["l_suppkey"], b["l_suppkey"]))
    return inner_join(a, b).on(*on).select(a["l_orderkey"], a["l_suppkey"], Max(a["l_quantity"]).rename("max_q"), Counts(b["l_partkey"]).rename("n"))


_URGENT = "(SELECT o_custkey, count(o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)"


@query(f"SELECT c_custkey, coalesce(CAST(n AS VARCHAR), 'N/A') AS urgent FROM customer LEFT JOIN {_URGENT} ON c_custkey = o_custkey")
def join_left_replacement(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders").where(C.eq("o_orderpriority", "1-URGENT"))
    return left_outer_join(c, o, "N/A").on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], Counts(o["o_orderkey"]).rename("urgent"))


@query(f"SELECT c_custkey, n AS urgent FROM customer LEFT JOIN {_URGENT} ON c_custkey = o_custkey")
def join_left_null(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders").where(C.eq("o_orderpriority", "1-URGENT"))
    return left_outer_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], Counts(o["o_orderkey"]).rename("urgent"))


@query("SELECT coalesce(CAST(o_orderkey AS VARCHAR), 'none') AS o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right_replacement(spark, sf):
    o, c = _t(spark, sf, "orders").where(C.eq("o_orderpriority", "1-URGENT")), _t(spark, sf, "customer")
    return right_outer_join(o, c, "none").on(equal(o["o_custkey"], c["c_custkey"])).select(o["o_orderkey"], c["c_name"])


@query("SELECT c_custkey, o_orderkey, c_acctbal + o_totalprice AS together FROM customer JOIN orders ON c_custkey = o_custkey")
def join_function_of_both(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return inner_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], o["o_orderkey"], Extend(c["c_acctbal"], o["o_totalprice"], build=lambda a, b: a + b).rename("together"))


@query("SELECT c_custkey, max(c_acctbal + o_totalprice) AS most FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_aggregate_of_both(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return inner_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], Aggregate(c["c_acctbal"], o["o_totalprice"], build=lambda a, b: F.max(a + b)).rename("most"))


@query("SELECT o_orderkey FROM orders WHERE (CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01') AND NOT o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def filter_dates_and_lists(spark, sf):
    p = C.ge("o_orderdate", dt.date(1997, 1, 1)) & C.lt("o_orderdate", dt.date(1998, 1, 1)) & C.not_within("o_orderpriority", ["1-URGENT", "2-HIGH"]) & C.within("o_custkey", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    return list_columns(_t(spark, sf, "orders").where(p), "o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}') OR p_size <= 3 OR p_brand <> 'Brand#1' AND NOT p_retailprice >= 950")
def filter_regex(spark, sf):
    p = C.regex("p_name", "[aeiou]{2}") | C.le("p_size", 3) | C.ne("p_brand", "Brand#1") & ~C.ge("p_retailprice", 950)
    return list_columns(_t(spark, sf, "part").where(p), "p_partkey", "p_name")


@query("SELECT n_name FROM nation WHERE lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 5) OR n_nationkey = n_regionkey")
def filter_file_and_columns(spark, sf):
    d = _t(spark, sf, "nation")
    small = [r[0] for r in list_columns(d.where(C.lt("n_nationkey", 5)), "n_name").df.collect()]  # five rows
    with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False) as f:
        f.write("\n".join(x.upper() for x in small))
    try:
        p = C.within_file("n_name", f.name) | C.eq_columns("n_nationkey", "n_regionkey")
    finally:
        os.unlink(f.name)
    return list_columns(d.where(p), "n_name")


@query("SELECT event_id, props->>'k' AS props_k FROM events WHERE try_cast(props->>'k' AS DOUBLE) > 50")
def map_access(spark, sf):
    e = _t(spark, sf, "events")
    d = from_dataframe("e", e.df.select("event_id", F.from_json("props", "map<string,string>").alias("props"))).where(C.gt("props.k", 50))
    return list_columns(d, "event_id", "props.k")


@query("SELECT p_partkey, w AS word, length(p_name) AS letters FROM part, unnest(string_split(p_name, ' ')) t(w)")
def computed_rows(spark, sf):
    d = _t(spark, sf, "part").expand(["word"], lambda c: F.split(c("p_name"), " ")).compute(letters=lambda c: F.length(c("p_name")).cast("bigint"))
    return list_columns(d, "p_partkey", "word", "letters")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def total_sort(spark, sf):
    return sort(_t(spark, sf, "customer")).select("c_custkey", "c_acctbal").order_by(Sort("c_acctbal", False, numeric=True), Sort("c_custkey"))


@query("SELECT c_mktsegment, max(n) AS busiest FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY c_mktsegment")
def chained_jobs(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    r = named(inner_join(c, o).on(equal(c["c_custkey"], o["o_custkey"])).select(c["c_custkey"], c["c_mktsegment"], Counts(o["o_orderkey"]).rename("n")), "per_customer")
    return group(r).by("c_mktsegment").select(r["c_mktsegment"], Max(r["n"]).rename("busiest"))


@query("SELECT doc_id, text FROM documents WHERE trim(text) <> '' UNION ALL SELECT item_id, text FROM benchmark")
def several_paths(spark, sf):
    d = typed(spark, "texts", f"{sf}/documents.parquet", ["doc_id", "text"]).where(C.not_null("text"))
    b = _t(spark, sf, "benchmark")
    return Dataset("result", list_columns(d, "doc_id", "text").df.unionByName(b.df.withColumnRenamed("item_id", "doc_id")))


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["join_inner_aggregate"](spark, "/root/testdata/sf0.001")


from . import catalog_sources  # noqa: E402, F401  its queries enter the same tables
