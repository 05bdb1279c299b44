"""Further queries of the catalog: text and typed files written and read again, counters, comparisons and comparators."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from . import Avg, Concat, Counts, Max, Median, Min, Sort, Top, counted, delimited, from_dataframe, group, list_columns, named, read, register, run, save, save_text, sequence_file, settings, typed
from .catalog import _t, query
from .operators import criteria as C
from .sources.dataset import Dataset


def _scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends; a local one only where all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    path = f"{(root or tempfile.gettempdir()).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _row(spark: SparkSession, **values: int) -> Dataset:
    return from_dataframe("counters", spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} bigint" for k in values)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS more FROM orders")
def text_written_and_read(spark, sf):
    path = _scratch(spark)
    save_text(list_columns(_t(spark, sf, "orders"), "o_orderkey", "o_orderpriority"), path, sep="|")
    return list_columns(delimited(spark, "lines", path, ["key", "priority", "more"], sep="|", marker=True), "key", "priority", "more")


_LINE = "o_orderkey % 10 <> 0"


@query(f"SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE {_LINE}")
def text_own_parser(spark, sf):
    return list_columns(_parsed(spark, sf, None), "o_orderkey", "status")


def _parsed(spark, sf, counters):
    """Lines key=status, of which every tenth has no sign and is malformed."""
    path = _scratch(spark)
    d = _t(spark, sf, "orders").compute(line=lambda c: F.concat(c("o_orderkey").cast("string"), F.when(c("o_orderkey") % 10 != 0, "=").otherwise(""), c("o_orderstatus")))
    save(list_columns(d, "line"), path, "text")

    def parser(lines):
        parts = F.split("value", "=")
        return lines.select(F.get(parts, 0).try_cast("bigint").alias("o_orderkey"), F.get(parts, 1).alias("status"), (F.size(parts) < 2).alias("_malformed"))

    return delimited(spark, "own", path, ["o_orderkey", "status"], parser=parser, counters=counters)


@query(f"SELECT count(*) AS read, count(*) FILTER (NOT {_LINE}) AS malformed FROM orders")
def counter_of_malformed_lines(spark, sf):
    counters = Observation("lines")
    list_columns(_parsed(spark, sf, counters), "status").df.write.format("noop").mode("overwrite").save()
    return _row(spark, read=counters.get["read"], malformed=counters.get["malformed"])


@query("SELECT count(*) AS input, count(*) FILTER (o_totalprice > 100000) AS output, count(*) FILTER (NOT o_totalprice > 100000) AS filtered FROM orders")
def counters_of_rows(spark, sf):
    seen, counters = counted(_t(spark, sf, "orders").where(C.gt("o_totalprice", 100000)))
    list_columns(seen, "o_orderkey").df.write.format("noop").mode("overwrite").save()
    return _row(spark, **{k: counters.get[k] for k in ("input", "output", "filtered")})


@query("SELECT count(*) AS input, count(*) FILTER (n >= 12) AS output, count(*) FILTER (n < 12) AS filtered FROM (SELECT count(o_orderkey) AS n FROM orders GROUP BY o_custkey)")
def counters_of_groups(spark, sf):
    d = _t(spark, sf, "orders")
    seen, counters = counted(group(d).by("o_custkey").select(d["o_custkey"], Counts(d["o_orderkey"]).rename("n")).where(C.ge("n", 12)), "groups")
    list_columns(seen, "n").df.write.format("noop").mode("overwrite").save()
    return _row(spark, **{k: counters.get[k] for k in ("input", "output", "filtered")})


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 5000")
def program_with_settings(spark, sf):
    path = _scratch(spark)

    def main(session, argv):
        most, target = float(argv[0]), argv[1]
        save(list_columns(_t(session, sf, "supplier").where(C.lt("s_acctbal", most)), "s_suppkey", "s_name"), target, "orc")

    if run(main, ["-D", "spark.sql.files.maxPartitionBytes=64m", "5000", path], spark):
        raise RuntimeError("the program failed")
    return list_columns(typed(spark, "written", path, fmt="orc", marker=True), "s_suppkey", "s_name")


@query("SELECT c_custkey, c_name FROM customer")
def paths_listed(spark, sf):
    low, high = _scratch(spark), _scratch(spark)
    d = _t(spark, sf, "customer")
    save(list_columns(d.where(C.lt("c_custkey", 50)), "c_custkey", "c_name"), low)
    save(list_columns(d.where(C.ge("c_custkey", 50)), "c_custkey", "c_name"), high)
    return list_columns(read(spark, "parquet", "both", [low, high], marker=True), "c_custkey", "c_name")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def paths_by_pattern_json(spark, sf):
    path = _scratch(spark)
    d = _t(spark, sf, "part")
    save(list_columns(d.where(C.le("p_size", 20)), "p_partkey", "p_name", "p_retailprice"), f"{path}/small", "json")
    save(list_columns(d.where(C.gt("p_size", 20)), "p_partkey", "p_name", "p_retailprice"), f"{path}/large", "json")
    return list_columns(typed(spark, "all", f"{path}/*", ["p_partkey", "p_name", "p_retailprice"], "json"), "p_partkey", "p_name", "p_retailprice")


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, upper(n_name) AS name FROM nation WHERE n_nationkey <> 3")
def sequence_file_own_mapper(spark, sf):
    path = _scratch(spark)
    _t(spark, sf, "nation").df.select("n_nationkey", "n_name").rdd.map(tuple).saveAsSequenceFile(path)
    return list_columns(sequence_file(spark, "pairs", path, lambda k, v: None if k == 3 else (k, v.upper()), "key int, name string"), "key", "name")


@query("SELECT r_regionkey, lower(r_name) AS r_name FROM region")
def registered_reader(spark, sf):
    register("lowered", lambda spark, name, paths, **options: from_dataframe(name, typed(spark, name, paths, **options).df.withColumn("r_name", F.lower("r_name"))))
    return list_columns(read(spark, "lowered", "regions", f"{sf}/region.parquet"), "r_regionkey", "r_name")


@query("SELECT n_name FROM nation WHERE NOT lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 5)")
def filter_not_within_file(spark, sf):
    d = _t(spark, sf, "nation")
    small = [r[0] for r in list_columns(d.where(C.lt("n_nationkey", 5)), "n_name").df.collect()]  # five rows
    with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False) as f:
        f.write("\n".join(x.upper() for x in small))
    try:
        p = C.not_within_file("n_name", f.name)
    finally:
        os.unlink(f.name)
    return list_columns(d.where(p), "n_name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey > l_suppkey AND l_quantity >= l_linenumber AND l_partkey <> l_orderkey)
  OR (l_suppkey < l_linenumber) OR (l_partkey <= l_linenumber AND l_orderkey = l_partkey)""")
def filter_column_comparisons(spark, sf):
    p = (C.gt_columns("l_partkey", "l_suppkey") & C.ge_columns("l_quantity", "l_linenumber") & C.ne_columns("l_partkey", "l_orderkey")) | C.lt_columns("l_suppkey", "l_linenumber")
    p = p | (C.le_columns("l_partkey", "l_linenumber") & C.eq_columns("l_orderkey", "l_partkey"))
    return list_columns(_t(spark, sf, "lineitem").where(p), "l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE (value > 50) AND ts >= TIMESTAMP '2024-01-01 12:00:00' OR (NOT value > 50) AND CAST(ts AS DATE) = DATE '2024-01-02'")
def filter_booleans_and_moments(spark, sf):
    d = _t(spark, sf, "events").compute(much=lambda c: c("value") > 50)
    p = C.eq("much", True) & C.ge("ts", dt.datetime(2024, 1, 1, 12)) | C.ne("much", True) & C.eq("ts", dt.date(2024, 1, 2))
    return list_columns(d.where(p), "event_id")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%d.%m.%Y') <> '' AND CAST(o_orderdate AS DATE) > DATE '1996-06-30'")
def filter_dates_by_format(spark, sf):
    d = _t(spark, sf, "orders").compute(day=lambda c: F.date_format(c("o_orderdate"), "dd.MM.yyyy"))
    return list_columns(d.where(C.gt("day", dt.date(1996, 6, 30), "dd.MM.yyyy")), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 2000 + l_quantity")
def filter_user_predicate(spark, sf):
    p = C.expression(lambda price, off, n: price * off > 2000 + n, "l_extendedprice", "l_discount", "l_quantity")
    return list_columns(_t(spark, sf, "lineitem").where(p), "l_orderkey", "l_linenumber")


@query("""SELECT c_nationkey, max_by(c_custkey, abs(c_acctbal)) AS farthest, min_by(c_custkey, abs(c_acctbal)) AS nearest,
  list_sort(list({'k': abs(c_acctbal), 'v': c_custkey}))[count(*) // 2 + 1].v AS middle, list_sort(list(c_custkey)) AS listed FROM customer GROUP BY c_nationkey""")
def group_comparators(spark, sf):
    d = _t(spark, sf, "customer").compute(far=lambda c: F.struct(F.abs(c("c_acctbal")).alias("k"), c("c_custkey").alias("v")))
    key = lambda x: x["k"]
    r = group(d).by("c_nationkey").select(d["c_nationkey"], Max(d["far"], key=key).rename("most"), Min(d["far"], key=key).rename("least"), Median(d["far"], key=key).rename("mid"), Concat(d["c_custkey"], joined=False).rename("listed"))
    r = named(r, "found").compute(farthest=F.col("most.v"), nearest=F.col("least.v"), middle=F.col("mid.v"))
    return list_columns(r, "c_nationkey", "farthest", "nearest", "middle", "listed")


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS top_key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2")
def group_top_numbers_as_text(spark, sf):
    d = _t(spark, sf, "orders").compute(key=lambda c: c("o_orderkey").cast("string"))
    return group(d).by("o_custkey").select(d["o_custkey"], Top([d["key"]], 2, [Sort("key", False, numeric=True)]))


@query("SELECT o_custkey, CAST(make_timestamp(CAST(floor(avg(epoch_ms(CAST(o_orderdate AS DATE)))) AS BIGINT) * 1000) AS DATE) AS day FROM orders GROUP BY o_custkey")
def group_avg_of_dates(spark, sf):
    with settings(spark, spark__sql__session__timeZone="UTC"):
        d = _t(spark, sf, "orders").compute(day=lambda c: c("o_orderdate").cast("date"))
        return group(d).by("o_custkey").select(d["o_custkey"], Avg.of_time(d["day"]).rename("day"))


@query("SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey")
def group_in_three_parts(spark, sf):
    d = _t(spark, sf, "orders")
    return group(d).by("o_custkey").select(d["o_custkey"], Counts(d["o_orderkey"]).rename("n"), partitions=3)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def dataset_in_order(spark, sf):
    return list_columns(_t(spark, sf, "customer").where(C.gt("c_acctbal", 0)).order_by(Sort("c_acctbal", False), "c_custkey"), "c_custkey", "c_acctbal")
