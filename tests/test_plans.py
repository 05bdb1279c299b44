"""What groups and joins cost: scans, shuffles and joins of their plans."""

import os
import re

import pytest

from loomframe import catalog, delimited, from_dataframe, list_columns, save, save_text

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shape(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def of(name):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        return tuple(len(re.findall(p, plan)) for p in (r"FileScan parquet", r"Exchange hashpartitioning", r"(SortMergeJoin|ShuffledHashJoin)"))

    yield of
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@needs_tables
@pytest.mark.parametrize("name", "group_count_max_min group_sum_avg group_median group_concat group_unique group_top group_detail_with_aggregate group_having group_user_aggregate group_avg_time group_avg_scale".split())
def test_a_group_is_one_scan_and_one_shuffle(shape, name):
    assert shape(name) == (1, 1, 0)


@needs_tables
@pytest.mark.parametrize("name, joins", [("join_inner_aggregate", 1), ("join_composite_self", 1), ("join_left_replacement", 1), ("join_left_null", 1), ("join_aggregate_of_both", 1), ("join_inner_three", 2)])
def test_a_join_reads_and_shuffles_each_side_once(shape, name, joins):
    assert shape(name) == (joins + 1, joins + 1, joins)


@needs_tables
def test_rows_that_are_joined_have_their_keys_once_and_one_column_for_nulls(spark, shape):
    assert shape("join_composite_self") == (2, 2, 1)
    plan = catalog.QUERIES["join_composite_self"](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    for columns in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert [re.sub(r"#.*", "", c) for c in columns.split(", ")[:-1]] == ["_k0", "_k1", "_n0"]
    assert "_o_" not in plan.partition("SortMergeJoin")[2]


def test_what_is_read_is_not_overwritten(spark, tmp_path, monkeypatch):
    """Also by a relative path, which Hadoop takes from the JVM's own working folder."""
    jvm_dir = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    folder = tmp_path / "out dir"
    d = from_dataframe("d", spark.createDataFrame([("a", "b")], "x string, y string"))
    save_text(list_columns(d, "x", "y"), str(folder))
    relative = os.path.relpath(folder, jvm_dir)
    for path in (str(folder), relative, f"file://{folder}", str(tmp_path)):
        lines = delimited(spark, "lines", str(folder), ["x", "y"])
        for write in (save_text, save):
            with pytest.raises(ValueError):
                write(list_columns(lines, "x"), path)
    assert [tuple(r) for r in list_columns(delimited(spark, "lines", relative, ["x", "y"]), "x", "y").df.collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        delimited(spark, "lines", str(folder), ["x", "X"])
