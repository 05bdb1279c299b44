"""Nulls, types and edges of readers, predicates and functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomframe import Avg, Concat, Counts, Extend, Max, Median, Min, Sort, Sum, Top, Unique, UniqueCounts, delimited, equal, from_dataframe, group, inner_join, left_outer_join, list_columns, read, register, sequence_file
from loomframe.operators import criteria as C


def frame(spark, name, rows, schema):
    return from_dataframe(name, spark.createDataFrame(rows, schema))


def rows(result):
    return sorted((tuple(r) for r in result.df.collect()), key=repr)


def test_delimited_cells(spark, tmp_path):
    (tmp_path / "a").write_text("1||x\n\n2|\n3|b|c|d\n")
    d = delimited(spark, "d", str(tmp_path / "a"), ["A", "b", "c"], sep="|", extra=1)
    assert d.columns == ["a", "b", "c", "idx_3"]
    assert rows(d) == sorted([("1", "", "x", None), (None,) * 4, ("2", "", None, None), ("3", "b", "c", "d")], key=repr)


def test_long_separator_globs_and_several_paths(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(f"{n}.*1\n")
    for paths in (str(tmp_path / "*.txt"), [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]):
        assert rows(delimited(spark, "d", paths, ["x", "y"], sep=".*")) == [("a", "1"), ("b", "1")]
    with pytest.raises(FileNotFoundError):
        delimited(spark, "d", str(tmp_path / "none"), ["x"])
    with pytest.raises(FileNotFoundError):
        delimited(spark, "d", str(tmp_path), ["x"], marker=True)


def test_parser_drops_malformed_rows(spark, tmp_path):
    (tmp_path / "a").write_text("x=1\nbroken\n")
    parse = lambda df: df.select(F.split("value", "=")[0].alias("k"), F.get(F.split("value", "="), F.lit(1)).alias("v"), (~F.contains("value", F.lit("="))).alias("_malformed"))
    assert rows(delimited(spark, "d", str(tmp_path / "a"), ["k", "v"], parser=parse)) == [("x", "1")]


def test_sequence_files_and_registry(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.sparkContext.parallelize([(1, "a"), (2, "")]).saveAsSequenceFile(path)
    d = sequence_file(spark, "d", path, lambda k, v: (k, v) if v else None, "k int, v string")
    assert rows(d) == [(1, "a")]
    register("twice", lambda spark, name, paths: from_dataframe(name, spark.range(2).toDF("Id")))
    assert read(spark, "twice", "d", "x").columns == ["id"]
    with pytest.raises(ValueError):
        read(spark, "nothing", "d", "x")


@pytest.fixture
def typed(spark):
    t = dt.datetime
    return frame(
        spark, "t",
        [(1, 1.5, "1", True, t(2020, 1, 2, 3, 4, 5), "2020-01-02", None, {"K": "v"}), (None, None, None, None, None, None, "x", None), (3, -2.0, " ", False, t(2021, 1, 1), "2021-01-01", "x", {"k": "w", "z": "y"})],
        "i int, d double, s string, b boolean, ts timestamp, day string, n string, m map<string,string>",
    )


@pytest.mark.parametrize(
    "predicate, kept",
    [
        (C.eq("i", 1), [1]),
        (C.ne("i", 1), [3]),
        (~C.eq("i", 1), [None, 3]),
        (C.gt("d", 0), [1]),
        (C.ge("i", 3), [3]),
        (C.lt("d", 1.5), [3]),
        (C.le("d", 1.5), [1, 3]),
        (C.eq("s", "1"), [1]),
        (C.eq("i", "3"), [3]),
        (C.eq("b", False), [3]),
        (C.eq("ts", dt.date(2020, 1, 2)), [1]),
        (C.eq("ts", dt.datetime(2020, 1, 2)), [1]),
        (C.eq("ts", dt.datetime(2020, 1, 2, 3, 4, 5)), [1]),
        (C.gt("ts", dt.datetime(2020, 1, 2, 3, 4, 5)), [3]),
        (C.lt("day", dt.date(2021, 1, 1), "yyyy-MM-dd"), [1]),
        (C.within("i", [3, 4]), [3]),
        (C.not_within("s", ["1"]), [None, 3]),
        (C.regex("s", "[0-9]"), [1]),
        (C.not_null("s"), [1]),
        (C.not_null("i"), [1, 3]),
        (C.eq_columns("n", "n"), [1, None, 3]),
        (C.ne_columns("i", "d"), [1, 3]),
        (C.lt_columns("n", "s"), [1]),
        (C.ge_columns("s", "n"), [1]),
        (C.le_columns("i", "d"), [1, None]),
        (C.gt_columns("i", "d"), [3]),
        (C.eq("m.k", "v"), [1]),
        (C.eq("i", 1) | C.eq("n", "x") & C.eq("i", 3), [1, 3]),
        (~(C.eq("i", 1) | C.eq("i", 3)), [None]),
        (C.expression(lambda a, b: a > b, "i", "d"), [3]),
    ],
)
def test_predicates(typed, predicate, kept):
    assert [r[0] for r in rows(list_columns(typed.where(predicate), "i"))] == sorted(kept, key=lambda x: repr((x,)))


def test_file_predicates(typed, tmp_path):
    (tmp_path / "f").write_text("X\nother\n")
    path = str(tmp_path / "f")
    assert rows(list_columns(typed.where(C.within_file("n", path)), "i")) == sorted([(None,), (3,)], key=repr)
    assert rows(list_columns(typed.where(C.not_within_file("n", path)), "i")) == [(1,)]


def test_functions_with_nulls(spark):
    d = frame(spark, "d", [("a", 3, "x"), ("a", None, ""), ("a", 1, None), (None, None, None), ("b", 2, "y"), ("b", 2, "y")], "k string, v int, s string")
    got = group(d).by("k").select(d["k"], Counts(d["s"]), Max(d["v"]), Min(d["v"]), Sum(d["v"]), Avg(d["v"]), Median(d["v"]), Concat(d["s"]), UniqueCounts(d["v"], d["s"]))
    assert got.columns == ["k", "counts_s", "max_v", "min_v", "sum_v", "avg_v", "medium_v", "concate_s", "uniquecounts_v"]
    assert rows(got) == sorted([("a", 2, 3, 1, 4.0, 2.0, 1, ";x", 3), (None, 0, None, None, 0.0, None, None, "", 1), ("b", 2, 2, 2, 4.0, 2.0, 2, "y;y", 1)], key=repr)


def test_other_orders(spark):
    d = frame(spark, "d", [("a", "10"), ("a", "9"), ("a", None)], "k string, v string")
    number = lambda c: c.cast("int")
    assert rows(group(d).by("k").select(Max(d["v"]), Max(d["v"], key=number).rename("most"), Min(d["v"], key=number).rename("least"), Median(d["v"], key=number))) == [("9", "10", "9", "9")]


def test_sums(spark):
    d = frame(spark, "d", [(10.0,), (5e-324,), (10.0,), (5e-324,), (-15.0,), (-10.0,)], "v double").compute(k=F.lit(1))
    assert rows(group(d).by("k").select(Sum(d["v"]))) == [(-5.0,)]
    big = frame(spark, "d", [(1.7976931348623157e308,)] * 2, "v double").compute(k=F.lit(1))
    assert rows(group(big).by("k").select(Sum(big["v"]))) == [(float("inf"),)]
    text = frame(spark, "d", [("1.5",), ("2",), (None,)], "v string").compute(k=F.lit(1))
    assert [tuple(map(float, r)) for r in rows(group(text).by("k").select(Sum(text["v"]), Avg(text["v"], scale=1)))] == [(3.5, 1.8)]


def test_top_and_unique(spark):
    d = frame(spark, "d", [("a", 2, "p"), ("a", None, "q"), ("a", 2, "p"), ("b", 1, "r")], "k string, v int, s string")
    assert rows(group(d).by("k").select(d["k"], Top([d["v"]], 2))) == sorted([("a", None), ("a", 2), ("b", 1)], key=repr)
    assert rows(group(d).by("k").select(d["k"], Top([d["v"], d["s"]], 1, [Sort("v", False)]))) == [("a", 2, "p"), ("b", 1, "r")]
    assert rows(group(d).by("k").select(d["k"], Unique(d["v"], d["s"]))) == sorted([("a", None, "q"), ("a", 2, "p"), ("b", 1, "r")], key=repr)


def test_computed_columns(spark):
    d = frame(spark, "d", [(1, ["x", "y"]), (2, [])], "i int, a array<string>")
    d = d.expand(["e"], lambda c: c("a")).expand(["p", "q"], lambda c: F.array(F.struct(c("i"), c("i") + 1), F.struct(c("i"), c("i") + 2))).compute(t=lambda c: c("i") * 10)
    assert rows(list_columns(d.where(~C.eq("e", "y")), "i", "e", "q", "t")) == sorted([(1, "x", 2, 10), (1, "x", 3, 10), (2, None, 3, 20), (2, None, 4, 20)], key=repr)


def test_null_keys_meet_and_types_are_brought_together(spark):
    a = frame(spark, "a", [(1, "p"), (None, "q")], "k int, v string")
    b = frame(spark, "b", [("1", "r"), (None, "s"), ("1.0", "t")], "k string, w string")
    assert rows(inner_join(a, b).on(equal(a["k"], b["k"])).select(a["v"], b["w"])) == [("p", "r"), ("p", "t"), ("q", "s")]


def test_replacement_leaves_nulls_of_matches(spark):
    a = frame(spark, "a", [(1,), (2,)], "k int")
    b = frame(spark, "b", [(1, None)], "k int, w int")
    got = left_outer_join(a, b, 0).on(equal(a["k"], b["k"])).select(a["k"], b["w"], Extend(b["w"], build=lambda w: w + 1).rename("x"))
    assert rows(got) == sorted([(1, None, None), (2, "0", "0")], key=repr)


def test_user_functions(spark):
    d = frame(spark, "d", [("a", 1), ("a", 2)], "k string, v int")
    got = group(d).by("k").select(Extend(d["k"], d["v"], build=lambda k, v: [F.upper(k), v * 2], names=["big", "double"]), Max(d["v"]))
    assert rows(got) == [("A", 2, 2), ("A", 4, 2)]


def test_empty_inputs(spark):
    d = frame(spark, "d", [], "k string, v int")
    assert rows(group(d).by("k").select(d["k"], Counts(d["v"]), Top([d["v"]], 1))) == []
    assert rows(left_outer_join(d, frame(spark, "e", [("a",)], "k string")).on(equal(d["k"], frame(spark, "e", [("a",)], "k string")["k"])).select(d["v"], frame(spark, "e", [("a",)], "k string")["k"])) == []


def test_of_several_values_with_the_same_key_the_least_is_taken(spark):
    """In whatever order the rows come, for each type; the first of each list is the least."""
    kinds = {
        "a bigint": [-(2**63), -1, 5], "b double": [-2.5, 0.0, float("inf")], "c decimal(9,2)": [Decimal("-1.5"), Decimal(2), Decimal(10)], "d boolean": [False, True, True], "e string": ["", "a", "ab"], "f binary": [b"a", b"ab", b"b"],
        "g date": [dt.date(1900, 1, 1), dt.date(1970, 1, 1), dt.date(2020, 1, 2)], "h timestamp": [dt.datetime(1969, 1, 1), dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1)],
        "i struct<x:int,y:string>": [(None, "z"), (1, ""), (1, "x")], "j array<int>": [[1], [2], [3]], "k map<string,int>": [{"a": 1}, {"b": 1}, {"c": 1}],
    }
    names, up = [k.partition(" ")[0] for k in kinds], list(zip(*kinds.values(), strict=True))
    for placed in (up, up[::-1]):
        d = from_dataframe("d", spark.createDataFrame([(0, *r) for r in [[None] * len(names), *placed]], ", ".join(["z int", *kinds])).coalesce(1))
        for f in (Max, Min):
            found = group(d).by("z").select(*[f(d[n], key=lambda c: F.lit(1.5)).rename(n) for n in names]).df.first()
            assert tuple(found) == up[0]


def test_keys_that_are_null_or_not_numbers(spark):
    d = frame(spark, "d", [(0, 1.5, "b"), (0, float("nan"), "d"), (0, float("nan"), "c"), (0, None, "a"), (0, -1.0, "z"), (0, -1.0, "y"), (1, None, "x")], "g int, k double, v string")
    d = d.compute(both=lambda c: F.struct(c("k"), c("v")))
    key = lambda c: c["k"]
    got = group(d).by("g").select(d["g"], Max(d["both"], key=key).rename("most"), Min(d["both"], key=key).rename("least")).df.select("g", "most.v", "least.v").collect()
    assert sorted(map(tuple, got)) == [(0, "c", "y"), (1, None, None)]


def test_many_keys_with_nulls_meet(spark):
    """More keys than one column of null bits has, and one of a type that is compared null-safe."""
    names = [f"k{i}" for i in range(33)]
    schema = ", ".join([*[f"{n} int" for n in names], "b binary", "v int"])
    full = [*range(33), b"x"]
    without = lambda *at: tuple(None if i in at else v for i, v in enumerate(full))
    keys = [without(), without(0), without(1), without(31), without(32), without(33), without(0, 31, 33), (0,) * 33 + (b"",), (None,) * 34]
    a, b = frame(spark, "a", [(*k, i) for i, k in enumerate(keys)], schema), frame(spark, "b", [(*k, 10 * i) for i, k in enumerate(keys)] * 2, schema)
    names.append("b")
    got = inner_join(a, b).on(*[equal(a[n], b[n]) for n in names]).select(*[a[n] for n in names], Max(a["v"]).rename("v"), Counts(b["v"]).rename("n"), Max(b["v"]).rename("w"))
    assert rows(got) == sorted([(*[bytearray(x) if isinstance(x, bytes) else x for x in k], i, 2, 10 * i) for i, k in enumerate(keys)], key=repr)
