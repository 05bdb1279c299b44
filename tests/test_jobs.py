"""Groups, joins and sorts on delimited text, with the results that the same queries are known to have."""

import pytest

from loomframe import Counts, Max, Sort, delimited, equal, group, inner_join, left_outer_join, list_columns, right_outer_join, save_text, sort
from loomframe.operators import criteria as C

ITEMS = "1\tM1\tM2\t20.2\n2\tM2\tM4\t100.0\n3\tM1\tM2\t10.0\n4\tM3\t\t100\n"
MEMBERS = "M1,John\nM2,Bill\nM3,Kate\nM4,Sandy\n"


@pytest.fixture
def items(spark, tmp_path):
    (tmp_path / "items.tsv").write_text(ITEMS)
    return delimited(spark, "items", str(tmp_path / "items.tsv"), ["ITEM_ID", "SELLER_ID", "BUYER_ID", "ITEM_PRICE"])


@pytest.fixture
def members(spark, tmp_path):
    (tmp_path / "members.csv").write_text(MEMBERS)
    return delimited(spark, "members", str(tmp_path / "members.csv"), ["id", "name"], sep=",")


def rows(result):
    return sorted((tuple(r) for r in result.df.collect()), key=repr)


def test_group(items):
    got = rows(group(items).by("SELLER_ID").select(items["seller_id"], Counts(items["item_id"]), Max(items["item_price"])))
    assert got == [("M1", 2, "20.2"), ("M2", 1, "100.0"), ("M3", 1, "100")]


def test_inner_join_aggregate(items, members):
    got = rows(inner_join(members, items).on(equal(members["id"], items["buyer_id"])).select(items["buyer_id"], members["name"], Counts(items["item_id"])))
    assert got == [("M2", "Bill", 2), ("M4", "Sandy", 1)]


def test_inner_join_detail(items, members):
    got = rows(inner_join(members, items).on(equal(members["id"], items["buyer_id"])).select(items["buyer_id"], members["name"], items["item_id"]))
    assert got == [("M2", "Bill", "1"), ("M2", "Bill", "3"), ("M4", "Sandy", "2")]


def test_left_outer_join(items, members):
    got = rows(left_outer_join(members, items, "N/A").on(equal(members["id"], items["buyer_id"])).select(members["id"], members["name"], Counts(items["item_id"])))
    assert got == [("M1", "John", "N/A"), ("M2", "Bill", "2"), ("M3", "Kate", "N/A"), ("M4", "Sandy", "1")]


def test_right_outer_join(items, members):
    got = rows(right_outer_join(items, members).on(equal(items["buyer_id"], members["id"])).select(Counts(items["item_id"]), members["name"]))
    assert got == [(1, "Sandy"), (2, "Bill"), (None, "John"), (None, "Kate")]


def test_sort(items):
    out = sort(items).select("item_id", "item_price", "seller_id", "buyer_id").order_by(Sort("item_price", False, numeric=True), Sort("seller_id"))
    assert [tuple(r) for r in out.df.collect()] == [("2", "100.0", "M2", "M4"), ("4", "100", "M3", ""), ("1", "20.2", "M1", "M2"), ("3", "10.0", "M1", "M2")]


def test_save_and_read_again(spark, items, tmp_path):
    path = str(tmp_path / "out")
    out = list_columns(items.where(C.ne("buyer_id", "M4")), "item_id", "buyer_id")
    save_text(out, path, sep="|")
    again = delimited(spark, "again", path, ["item_id", "buyer_id"], sep="|", marker=True)
    assert rows(again) == rows(out)
    with pytest.raises(ValueError):
        save_text(list_columns(again), path)


def test_list_keeps_repeats_and_doesnt_shuffle(items):
    out = list_columns(items, "seller_id")
    assert [r[0] for r in rows(out)] == ["M1", "M1", "M2", "M3"]
    assert "Exchange" not in out.df._jdf.queryExecution().executedPlan().toString()


def test_aggregates_are_combined_before_the_join(items, members):
    out = inner_join(members, items).on(equal(members["id"], items["buyer_id"])).select(members["name"], Counts(items["item_id"]))
    assert "partial_count" in out.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "wrong",
    [
        lambda i, m: i["nothing"],
        lambda i, m: inner_join(m, i).on(equal(m["id"], i["buyer_id"])).select(m["name"]),
        lambda i, m: group(i).by("seller_id").select(i["item_id"], i["item_id"]),
        lambda i, m: group(i).by(),
        lambda i, m: equal(i["item_id"], i["seller_id"]),
        lambda i, m: inner_join(m),
        lambda i, m: sort(i).select("item_id").order_by("seller_id"),
        lambda i, m: i.where(C.eq("nothing", 1)),
        lambda i, m: i.compute(item_id=lambda c: c("item_id")),
        lambda i, m: inner_join(i, i).on(equal(i["item_id"], m["id"])),
    ],
)
def test_wrong_jobs_are_refused_at_once(items, members, wrong):
    with pytest.raises(ValueError):
        wrong(items, members)


def test_constraints_reach_the_scan(spark, tmp_path):
    import datetime as dt

    from loomframe import typed

    path = str(tmp_path / "p")
    spark.sql("select id, cast(id as double) d, cast(id as string) s, timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) t, id other from range(20)").write.parquet(path)
    d = typed(spark, "d", path).where(C.gt("d", 3)).where(C.ge("t", dt.date(2020, 1, 5)) & C.lt("t", dt.date(2020, 1, 12))).where(C.within("s", ["5", "7", "50"]) | C.eq("id", 9))
    out = list_columns(d, "id")
    assert sorted(r[0] for r in out.df.collect()) == [5, 7, 9]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = list_columns(d, "id").df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for part in ("GreaterThan(d,3.0)", "GreaterThanOrEqual(t", "LessThan(t", "Or(In(s"):
        assert part in pushed, pushed
    assert "other" not in plan[plan.index("ReadSchema") :].split("\n")[0]
