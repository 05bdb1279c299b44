from pyspark.sql import functions as F

from loomframe import counted, from_dataframe, list_columns, run, settings
from loomframe.operators import criteria as C


def test_counters(spark):
    d = from_dataframe("d", spark.range(10).toDF("n")).where(C.ge("n", 4)).where(C.ne("n", 5))
    seen, counters = counted(d)
    assert sorted(r[0] for r in list_columns(seen, "n").df.collect()) == [4, 6, 7, 8, 9]
    assert counters.get == {"input": 10, "output": 5, "filtered": 5}


def test_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, "job", spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_run(spark):
    got = []

    def main(session, argv):
        got.append((session.conf.get("spark.sql.shuffle.partitions"), argv))
        if argv == ["fail"]:
            raise ValueError("no")

    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert run(main, ["-D", f"spark.sql.shuffle.partitions={before}", "x"], spark) == 0
    assert run(main, ["fail"], spark) == 1
    assert got == [(before, ["x"]), (before, ["fail"])]


def test_streams_take_row_operators(spark, tmp_path):
    source = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    d = from_dataframe("d", source).compute(even=lambda c: c("value") % 2 == 0).where(C.eq("even", True))
    query = list_columns(d, "value").df.writeStream.format("memory").queryName("evens").trigger(processingTime="1 second").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("evens").where(F.col("value") % 2 == 1).count() == 0
