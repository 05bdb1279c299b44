"""Readers: delimited text, typed files, Hadoop sequence files, and formats that users add."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset, from_dataframe

MALFORMED = "_malformed"


def _paths(spark: SparkSession, paths: str | list[str], marker: bool) -> list[str]:
    """The paths, each checked to exist, globs included; with ``marker``, each folder must hold _SUCCESS."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input path")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path)
        if not found:
            raise FileNotFoundError(p)
        for status in found if marker else ():
            if status.isDirectory() and not fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                raise FileNotFoundError(f"{status.getPath()} has no _SUCCESS")
    return paths


def delimited(spark: SparkSession, name: str, paths: str | list[str], columns: list[str], sep: str = "\t", extra: int = 0, parser: Callable[[DataFrame], DataFrame] | None = None, marker: bool = False, counters: Observation | None = None) -> Dataset:
    """Lines split at a literal separator, every cell a string: no quoting, no escapes, no header.

    A cell that is there but empty is ``''``; cells missing at the end of a line are null; an empty line is all null.
    ``extra`` keeps so many cells beyond the columns as ``idx_<i>``. Several paths are read as one. ``parser`` replaces
    the splitting: it gets a DataFrame with the column ``value`` and returns the columns; rows that it marks true in a
    column ``_malformed`` are dropped. ``counters`` gets ``read`` and ``malformed``, the numbers of lines and of those
    dropped, while a result is written.
    """
    names = [c.lower() for c in columns]
    if len(set(names)) < len(names):
        raise ValueError("a column stands twice")
    lines = spark.read.text(_paths(spark, paths, marker))
    if parser is not None:
        parsed = parser(lines)
        if counters is not None:
            bad = F.coalesce(F.col(MALFORMED), F.lit(False)) if MALFORMED in parsed.columns else F.lit(False)
            parsed = parsed.observe(counters, F.count(F.lit(1)).alias("read"), F.count(F.when(bad, 1)).alias("malformed"))
        if MALFORMED in parsed.columns:
            parsed = parsed.where(~F.coalesce(F.col(MALFORMED), F.lit(False))).drop(MALFORMED)
        lost = set(names) - {c.lower() for c in parsed.columns}
        if lost:
            raise ValueError(f"the parser gives no {', '.join(sorted(lost))}")
        return from_dataframe(name, parsed)
    if counters is not None:
        lines = lines.observe(counters, F.count(F.lit(1)).alias("read"), F.lit(0).alias("malformed"))
    cells = lines.select(F.when(F.col("value") != "", F.split("value", re.escape(sep).replace("\\\t", "\\t"), -1)).alias("cells"))
    names += [f"idx_{i}" for i in range(len(names), len(names) + extra)]
    return Dataset(name, cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))


def typed(spark: SparkSession, name: str, paths: str | list[str], columns: list[str] | None = None, fmt: str = "parquet", marker: bool = False, **options) -> Dataset:
    """Typed rows of any format that Spark reads, Parquet at first; only ``columns`` if they are given."""
    df = spark.read.options(**options).format(fmt).load(_paths(spark, paths, marker))
    return from_dataframe(name, df.select(*columns) if columns else df)


def sequence_file(spark: SparkSession, name: str, path: str, parse: Callable[[object, object], tuple | None], schema: str) -> Dataset:
    """A Hadoop sequence file; ``parse`` makes a row of each key and value, or None for a malformed record, which is dropped."""
    (path,) = _paths(spark, path, False)
    rows = spark.sparkContext.sequenceFile(path).map(lambda kv: parse(kv[0], kv[1])).filter(lambda r: r is not None)
    return from_dataframe(name, spark.createDataFrame(rows, schema))


#: Format -> reader(spark, name, paths, **options); ``register`` adds to it.
READERS: dict[str, Callable[..., Dataset]] = {"text": delimited, "parquet": typed, "sequence": sequence_file}


def register(fmt: str, reader: Callable[..., Dataset]) -> None:
    READERS[fmt.lower()] = reader


def read(spark: SparkSession, fmt: str, name: str, paths: str | list[str], **options) -> Dataset:
    try:
        reader = READERS[fmt.lower()]
    except KeyError:
        raise ValueError(f"no reader for {fmt}; there are {', '.join(sorted(READERS))}") from None
    return reader(spark, name, paths, **options)
