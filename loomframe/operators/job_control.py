"""Counters of a dataset's rows, settings of one job, and a command-line frame for programs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import Dataset
from .criteria import Resolver


def counted(dataset: Dataset, name: str | None = None) -> tuple[Dataset, Observation]:
    """The dataset, and counters that are filled while a result of it is written: ``input``, ``output`` and ``filtered``
    rows before and after its constraints. They cost no pass of their own; ``observation.get`` waits for the result."""
    counters = Observation(name or dataset.name)
    rows = replace(dataset, constraints=()).df
    resolve = Resolver(dataset.column, rows.schema)
    kept = reduce(lambda a, b: a & b, [p.sure(resolve) for p in dataset.constraints], F.lit(True))
    flagged = rows.withColumn("_kept", kept)
    total = F.count(F.lit(1))
    passed = F.count(F.when(F.col("_kept"), 1))
    seen = flagged.observe(counters, total.alias("input"), passed.alias("output"), (total - passed).alias("filtered"))
    return Dataset(dataset.name, seen.where("_kept").drop("_kept")), counters


@contextmanager
def settings(spark: SparkSession, name: str | None = None, **conf) -> Iterator[None]:
    """Session settings (dots as ``__``) and a job description that hold inside the block, where results are written."""
    keys = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    if name:
        spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        if name:
            spark.sparkContext.setJobDescription(None)


def run(main: Callable[[SparkSession, list[str]], None], argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a program: ``-D key=value`` arguments become settings, the rest goes to ``main``; 0, or 1 if it raised."""
    argv = list(sys.argv[1:] if argv is None else argv)
    conf, rest = {}, []
    while argv:
        a = argv.pop(0)
        if a == "-D" and argv:
            key, _, value = argv.pop(0).partition("=")
            conf[key] = value
        else:
            rest.append(a)
    spark = spark or SparkSession.builder.config(map=conf).getOrCreate()
    for k, v in conf.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    try:
        main(spark, rest)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
