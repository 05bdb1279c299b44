"""Functions of rows and of groups, each with its Spark form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.dataset import ColumnRef


class Function:
    """Something that a result can hold besides plain columns. ``inputs`` may be of several datasets.

    ``combinable``: can be worked out from parts, so Spark aggregates before the shuffle.
    """

    combinable = True
    label = ""

    def __init__(self, *inputs: ColumnRef):
        if not inputs:
            raise ValueError("a function needs an input column")
        self.inputs = inputs
        self._names: list[str] | None = None

    def rename(self, *names: str):
        self._names = [n.lower() for n in names]
        return self

    @property
    def default_names(self) -> list[str]:
        return [f"{self.label or type(self).__name__.lower()}_{self.inputs[0].output}"]

    @property
    def outputs(self) -> list[str]:
        names = self._names or self.default_names
        if len(names) != len(self.default_names):
            raise ValueError(f"{type(self).__name__} has {len(self.default_names)} outputs")
        return names


class Aggregate(Function):
    """One value for each group: ``build`` makes it from the input columns; users pass their own.

    ``windowable``: the expression is one aggregate call, so it can stand beside the group's rows without a join.
    ``framed``: ``frame`` makes (keys, ``_value``) of each group from the source, without gathering a group in memory;
    ``build`` is used over joined rows only.
    """

    windowable = False
    framed = False

    def __init__(self, *inputs: ColumnRef, build: Callable[..., Column] | None = None):
        super().__init__(*inputs)
        if build is not None:
            self.build = build

    def build(self, *columns: Column) -> Column:
        raise NotImplementedError


class Extend(Function):
    """A function of one row: ``build(*columns)`` makes a column, or with ``names`` a list of so many columns."""

    def __init__(self, *inputs: ColumnRef, build: Callable[..., Column], names: list[str] | None = None):
        super().__init__(*inputs)
        self.build = build
        self._names = [n.lower() for n in names] if names else None
        self._count = len(names) if names else 1

    @property
    def default_names(self) -> list[str]:
        return [f"extend_{self.inputs[0].output}"] * self._count


class Rows(Function):
    """Any number of rows for each group, crossed with the group's other rows; a group without rows goes.

    ``frame(df, keys, columns, outputs)`` makes the rows, keys included; ``of_pandas`` wraps a function of one group.
    """

    combinable = False

    def frame(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        raise NotImplementedError


def _kind(c: ColumnRef) -> T.DataType:
    return c.dataset.df.select(c.dataset.column(c.name)).schema[0].dataType


def _tie(c: Column, kind: T.DataType, down: bool) -> Column:
    """What values of one key are told apart by: it sorts as they do, or with ``down`` the other way round; null fields
    are least, and types without a case of their own (arrays and maps among them) go by their text."""
    if isinstance(kind, T.StructType):
        fields = [(c.getField(f.name), f.dataType) for f in kind.fields]
        return F.struct(F.lit(0).alias("_"), *[x for i, (v, t) in enumerate(fields) for x in ((v.isNull() if down else v.isNotNull()).alias(f"_n{i}"), _tie(v, t, down).alias(f"_v{i}"))])
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c) if down else c
    if isinstance(kind, T.FractionalType):
        return F.struct(~F.isnan(c.cast("double")), -c) if down else c
    if isinstance(kind, T.BooleanType):
        return ~c if down else c
    if kind.typeName() in ("date", "timestamp"):
        moment = F.unix_date(c) if kind.typeName() == "date" else F.unix_micros(c)
        return F.bitwise_not(moment) if down else moment
    text = c if isinstance(kind, T.BinaryType) else c.cast("string")
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")) if down else text


class Counts(Aggregate):
    """Values that aren't null; the empty string counts."""

    windowable = True

    def build(self, c: Column) -> Column:
        return F.count(c)


class Max(Aggregate):
    """Greatest value, nulls left out; strings as strings. With ``key``, the value whose key is greatest, of several such
    the least, so it is the same in every run."""

    def __init__(self, c: ColumnRef, key: Callable[[Column], Column] | None = None):
        super().__init__(c)
        self.key, self.windowable = key, key is None

    def build(self, c: Column) -> Column:
        if self.key is None:
            return F.max(c)
        key = self.key(c)
        return F.max_by(c, F.when(c.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), _tie(c, _kind(self.inputs[0]), True).alias("v"))))


class Min(Aggregate):
    """Least value, nulls left out; strings as strings. With ``key``, the value whose key is least, of several such the
    least, so it is the same in every run."""

    def __init__(self, c: ColumnRef, key: Callable[[Column], Column] | None = None):
        super().__init__(c)
        self.key, self.windowable = key, key is None

    def build(self, c: Column) -> Column:
        if self.key is None:
            return F.min(c)
        key = self.key(c)
        return F.min_by(c, F.when(c.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), _tie(c, _kind(self.inputs[0]), False).alias("v"))))


class Sum(Aggregate):
    """Sum as double; strings are parsed, nulls left out, nothing gives 0."""

    def build(self, c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


class Avg(Aggregate):
    """Mean of what isn't null; with ``scale``, rounded half up to so many digits. ``Avg.of_time`` averages times; of
    dates it is a date."""

    combinable = False

    def __init__(self, c: ColumnRef, scale: int | None = None, time: bool = False):
        super().__init__(c)
        self.scale, self.time = scale, time

    @classmethod
    def of_time(cls, c: ColumnRef) -> Avg:
        return cls(c, time=True)

    def build(self, c: Column) -> Column:
        if self.time:
            moment = F.timestamp_millis(F.avg(F.unix_millis(c.cast("timestamp"))).cast("bigint"))
            return moment.cast("date") if isinstance(_kind(self.inputs[0]), T.DateType) else moment
        if self.scale is None:
            return F.avg(c.cast("double"))
        return F.round(F.avg(c.cast("decimal(38,18)")), self.scale)


class Median(Aggregate):
    """The element in the upper middle of the sorted group, nulls included and first; ``key`` sorts otherwise."""

    combinable = False
    framed = True
    label = "medium"

    def __init__(self, c: ColumnRef, key: Callable[[Column], Column] | None = None):
        super().__init__(c)
        self.key = key

    def frame(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        value = F.col(columns[0])
        order = [value.asc_nulls_first()] if self.key is None else [self.key(value).asc_nulls_first(), value.asc_nulls_first()]
        own = Window.partitionBy(*keys)
        placed = df.select(*keys, value.alias("_value"), F.row_number().over(own.orderBy(*order)).alias("_at"), F.count(F.lit(1)).over(own).alias("_n"))
        return placed.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).drop("_at", "_n")

    def build(self, c: Column) -> Column:
        order = F.struct(c.alias("v")) if self.key is None else F.struct(self.key(c).alias("k"), c.alias("v"))
        return F.get(F.sort_array(F.collect_list(order)), (F.count(F.lit(1)) / 2).cast("int"))["v"]


class Concat(Aggregate):
    """All values that aren't null as one string, sorted so that the result is the same in every run; ``joined=False``
    leaves the array."""

    label = "concate"

    def __init__(self, c: ColumnRef, sep: str = ";", joined: bool = True):
        super().__init__(c)
        self.sep, self.joined = sep, joined

    def build(self, c: Column) -> Column:
        values = F.sort_array(F.collect_list(c.cast("string") if self.joined else c))
        return F.array_join(values, self.sep) if self.joined else values


class UniqueCounts(Aggregate):
    """Number of distinct combinations of the columns, null being a value."""

    combinable = False

    def build(self, *c: Column) -> Column:
        return F.count_distinct(F.struct(*c))


@dataclass(frozen=True)
class Sort:
    """A sort key. ``numeric`` compares as numbers. Null comes first going up and last going down."""

    column: str
    ascending: bool = True
    numeric: bool = False

    def order(self, c: Column) -> Column:
        c = c.cast("double") if self.numeric else c
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()


class Top(Rows):
    """The first ``n`` rows of each group in an order, by default that of the columns in turn."""

    def __init__(self, columns: list[ColumnRef], n: int, order: list[Sort] | None = None):
        super().__init__(*columns)
        if n < 1:
            raise ValueError("n must be 1 at least")
        self.n, self.sorts = n, order
        lost = [s.column for s in order or [] if s.column.lower() not in [c.name for c in columns]]
        if lost:
            raise ValueError(f"sorted by columns that aren't chosen: {', '.join(lost)}")

    @property
    def default_names(self) -> list[str]:
        return [f"top_{c.output}" for c in self.inputs]

    def frame(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        at = {c.name: n for c, n in zip(self.inputs, columns, strict=True)}
        order = [s.order(F.col(at[s.column.lower()])) for s in self.sorts] if self.sorts else [F.col(n).asc_nulls_first() for n in columns]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.select(*keys, *columns, rank.alias("_rank")).where(F.col("_rank") <= self.n).drop("_rank").toDF(*keys, *self.outputs)


class Unique(Rows):
    """Distinct combinations of the columns in each group."""

    @property
    def default_names(self) -> list[str]:
        return [f"unique_{c.output}" for c in self.inputs]

    def frame(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        return df.select(*keys, *columns).distinct().toDF(*keys, *self.outputs)


class GroupRows(Rows):
    """A user's function of one group, pandas frame in, pandas frame out, for what no expression can say.

    ``schema`` names and types the output columns. The group is gathered in one task, so it has to fit there.
    """

    def __init__(self, *inputs: ColumnRef, function, schema: str):
        super().__init__(*inputs)
        self.function, self.types = function, T._parse_datatype_string(schema)

    @property
    def default_names(self) -> list[str]:
        return [f.name.lower() for f in self.types.fields]

    def frame(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        import pandas as pd

        function, outs, names = self.function, self.outputs, [c.name for c in self.inputs]
        own = df.select(*keys, *columns)
        schema = T.StructType([*[own.schema[k] for k in keys], *[T.StructField(n, f.dataType) for n, f in zip(outs, self.types.fields, strict=True)]])

        def run(key, group: pd.DataFrame) -> pd.DataFrame:
            out = function(group[columns].set_axis(names, axis=1))
            out.columns = outs
            for i, k in enumerate(keys):
                out.insert(i, k, [key[i]] * len(out))
            return out

        return own.groupBy(*keys).applyInPandas(run, schema)
