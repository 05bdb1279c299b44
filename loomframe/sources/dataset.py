"""Named tables: a lazy DataFrame with lower-case columns, its constraints and its computed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.criteria import Resolver

Expression = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class ColumnRef:
    """A column of a dataset, or an element ``column.key`` of one of its maps, and the name it gets in results."""

    dataset: Dataset
    name: str
    alias: str | None = None

    def rename(self, name: str) -> ColumnRef:
        return replace(self, alias=name.lower())

    @property
    def output(self) -> str:
        return self.alias or self.name.replace(".", "_")

    @property
    def is_row_function(self) -> bool:
        return True

    def __hash__(self) -> int:
        return hash((self.dataset.name, self.name, self.alias))

    def __eq__(self, other) -> bool:
        return isinstance(other, ColumnRef) and (self.dataset.name, self.name, self.alias) == (other.dataset.name, other.name, other.alias)


@dataclass(frozen=True, eq=False)
class Dataset:
    """``name`` tells datasets of one job apart, so a self-join needs two names. Nothing is read until a result is.

    ``where`` adds constraints, which are ANDed; ``compute`` adds one value a row; ``expand`` adds none to many rows a
    row, crossed with it, and one row of nulls where there are none. Computed columns see the source row alone, not
    each other; constraints see all of them.
    """

    name: str
    source: DataFrame
    computed: tuple = ()
    constraints: tuple = ()
    declared: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.source.columns, *[n for names, _ in self.computed for n in names]]

    def __getitem__(self, name: str) -> ColumnRef:
        name = name.lower()
        head, dot, key = name.partition(".")
        if head not in self.columns or dot and not key or not head:
            raise ValueError(f"{self.name} has no column {name}; it has {', '.join(self.columns)}")
        return ColumnRef(self, name)

    def cols(self, *names: str) -> list[ColumnRef]:
        return [self[n] for n in names or self.columns]

    def _free(self, names) -> tuple[str, ...]:
        names = tuple(n.lower() for n in names)
        clash = [n for i, n in enumerate(names) if n in self.columns or n in names[:i]]
        if clash:
            raise ValueError(f"{self.name} has {', '.join(clash)} already")
        return names

    def compute(self, **expressions: Column | Expression) -> Dataset:
        """One new column for each keyword: a Column over source columns, or a function from a resolver to one."""
        self._free(expressions)
        return replace(self, computed=(*self.computed, *(((n.lower(),), ("value", e)) for n, e in expressions.items())))

    def expand(self, names: list[str], rows: Column | Expression) -> Dataset:
        """New columns from an array of structs, or of values for one name: a row for each element."""
        return replace(self, computed=(*self.computed, (self._free(names), ("rows", rows))))

    def where(self, predicate) -> Dataset:
        predicate.check(self)
        return replace(self, constraints=(*self.constraints, predicate))

    def order_by(self, *sorts) -> Dataset:
        """The rows in one total order, by ``Sort`` keys or names (ascending, null first); lists of it keep the order."""
        if not sorts:
            raise ValueError("no sort key")
        keys = []
        for s in sorts:
            ref = self[s if isinstance(s, str) else s.column]
            keys.append(self.column(ref.name).asc_nulls_first() if isinstance(s, str) else s.order(self.column(ref.name)))
        return replace(self, source=self.df.orderBy(*keys), computed=(), constraints=())

    def column(self, name: str) -> Column:
        """The Spark column for a name, ``map.key`` included; map keys are lower case."""
        head, _, key = name.lower().partition(".")
        return F.element_at(F.col(f"`{head}`"), key) if key else F.col(f"`{head}`")

    @property
    def df(self) -> DataFrame:
        """The rows, computed columns added and constraints applied."""
        out, base = self.source, self.source.columns
        made: list[str] = []
        for i, (names, (kind, e)) in enumerate(self.computed):
            value = e if isinstance(e, Column) else e(self.column)
            keep = [F.col(f"`{c}`") for c in [*base, *made]]
            if kind == "value":
                out = out.select(*keep, value.alias(names[0]))
            else:
                out = out.select(*keep, F.explode_outer(value).alias(f"_rows{i}"))
                one = out.schema[f"_rows{i}"].dataType
                parts = [F.col(f"_rows{i}").getField(f.name).alias(n) for n, f in zip(names, one.fields, strict=True)] if isinstance(one, T.StructType) else [F.col(f"_rows{i}").alias(names[0])]
                out = out.select(*keep, *parts)
            made += names
        if self.constraints:
            resolve = Resolver(self.column, out.schema)
            for p in self.constraints:
                out = out.where(p.column(resolve))
        return out


def from_dataframe(name: str, df: DataFrame) -> Dataset:
    """A dataset over any DataFrame; its column names become lower case, and map columns get lower-case keys."""
    seen: set[str] = set()
    columns = []
    for f in df.schema.fields:
        low = f.name.lower()
        if low in seen:
            raise ValueError(f"column {low} stands twice")
        seen.add(low)
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType):
            c = F.transform_keys(c, lambda k, _: F.lower(k))
        columns.append(c.alias(low))
    return Dataset(name, df.select(*columns))
