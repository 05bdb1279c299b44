"""The fluent interface: list, group, join and sort datasets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.group_functions import Sort
from ..plans.grouping import compile_query
from ..sources.dataset import ColumnRef, Dataset


def _names(columns) -> list[str]:
    return [c.name if isinstance(c, ColumnRef) else c.lower() for c in columns]


def named(result: Dataset, name: str) -> Dataset:
    """The result as a dataset of the next job."""
    return replace(result, name=name)


def list_columns(dataset: Dataset, *columns: str | ColumnRef) -> Dataset:
    """The chosen columns of the rows that meet the constraints, under their own names: no shuffle, repeats stay."""
    names = _names(columns) or dataset.columns
    for n in names:
        dataset[n]
    if len(set(names)) < len(names):
        raise ValueError("a column stands twice")
    return Dataset("result", dataset.df.select(*[dataset.column(n).alias(n.replace(".", "_")) for n in names]))


@dataclass(frozen=True)
class Grouping:
    datasets: list[Dataset]
    keys: list[list[ColumnRef]]
    how: str = "inner"
    replacement: object = None

    def select(self, *projections, having=None, partitions: int | None = None) -> Dataset:
        """The result; ``having`` filters its rows, ``partitions`` sets in how many parts it comes."""
        out = compile_query(self.datasets, self.keys, list(projections), self.how, self.replacement, having)
        return replace(out, source=out.source.repartition(partitions)) if partitions else out


@dataclass(frozen=True)
class GroupBy:
    dataset: Dataset

    def by(self, *columns: str | ColumnRef) -> Grouping:
        if not columns:
            raise ValueError("no key")
        return Grouping([self.dataset], [[self.dataset[n] for n in _names(columns)]])


def group(dataset: Dataset) -> GroupBy:
    """``group(d).by("k").select(...)``; null keys are a group."""
    return GroupBy(dataset)


@dataclass(frozen=True)
class EQ:
    """Columns of different datasets that are equal."""

    columns: tuple[ColumnRef, ...]

    def __post_init__(self):
        if len(self.columns) < 2 or len({c.dataset.name for c in self.columns}) < len(self.columns):
            raise ValueError("EQ takes two or more columns, each of another dataset")


def equal(*columns: ColumnRef) -> EQ:
    return EQ(columns)


@dataclass(frozen=True)
class Join:
    datasets: tuple[Dataset, ...]
    how: str
    replacement: object = None

    def on(self, *conditions: EQ) -> Grouping:
        """All conditions hold; each names every dataset. Null keys match null keys."""
        if not conditions:
            raise ValueError("no condition")
        names = {d.name for d in self.datasets}
        for c in conditions:
            if {x.dataset.name for x in c.columns} != names:
                raise ValueError("each condition names every dataset of the join")
        of = lambda d: [next(x for x in c.columns if x.dataset.name == d.name) for c in conditions]
        return Grouping(list(self.datasets), [of(d) for d in self.datasets], self.how, self.replacement)


def inner_join(*datasets: Dataset) -> Join:
    if len(datasets) < 2:
        raise ValueError("a join takes two or more datasets")
    return Join(datasets, "inner")


def left_outer_join(left: Dataset, right: Dataset, replacement=None) -> Join:
    """Every group of ``left``; what comes of ``right`` is ``replacement`` where it has no such group."""
    return Join((left, right), "left", replacement)


def right_outer_join(left: Dataset, right: Dataset, replacement=None) -> Join:
    return Join((right, left), "left", replacement)


@dataclass(frozen=True)
class Sorting:
    dataset: Dataset
    columns: tuple[str, ...] = ()

    def select(self, *columns: str | ColumnRef) -> Sorting:
        return replace(self, columns=tuple(_names(columns)))

    def order_by(self, *sorts: Sort | str) -> Dataset:
        """All rows in one order, over partitions that are ranges of it. Only selected columns can be sorted by."""
        listed = list_columns(self.dataset, *self.columns)
        sorts = [s if isinstance(s, Sort) else Sort(s) for s in sorts]
        lost = [s.column for s in sorts if s.column.lower() not in listed.columns]
        if lost or not sorts:
            raise ValueError(f"can't sort by {', '.join(lost) or 'nothing'}")
        return Dataset("result", listed.df.orderBy(*[s.order(listed.column(s.column)) for s in sorts]))


def sort(dataset: Dataset) -> Sorting:
    """``sort(d).select(...).order_by(Sort("c", numeric=True), ...)``; without select, all columns."""
    return Sorting(dataset)
