"""Predicates: a test on null is false, and NOT of it true."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Resolver:
    """Names to columns and their types, of one DataFrame."""

    def __init__(self, column: Callable[[str], Column], schema: T.StructType):
        self._column = column
        self._types = {f.name.lower(): f.dataType for f in schema.fields}

    def __call__(self, name: str) -> Column:
        return self._column(name)

    def type(self, name: str) -> str:
        found = self._types.get(name.lower())
        return found.typeName() if found is not None else ""


@dataclass(frozen=True)
class Predicate:
    """``build`` makes a Boolean column from a resolver, which may be null where the test is false: a filter drops those
    rows either way, and the bare comparison is what Spark can push into a scan. ``~`` closes the gap first."""

    names: tuple[str, ...]
    build: Callable[[Resolver], Column]

    def column(self, resolve: Resolver) -> Column:
        return self.build(resolve)

    def sure(self, resolve: Resolver) -> Column:
        """Never null."""
        return _sure(self.build(resolve))

    def check(self, dataset) -> None:
        for n in self.names:
            dataset[n]

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(self.names + other.names, lambda r: self.build(r) & other.build(r))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(self.names + other.names, lambda r: self.build(r) | other.build(r))

    def __invert__(self) -> Predicate:
        return Predicate(self.names, lambda r: ~self.sure(r))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


def _moments(c: Column, op: str, low: Column, high: Column) -> Column:
    """Compare with all moments from ``low`` up to but not including ``high``, by comparisons of the bare column."""
    return {"eq": (c >= low) & (c < high), "ne": (c < low) | (c >= high), "gt": c >= high, "ge": c >= low, "lt": c < low, "le": c < high}[op]


def _numbers(r: Resolver, name: str, *values: float) -> tuple[Column, ...]:
    """The column and literals to compare it with: as doubles, but whole numbers with a column of whole numbers as such,
    which is the same and needs no cast of the column."""
    if r.type(name) in ("byte", "short", "integer", "long") and all(float(v).is_integer() and abs(v) < 1 << 53 for v in values):
        return (r(name), *[F.lit(int(v)) for v in values])
    return (r(name).cast("double"), *[F.lit(float(v)) for v in values])


def _compare(name: str, value, op: str, fmt: str | None) -> Predicate:
    """Numbers compare as doubles, strings as strings of the column, Booleans as such, dates by day if the value is a day
    or stands at midnight and by the millisecond otherwise."""
    if isinstance(value, bool):
        return Predicate((name,), lambda r: _OPS[op](r(name).cast("boolean"), F.lit(value)))
    if isinstance(value, int | float):
        return Predicate((name,), lambda r: _OPS[op](*_numbers(r, name, value)))
    if isinstance(value, str):
        return Predicate((name,), lambda r: _OPS[op](r(name).cast("string"), F.lit(value)))
    if not isinstance(value, dt.date):
        raise TypeError(f"can't compare with {type(value).__name__}")
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    zoned = value.tzinfo is not None
    low = value.replace(microsecond=value.microsecond // 1000 * 1000)
    high = low + (dt.timedelta(days=1) if value.time() == dt.time() else dt.timedelta(milliseconds=1))

    def build(r: Resolver) -> Column:
        if zoned:  # a moment in time, whatever the session's zone; days are those of the moment's own zone
            c = F.to_timestamp(r(name).cast("string"), fmt) if fmt else r(name).cast("timestamp")
            return _moments(c, op, *(F.lit(x.isoformat(" ")).cast("timestamp") for x in (low, high)))
        kind = r.type(name) if not fmt and r.type(name) in ("date", "timestamp", "timestamp_ntz") else "timestamp"
        c = F.to_timestamp(r(name).cast("string"), fmt) if fmt else r(name).cast(kind)
        if kind == "date" and value.time() != dt.time():
            c, kind = c.cast("timestamp"), "timestamp"
        # as text, so that the moment is one of the session's time zone
        return _moments(c, op, *(F.lit(x.isoformat(" ")).cast("timestamp_ntz").cast(kind) for x in (low, high)))

    return Predicate((name,), build)


def eq(name: str, value, fmt: str | None = None) -> Predicate:
    return _compare(name, value, "eq", fmt)


def ne(name: str, value, fmt: str | None = None) -> Predicate:
    """Not equal; false on null, like all tests."""
    return _compare(name, value, "ne", fmt)


def gt(name: str, value, fmt: str | None = None) -> Predicate:
    return _compare(name, value, "gt", fmt)


def ge(name: str, value, fmt: str | None = None) -> Predicate:
    return _compare(name, value, "ge", fmt)


def lt(name: str, value, fmt: str | None = None) -> Predicate:
    return _compare(name, value, "lt", fmt)


def le(name: str, value, fmt: str | None = None) -> Predicate:
    return _compare(name, value, "le", fmt)


def _less(a: Column, b: Column) -> Column:
    """Null is equal to null and less than all else."""
    return (a.isNull() & b.isNotNull()) | _sure(a < b)


def eq_columns(a: str, b: str) -> Predicate:
    return Predicate((a, b), lambda r: r(a).eqNullSafe(r(b)))


def ne_columns(a: str, b: str) -> Predicate:
    return ~eq_columns(a, b)


def lt_columns(a: str, b: str) -> Predicate:
    return Predicate((a, b), lambda r: _less(r(a), r(b)))


def le_columns(a: str, b: str) -> Predicate:
    return ~lt_columns(b, a)


def gt_columns(a: str, b: str) -> Predicate:
    return lt_columns(b, a)


def ge_columns(a: str, b: str) -> Predicate:
    return ~lt_columns(a, b)


def within(name: str, values: Iterable) -> Predicate:
    """In a list of strings or of numbers; null, in the list or in the column, is in none."""
    values = [v for v in values if v is not None]
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
        return Predicate((name,), lambda r: (x := _numbers(r, name, *values))[0].isin(*x[1:]))
    return Predicate((name,), lambda r: r(name).cast("string").isin([str(v) for v in values]))


def not_within(name: str, values: Iterable) -> Predicate:
    return ~within(name, values)


#: Most lines of a file that a predicate may hold: they are part of every task. Longer lists are for a join.
MOST_LINES = 100_000


def within_file(name: str, path: str) -> Predicate:
    """In the lines of a local file of the driver's, whatever the case; null is in none. A file of more than MOST_LINES
    different lines is refused (ValueError): read it as a dataset and join."""
    lines: set[str] = set()
    with open(path, encoding="utf-8") as f:
        for line in f:
            lines.add(line.rstrip("\r\n").lower())
            if len(lines) > MOST_LINES:
                raise ValueError(f"{path} has more than {MOST_LINES} lines: join with it instead")
    lines = sorted(lines)
    return Predicate((name,), lambda r: F.lower(r(name).cast("string")).isin(lines))


def not_within_file(name: str, path: str) -> Predicate:
    """Not in the file; true on null."""
    return ~within_file(name, path)


def regex(name: str, pattern: str) -> Predicate:
    """The pattern is found anywhere in the value."""
    return Predicate((name,), lambda r: r(name).cast("string").rlike(pattern))


def not_null(name: str) -> Predicate:
    """Neither null nor, as text, blank."""
    return Predicate((name,), lambda r: r(name).isNotNull() & (F.trim(r(name).cast("string")) != ""))


def expression(build: Callable[..., Column], *names: str) -> Predicate:
    """Any Boolean expression over the named columns; null counts as false."""
    return Predicate(names, lambda r: build(*[r(n) for n in names]))
