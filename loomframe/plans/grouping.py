"""Plans for groups and joins on keys.

Each dataset of a group contributes, by itself, one list of rows (its columns and row functions), one value for each
aggregate, and one list of rows for each function that gives many; the result is the product of these. So aggregates of
one dataset aren't inflated by the rows that another one matches. In Spark: every dataset is brought to its own part,
aggregated before it is joined, and the parts are joined on the keys, null with null.

A key is its value, with a stand-in for null, from the start, and a bit of a column that says which of the keys are null. So
parts are grouped and joined by plain equality of the same columns, and what one aggregation has shuffled needs no other
shuffle to be joined. Key columns beside aggregates are read from the groups' own keys, those of the first dataset after the
join, so that rows which tasks hold to group, sort and join them have the keys once and one column for all nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.group_functions import Aggregate, Extend, Function, Rows
from ..sources.dataset import ColumnRef, Dataset

_BITS = 31  # keys whose nulls one column tells
_NUMBERS = ("byte", "short", "integer", "long", "float", "double")


def common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that keys of several datasets are compared in: the same, the wider number, or a number against text as
    a double; dates and timestamps as timestamps."""
    names = [k.typeName() for k in kinds]
    if len(set(map(repr, kinds))) == 1:
        return kinds[0]
    if any(n.startswith("decimal") for n in names) and all(n in _NUMBERS or n.startswith("decimal") or n == "string" for n in names):
        return T.DoubleType()
    if all(n in _NUMBERS for n in names):
        return kinds[max(range(len(names)), key=lambda i: _NUMBERS.index(names[i]))] if not ("long" in names and "float" in names) else T.DoubleType()
    if all(n in _NUMBERS or n == "string" for n in names):
        return T.DoubleType()
    if all(n in ("date", "timestamp", "timestamp_ntz") for n in names):
        return T.TimestampType()
    raise TypeError(f"keys of types {', '.join(names)} can't be compared")


@dataclass
class Part:
    """What one dataset contributes."""

    dataset: Dataset
    keys: list[ColumnRef]
    columns: list[ColumnRef] = field(default_factory=list)
    extends: list[Extend] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    rows: list[Rows] = field(default_factory=list)
    hidden: list[ColumnRef] = field(default_factory=list)

    def is_key(self, c: ColumnRef) -> bool:
        return any(c.name == k.name for k in self.keys)

    @property
    def used(self) -> list[ColumnRef]:
        """Columns that must be there row by row."""
        return [*self.columns, *self.hidden, *[c for e in self.extends for c in e.inputs]]


def _raw(c: ColumnRef) -> str:
    return f"_c_{c.dataset.name}_{c.name}".replace(".", "_")


def _stand_in(kind: T.DataType) -> Column | None:
    """A value of the type that null keys have; none for types whose keys are compared null-safe instead."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("").cast(kind)
    if kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("1970-01-01").cast(kind)
    return None


def _key_names(kinds: list[T.DataType]) -> list[str]:
    flagged = [_stand_in(t) is not None for t in kinds]
    return [*[f"_k{i}" if f else f"_x{i}" for i, f in enumerate(flagged)], *[f"_n{i}" for i in sorted({i // _BITS for i, f in enumerate(flagged) if f})]]


def _key_columns(keys: list[Column], kinds: list[T.DataType]) -> list[Column]:
    out, nulls = {}, {}
    for i, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
        key, value = key.cast(kind), _stand_in(kind)
        out[f"_k{i}" if value is not None else f"_x{i}"] = key if value is None else F.coalesce(key, value)
        if value is not None:
            nulls.setdefault(f"_n{i // _BITS}", []).append(F.when(key.isNull(), F.lit(1 << i % _BITS)).otherwise(F.lit(0)))
    return [c.alias(n) for n, c in [*out.items(), *((n, reduce(lambda a, b: a.bitwiseOR(b), bits)) for n, bits in nulls.items())]]


def _key_value(i: int, kind: T.DataType) -> Column:
    return F.col(f"_x{i}") if _stand_in(kind) is None else F.when(F.col(f"_n{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS)) == 0, F.col(f"_k{i}"))


def _extend_columns(e: Extend, columns: list[Column]) -> list[Column]:
    value = e.build(*columns)
    return [c.alias(n) for c, n in zip(value if isinstance(value, list | tuple) else [value], e.outputs, strict=True)]


def _source(part: Part, kinds: list[T.DataType], needed: list[ColumnRef]) -> DataFrame:
    """Keys and the columns that anything needs, under names that no other dataset has."""
    d = part.dataset
    keys = _key_columns([d.column(k.name) for k in part.keys], kinds)
    seen = {_raw(c): d.column(c.name).alias(_raw(c)) for c in needed}
    return d.df.select(*keys, *seen.values())


def _from_keys(part: Part, kinds: list[T.DataType]) -> dict[str, Column]:
    """The key columns that grouping doesn't cast, from the groups' keys."""
    d = part.dataset
    own = d.df.select(*[d.column(k.name).alias(f"_{i}") for i, k in enumerate(part.keys)]).schema
    return {_raw(k): _key_value(i, t) for i, (k, t) in enumerate(zip(part.keys, kinds, strict=True)) if own[i].dataType == t}


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the keys, null equal to null; the left side's keys stay, or the right side's in a right join."""
    other = [f"{k}_r" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, other, strict=True)))
    on = [left[a].eqNullSafe(right[b]) if a.startswith("_x") else left[a] == right[b] for a, b in zip(keys, other, strict=True)]
    return left.join(right, on, how).drop(*other)


def _row_columns(part: Part, value) -> list[Column]:
    """The part's columns and row functions; ``value`` gives the column of an input."""
    rows = [value(c).alias(f"_o_{_raw(c)}") for c in {_raw(c): c for c in [*part.columns, *part.hidden]}.values()]
    for i, e in enumerate(part.extends):
        rows += [c.alias(f"_e{i}_{j}_{part.dataset.name}") for j, c in enumerate(_extend_columns(e, [value(x) for x in e.inputs]))]
    return rows


def _of_keys(part: Part, plain: dict[str, Column]) -> bool:
    return all(_raw(c) in plain for c in part.used)


def _build(part: Part, src: DataFrame, keys: list[str], keep_rows: bool, plain: dict[str, Column], later: bool) -> DataFrame:
    """The dataset's part: its rows, aggregates and many-row functions, joined on the keys.

    Aggregates beside rows are window aggregates over one shuffle of the source where they can be; by themselves they
    are combined before the shuffle. ``plain`` has the columns that can be read from the keys; with ``later``, what is read
    from the keys alone is left to the caller.
    """
    outs = lambda f: [F.col(_raw(c)) for c in f.inputs]
    detail = any(not part.is_key(c) for c in part.used)
    of_keys = not keep_rows and _of_keys(part, plain)
    aggregates = [(a, f"_a{i}_{part.dataset.name}") for i, a in enumerate(part.aggregates)]
    out = None
    if part.used and not of_keys:
        windowed = [(a, n) for a, n in aggregates if detail and a.windowable]
        aggregates = [x for x in aggregates if x not in windowed]
        over = Window.partitionBy(*keys)
        base = src.select(*keys, *_row_columns(part, lambda c: F.col(_raw(c))), *[a.build(*outs(a)).over(over).alias(n) for a, n in windowed])
        out = base if detail or keep_rows else base.distinct()
    framed = [x for x in aggregates if x[0].framed]
    aggregates = [x for x in aggregates if not x[0].framed]
    if aggregates:
        grouped = src.groupBy(*keys).agg(*[a.build(*outs(a)).alias(n) for a, n in aggregates])
        out = grouped if out is None else _join(out, grouped, keys)
    frames = [a.frame(src, keys, [_raw(c) for c in a.inputs]).withColumnRenamed("_value", n) for a, n in framed]
    for i, r in enumerate(part.rows):
        frame = r.frame(src, keys, [_raw(c) for c in r.inputs])
        frames.append(frame.withColumnsRenamed({n: f"_r{i}_{j}_{part.dataset.name}" for j, n in enumerate(r.outputs)}))
    for frame in frames:
        out = frame if out is None else _join(out, frame, keys)
    if part.used and of_keys:
        out = src.select(*keys).distinct() if out is None else out
        return out if later else out.select("*", *_row_columns(part, lambda c: plain[_raw(c)]))
    return out


def compile_query(datasets: list[Dataset], keys: list[list[ColumnRef]], projections: list, how: str = "inner", replacement=None, having=None) -> Dataset:
    """The result of a group (one dataset) or a join (several) as a lazy dataset.

    ``keys[i]`` are the key columns of ``datasets[i]``. In a left or right outer join, everything that comes from the
    other side is ``replacement`` in rows without a match, as text if it is given, else null; nulls of matched rows stay.
    """
    names = [d.name for d in datasets]
    if len(set(names)) < len(names):
        raise ValueError("datasets of one job need different names")
    if not projections:
        raise ValueError("nothing is selected")
    outputs = [n for p in projections for n in ([p.output] if isinstance(p, ColumnRef) else p.outputs)]
    twice = sorted({n for n in outputs if outputs.count(n) > 1})
    if twice:
        raise ValueError(f"{', '.join(twice)} would stand twice in the result")
    parts = {d.name: Part(d, k) for d, k in zip(datasets, keys, strict=True)}
    shared: list[Function] = []
    touched: set[str] = set()
    for p in projections:
        own = {c.dataset.name for c in ([p] if isinstance(p, ColumnRef) else p.inputs)}
        if own - set(names):
            raise ValueError(f"{', '.join(sorted(own - set(names)))} isn't part of the job")
        touched |= own
        if len(own) > 1:
            shared.append(p)
            continue
        part = parts[own.pop()]
        (part.columns if isinstance(p, ColumnRef) else part.extends if isinstance(p, Extend) else part.aggregates if isinstance(p, Aggregate) else part.rows).append(p)
    if set(names) - touched:
        raise ValueError(f"nothing is selected from {', '.join(n for n in names if n not in touched)}")
    if any(isinstance(f, Rows) for f in shared):
        raise ValueError("functions that give many rows take columns of one dataset")
    for f in shared:
        if isinstance(f, Extend):
            for c in f.inputs:
                parts[c.dataset.name].hidden.append(c)
    kinds = [common_type([d.df.select(d.column(k[i].name)).schema[0].dataType for d, k in zip(datasets, keys, strict=True)]) for i in range(len(keys[0]))]
    key_names = _key_names(kinds)
    plain = {d.name: _from_keys(parts[d.name], kinds) for d in datasets}
    combinable = all(not isinstance(p, Function) or p.combinable for p in projections)
    taken = [f for f in shared if isinstance(f, Aggregate)]
    # where nothing but keys stands beside functions of the joined rows, their groups are the result
    alone = how == "inner" and taken and combinable and all(not p.aggregates and not p.rows and all(_raw(c) in plain[n] for c in p.used) for n, p in parts.items())
    built, sources, later = [], {}, False
    for i, d in enumerate(datasets):
        part = parts[d.name]
        needed = [*part.used, *[c for f in [*part.aggregates, *part.rows, *shared] for c in f.inputs if c.dataset.name == d.name]]
        sources[d.name] = _source(part, kinds, needed)
        if alone:
            continue
        # rows of keys alone are one for each group, but for the last dataset of a job that can't be combined map-side
        last = i == len(datasets) - 1 and not part.aggregates and not part.rows and not combinable
        if i == 0:  # its keys are those that stay in joins
            later = bool(part.used) and not last and _of_keys(part, plain[d.name])
        frame = _build(part, sources[d.name], key_names, last, plain[d.name], i == 0)
        if frame is None:  # its columns are inputs of shared aggregates alone: it decides which groups there are
            frame = sources[d.name].select(*key_names).distinct()
        built.append(frame)
    outer = how != "inner"
    if alone:
        whole = None
    elif outer:
        built[1] = built[1].withColumn("_match", F.lit(1))
        whole = _join(built[0], built[1], key_names, "left")
    else:
        whole = reduce(lambda a, b: _join(a, b, key_names), built)
    if later:
        whole = whole.select("*", *_row_columns(parts[names[0]], lambda c: plain[names[0]][_raw(c)]))
    if taken:
        # row by row over the joined rows, then one aggregation
        rows = reduce(lambda a, b: _join(a, b, key_names), [sources[n] for n in names])
        grouped = rows.groupBy(*key_names).agg(*[a.build(*[F.col(_raw(c)) for c in a.inputs]).alias(f"_s{i}") for i, a in enumerate(taken)])
        if alone:
            whole = grouped.select("*", *[c for n in names for c in _row_columns(parts[n], lambda x: plain[x.dataset.name][_raw(x)])])
        else:
            whole = _join(whole, grouped, key_names, "left" if outer else "inner")
    final: list[Column] = []
    right = names[1] if outer else None
    place = {n: {"e": 0, "a": 0, "r": 0} for n in names}
    n_shared = 0

    def put(c: Column, name: str, from_right: bool) -> None:
        if outer and from_right and replacement is not None:
            c = F.when(F.col("_match").isNull(), F.lit(str(replacement))).otherwise(c.cast("string"))
        elif outer and from_right:
            c = F.when(F.col("_match").isNotNull(), c)
        final.append(c.alias(name))

    for p in projections:
        if isinstance(p, ColumnRef):
            put(F.col(f"_o_{_raw(p)}"), p.output, p.dataset.name == right)
        elif any(p is f for f in shared):
            if isinstance(p, Extend):
                for c, n in zip(_extend_columns(p, [F.col(f"_o_{_raw(c)}") for c in p.inputs]), p.outputs, strict=True):
                    put(c, n, True)
            else:
                put(F.col(f"_s{n_shared}"), p.outputs[0], True)
                n_shared += 1
        else:
            own = p.inputs[0].dataset.name
            kind = "e" if isinstance(p, Extend) else "a" if isinstance(p, Aggregate) else "r"
            i = place[own][kind]
            place[own][kind] += 1
            for j, n in enumerate(p.outputs):
                put(F.col(f"_a{i}_{own}" if kind == "a" else f"_{kind}{i}_{j}_{own}"), n, own == right)
    result = Dataset("result", whole.select(*final))
    return result.where(having) if having is not None else result
