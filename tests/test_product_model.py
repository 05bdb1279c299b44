"""The compiler against a plain model: for each key, the product of what each dataset contributes by itself."""

import itertools
import random
from collections import defaultdict

import pytest

from loomframe import Counts, Max, Sum, Top, Unique, equal, from_dataframe, group, inner_join, left_outer_join


def contribution(rows, columns, functions):
    """Product of one dataset's rows (of the chosen columns), aggregates and many-row functions."""
    lists = []
    if columns:
        lists.append([tuple(r[c] for c in columns) for r in rows])
    for f in functions:
        values = [r["v"] for r in rows]
        known = [v for v in values if v is not None]
        if f == "counts":
            lists.append([(len(known),)])
        elif f == "max":
            lists.append([(max(known, default=None),)])
        elif f == "sum":
            lists.append([(float(sum(known)),)])
        elif f == "top":
            lists.append([(v,) for v in sorted(values, key=lambda v: (v is not None, v or 0))[:2]])
        elif f == "unique":
            lists.append([(v,) for v in set(values)])
    return [tuple(itertools.chain(*x)) for x in itertools.product(*lists)]


MAKE = {"counts": Counts, "max": Max, "sum": Sum, "unique": Unique, "top": lambda c: Top([c], 2)}


def data(rnd, n):
    return [{"k": rnd.choice([None, 1, 2, 3]), "v": rnd.choice([None, 1, 2, 5])} for _ in range(n)]


def ask(dataset, columns, functions, prefix):
    return [dataset[c].rename(prefix + c) for c in columns] + [MAKE[f](dataset["v"]).rename(f"{prefix}{f}{i}") for i, f in enumerate(functions)]


@pytest.mark.parametrize("seed", range(8))
def test_against_the_model(spark, seed):
    rnd = random.Random(seed)
    made = {n: data(rnd, rnd.randint(0, 8)) for n in "ab"}
    kinds = {n: (["v"] if rnd.random() < 0.6 else [], rnd.sample(list(MAKE), rnd.randint(0, 2))) for n in "ab"}
    kinds = {n: (c, f) if c or f else (["v"], []) for n, (c, f) in kinds.items()}
    sets = {n: from_dataframe(n, spark.createDataFrame([(r["k"], r["v"]) for r in made[n]], "k int, v int")) for n in "ab"}
    by = {n: defaultdict(list) for n in "ab"}
    for n in "ab":
        for r in made[n]:
            by[n][r["k"]].append(r)
    key = lambda rows: sorted(rows, key=repr)

    got = group(sets["a"]).by("k").select(*ask(sets["a"], *kinds["a"], "a_"))
    assert key(tuple(r) for r in got.df.collect()) == key(x for rows in by["a"].values() for x in contribution(rows, *kinds["a"]))

    chosen = [*ask(sets["a"], *kinds["a"], "a_"), *ask(sets["b"], *kinds["b"], "b_")]
    on = equal(sets["a"]["k"], sets["b"]["k"])
    want = [x + y for k in by["a"] if k in by["b"] for x in contribution(by["a"][k], *kinds["a"]) for y in contribution(by["b"][k], *kinds["b"])]
    assert key(tuple(r) for r in inner_join(sets["a"], sets["b"]).on(on).select(*chosen).df.collect()) == key(want)

    width = len(kinds["b"][0]) + len(kinds["b"][1])
    want += [x + (None,) * width for k in by["a"] if k not in by["b"] for x in contribution(by["a"][k], *kinds["a"])]
    assert key(tuple(r) for r in left_outer_join(sets["a"], sets["b"]).on(on).select(*chosen).df.collect()) == key(want)
