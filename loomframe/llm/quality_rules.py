"""Quality rules: text statistics in Spark expressions, and a decision list learned from labelled statistics.

The list is learned by sequential covering from the labelled rows that pass the base rule. A rule is a conjunction of
threshold tests; it is grown test by test on two thirds of the rows, by information gain, and then pruned from its end on
the other third. It enters the list if that makes the description of the labels shorter (bits for its tests and for the
exceptions to it); if not, the next one begins with another statistic. Rows that a finished rule covers are set aside.
All that learning needs to know of the labelled rows is counts of labels by statistic and bin, which one aggregation
gives whatever the number of rows; the finished list is a chain of CASE WHEN expressions. Nothing depends on how rows are
partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_written, table, written

WINDOW = 5
#: Bins of a statistic x are parts of log(1 + STEPS[0] * x), STEPS[1] of them for each unit.
STEPS = (1000.0, 25.0)
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in WINDOW-word windows that stand twice or more in the text, the first time included.

    Windows are hashed and sorted with their places, so equal ones are neighbours; the places of those with an equal
    neighbour are sorted, and each covers WINDOW words or as many as there are up to the next.
    """

    def windows(w: Column) -> Column:
        hashed = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), hashed))

    def places(s: Column) -> Column:
        twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    found = _bind(words, lambda w: F.when(F.size(w) > WINDOW, _bind(_bind(windows(w), places), covered)).otherwise(0))
    return found.cast("bigint")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the contract's counts and further ones, all from the whole text.

    Null text counts as empty: all counts are 0. Repeated rows each give a row; other columns are never read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", text.alias("text"))
    words = base.select("id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    length = F.length("text")
    less = lambda chars: length - F.length(F.translate("text", chars, ""))
    return words.select(
        F.col("id").alias(id_col),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("bigint").alias("word_chars"),
        less(_SYMBOLS).cast("bigint").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"),
        less("!?").cast("bigint").alias("n_marks"),
        less("0123456789").cast("bigint").alias("n_digits"),
        F.size(F.filter("words", lambda x, i: F.coalesce(x == F.get("words", i + 1), F.lit(False)))).cast("bigint").alias("n_stutters"),
    )


#: Name -> expression of the statistics that rules test: shares, so that they mean the same for any length.
def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    return {
        "symbols_a_word": _share("n_symbols", "n_words"),
        "marks_a_word": _share("n_marks", "n_words"),
        "capitals_a_char": _share("n_capitals", "word_chars"),
        "digits_a_char": _share("n_digits", "word_chars"),
        "repeats_a_word": _share("n_repeat_words", "n_words"),
        "stutters_a_word": _share("n_stutters", "n_words"),
        "chars_a_word": _share("word_chars", "n_words"),
        "dup_lines_a_word": _share("n_dup_lines", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    """``feature`` >= or < ``threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= F.lit(self.threshold) if self.at_least else of[self.feature] < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All ``tests`` hold: low quality, with this precision on the rows kept for pruning."""

    tests: tuple[Test, ...]
    precision: float

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(of)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides, and a text under none is kept."""

    rules: tuple[Rule, ...]

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1; 0 for none."""
        of, out = features(), None
        for i, r in enumerate(self.rules, 1):
            out = F.when(r.column(of), i) if out is None else out.when(r.column(of), i)
        return F.lit(0) if out is None else out.otherwise(0)

    def kept(self) -> Column:
        return self.rule() == 0


def _covered(rows: DataFrame, done: list[Rule], tests: tuple[Test, ...]) -> DataFrame:
    own = {k: F.col(k) for k in features()}
    for r in done:
        rows = rows.where(~r.column(own))
    return rows.where(Rule(tests, 0.0).column(own)) if tests else rows


def _grid(name: str) -> Column:
    """The bin of a statistic from 0 on: finer near 0, about 4 % wide further up, some 250 for all that occur."""
    return F.floor(F.log1p(F.col(name) * STEPS[0]) * STEPS[1]).cast("int")


def _edge(b: int) -> float:
    return math.expm1(b / STEPS[1]) / STEPS[0]


def _histogram(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """Counts [bad, good] in each bin of each statistic, from one aggregation with a result of bounded size."""
    each = F.array(*[F.struct(F.lit(k).alias("f"), _grid(k).alias("b")) for k in features()])
    counts = rows.select(F.explode(each).alias("x"), "label").groupBy("x.f", "x.b").agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, 0).otherwise(1)).alias("good")).collect()
    out: dict[str, dict[int, list[int]]] = {k: {} for k in features()}
    for r in counts:
        out[r["f"]][r["b"]] = [int(r["bad"]), int(r["good"])]
    return out


def _tests(bars: dict[int, list[int]]):
    """(threshold, bad below, good below) halfway between each two neighbouring bins that have rows."""
    bins, bad, good = sorted(bars), 0, 0
    for a, b in zip(bins, bins[1:], strict=False):
        bad, good = bad + bars[a][0], good + bars[a][1]
        yield (_edge(a + 1) + _edge(b)) / 2, bad, good


def _bits(n: int, k: int) -> float:
    """Bits that say which k of n rows are exceptions."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's gain of a test: bad rows kept, times what their share gained in bits."""
    if not bad:
        return 0.0
    return bad * (math.log2((bad + 1) / (bad + good + 2)) - math.log2((bad0 + 1) / (bad0 + good0 + 2)))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rules: int = 8, max_tests: int = 3, tries: int = 3, least_precision: float = 0.75) -> DecisionList:
    """A decision list for label 0 from ``stats`` (as ``statistics`` gives them) and ``labels``.

    All labelled rows that pass the base rule count. A rule enters if it shortens the description of the labels and is
    right for ``least_precision`` of the rows it wasn't grown on; after ``tries`` rules in a row that aren't, the list ends.
    Null labels and ids teach nothing; without label 0, or without labels, the list is empty and keeps everything.
    """
    of = features()
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    joined = stats.where(~base_failed()).join(own, stats[id_col] == own["_id"]).select("label", *[c.alias(k) for k, c in of.items()], (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("prune"))
    rows = written(joined, "labelled")
    grow, prune = rows.where(~F.col("prune")), rows.where("prune")
    plain = {k: F.col(k) for k in of}

    rules: list[Rule] = []
    refused: list[str] = []
    while len(rules) < max_rules and len(refused) < tries:
        tests: tuple[Test, ...] = ()
        choices = 1
        while len(tests) < max_tests:
            h = _histogram(_covered(grow, rules, tests))
            first = list(next(iter(h.values())).values())
            bad0, good0 = sum(x[0] for x in first), sum(x[1] for x in first)
            if not bad0 or not good0:
                break
            best, test = 1e-9, None
            choices = max(choices, sum(2 * max(0, len(bars) - 1) for bars in h.values()))
            for k, bars in h.items():
                if not tests and k in refused:
                    continue
                for cut, bad, good in _tests(bars):
                    for at_least, b, g in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                        if (v := _gain(b, g, bad0, good0)) > best:
                            best, test = v, Test(k, at_least, cut)
            if test is None:
                break
            tests = (*tests, test)
        if not tests:
            break
        # the shortest beginning of the rule that is worth most on rows it wasn't grown on
        hit = lambda n, v: F.coalesce(F.sum(F.when(Rule(tests[: n + 1], 0.0).column(plain) & (F.col("label") == v if v == 0 else F.col("label") != 0), 1)), F.lit(0))  # noqa: E731, B023
        counts = {r["prune"]: r for r in _covered(rows, rules, ()).groupBy("prune").agg(*[hit(n, v).alias(f"c{n}_{v}") for n in range(len(tests)) for v in (0, 1)], F.sum((F.col("label") == 0).cast("int")).alias("bad"), F.count("*").alias("all")).collect()}
        count = lambda key, parts=(False, True): sum(int(counts[p][key]) for p in parts if p in counts)  # noqa: E731, B023
        worth = [((count(f"c{n}_0", (True,)) - count(f"c{n}_1", (True,))) / max(1, count(f"c{n}_0", (True,)) + count(f"c{n}_1", (True,))), n) for n in range(len(tests))]
        n = max(worth, key=lambda x: (round(x[0], 3), -x[1]))[1]
        bad, good = count(f"c{n}_0"), count(f"c{n}_1")
        without = _bits(count("all"), count("bad"))
        with_it = _bits(bad + good, good) + _bits(count("all") - bad - good, count("bad") - bad) + (n + 1) * math.log2(choices + 1)
        seen = count(f"c{n}_0", (True,)) + count(f"c{n}_1", (True,))
        if with_it < without and bad > good and count(f"c{n}_0", (True,)) >= least_precision * seen:
            rules.append(Rule(tests[: n + 1], count(f"c{n}_0", (True,)) / seen if seen else bad / (bad + good)))
            refused = []
        else:
            refused.append(tests[0].feature)
    drop_written(rows)
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(stats: DataFrame, decisions: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (number of the rule that rejects, 0 for none) and ``kept``."""
    return stats.withColumns({"base_failed": base_failed(), "rule": decisions.rule()}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    stats = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    judged = judge(stats, learn(stats, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
