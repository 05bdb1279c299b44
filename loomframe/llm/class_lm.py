"""Class-based n-gram scoring: words in classes by exchange clustering, class transitions times word emissions.

All counts cover all training texts, and every training word that stands there twice or more gets its class from the
classes of its neighbours:

1. The commonest ``units`` words are clustered by exchange until none moves, on their full table of pairs.
2. All common words, as many as one broadcast table may hold, are exchanged in rounds over the whole corpus: each task
   counts, for every such word, the classes that stand before and after it; the sums decide, word by word and against
   the class pairs of the round before, where the likelihood is greatest.
3. Every other word that stands twice or more takes the class in which the likelihood of its neighbours is greatest;
   these words are shuffled by word, with the classes beside each occurrence. Words that stand once form the rare class,
   to which unseen words belong as well.

What is broadcast is bounded: the common words with their counts and classes, and the class pairs. The counts and classes
of all other words are a table of Spark's, and reach the documents through a join by word.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, drop_written, fold, pack, ranges, table, unpack, written

#: The token at the end of each text; no word has a space, so none is equal to it.
END = b" "
#: Words a task counts before it hands them on.
COUNTED = 500_000
#: Pairs of a word and a class beside it that a task counts before it hands them on.
PLACES = 1 << 20
#: This many words, the commonest, are broadcast with their counts and classes, at most.
COMMON = 1 << 17
#: Most classes; there is one for the cube root of the number of distinct words up to that.
CLASSES = 128
#: What a pair of classes that was never seen counts as when classes are chosen.
UNSEEN = 0.5
STRIPS = 32


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; UTF-8 bytes, whose lower case and white space are ASCII's own."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def _parts(batches, column: int = 0):
    """Some megabytes of texts at a time, with the batch they are of and their place in it."""
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(column)
        for part in ranges(pc.binary_length(texts).to_pylist()):
            yield batch, part, texts[part].to_pylist()


def _looked_up(batches, words: list[bytes], column: int = 0):
    """Some megabytes of texts at a time, with the batch they are of and their place in it: their words as ``tokens`` has
    them, in one Arrow column; each word's number in ``words``, one more if it isn't there, with END after each text; and
    how many numbers each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table, end = pa.array(words, pa.binary()).cast(pa.string()), words.index(END)
    for batch in batches:
        texts = batch.column(column)
        for part in ranges(pc.binary_length(texts).to_pylist()):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[part].fill_null("")))
            flat = lists.flatten()
            given = pc.not_equal(flat, "")  # white space at either end leaves an empty string
            before = np.append(0, np.cumsum(given.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]
            own = flat.filter(given)
            numbers = pc.index_in(own, value_set=table).fill_null(len(words)).to_numpy().astype(np.int64)
            yield batch, part, own, np.insert(numbers, before[1:], end), np.diff(before) + 1


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word, or END, stands in all texts. Null and empty texts have END alone."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()

        def hand_on():
            for at in range(0, len(keys := list(counts)), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8") for k in part], pa.string()), pa.array([counts[k] for k in part], pa.int64())], schema=schema)

        for _, _, texts in _parts(batches):
            for text in texts:
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield from hand_on()
                    counts.clear()
        yield from hand_on()

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def _least_common(counts: DataFrame, common: int) -> int:
    """The least count that at most ``common`` words reach, to the nearest twentieth of a factor: found from the number
    of words in each such band, so only the words above it come to the driver."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.05)).cast("int")
    bands = sorted(counts.groupBy(band.alias("b")).count().collect(), key=lambda r: -r["b"])
    total, least = 0, None
    for r in bands:
        total += r["count"]
        if total > common:
            break
        least = r["b"]
    return math.ceil(1.05**least - 1e-6) if least is not None else 1 << 62


# ---- the corpus as numbers of words ----------------------------------------------------------------------------------


def numbered(docs: DataFrame, number_of: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """(data): the texts as numbers of common words, which count from 0 in the order given, one number more for all others, END before the first and after each."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(number_of)

    def run(batches):
        for _, _, _, ids, _ in _looked_up(batches, list(shared.value)):
            yield pa.RecordBatch.from_arrays([pa.array([pack(np.append(shared.value[END], ids))], pa.binary())], names=["data"])

    return written(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "data binary"), "numbers")


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays of ``size`` numbers, each handed on in strips (strip, part); a strip is added up by one task."""
    import pyarrow as pa

    step = -(-size // STRIPS)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(part), np.int64)
                totals[strip] = totals[strip] + own if strip in totals else own
        for strip, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["strip", "part"])

    out = np.zeros(step * STRIPS, np.int64)
    for r in parts.repartition(STRIPS, "strip").mapInArrow(add, "strip int, part binary").collect():
        own = np.frombuffer(zlib.decompress(bytes(r["part"])), np.int64)
        out[r["strip"] * step : r["strip"] * step + len(own)] += own
    return out[:size]


def _strips(total: np.ndarray):
    import pyarrow as pa

    step = -(-len(total) // STRIPS)
    parts = [zlib.compress(total[i * step : (i + 1) * step].tobytes(), 1) for i in range(STRIPS)]
    return pa.RecordBatch.from_arrays([pa.array(range(STRIPS), pa.int32()), pa.array(parts, pa.binary())], names=["strip", "part"])


def pair_matrix(numbers: DataFrame, unit_of: np.ndarray, n: int) -> np.ndarray:
    """Counts of pairs of neighbours, each word counted as its unit."""
    shared = numbers.sparkSession.sparkContext.broadcast(unit_of)

    def run(batches):
        units, total = shared.value.astype(np.int64), np.zeros(n * n, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                u = units[unpack(data)[0].astype(np.int64)]
                total += np.bincount(u[:-1] * n + u[1:], minlength=n * n)
        yield _strips(total)

    return _summed(numbers.mapInArrow(run, "strip int, part binary"), n * n).reshape(n, n)


# ---- classes ---------------------------------------------------------------------------------------------------------


def exchange(pairs: np.ndarray, free: int, n_classes: int, rounds: int = 100) -> np.ndarray:
    """Classes of the units by the exchange algorithm: the first ``free`` units, the commonest, each move to the class
    where the likelihood of the class pairs is greatest, in turn, until none moves; the other units stay by themselves.

    Class pair counts are kept up with each move. With few units each has a class of its own.
    """
    n = len(pairs)
    k = min(n_classes, free)
    cls = np.array([i % k if i < free else k + i - free for i in range(n)])
    total = k + n - free
    M = np.zeros((total, total))
    np.add.at(M, (cls[:, None], cls[None, :]), pairs)
    P = pairs.astype(float)

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(rounds):
        moved = 0
        for u in range(free):
            own = cls[u]
            out, into = np.bincount(cls, P[u], total), np.bincount(cls, P[:, u], total)
            self_pair = P[u, u]
            out[own] -= self_pair
            into[own] -= self_pair
            # take the unit out of its class
            M[own] -= out
            M[:, own] -= into
            M[own, own] -= self_pair
            # wherever the unit goes, the others' margins count their pairs with it
            left, right = M.sum(1) + into, M.sum(0) + out
            # what the sums change by if the unit joins class c: its row, its column, its own cell, its margins
            rows, cols = xlogx(M[:k] + out) - xlogx(M[:k]), xlogx(M[:, :k].T + into) - xlogx(M[:, :k].T)
            c = np.arange(k)
            diagonal = M[c, c]
            gain = rows.sum(1) + cols.sum(1) - rows[c, c] - cols[c, c]
            gain += xlogx(diagonal + out[:k] + into[:k] + self_pair) - xlogx(diagonal)
            a, b = out.sum() + self_pair, into.sum() + self_pair
            gain -= xlogx(left[:k] + a) - xlogx(left[:k]) + xlogx(right[:k] + b) - xlogx(right[:k])
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            cls[u] = best
            M[best] += out
            M[:, best] += into
            M[best, best] += self_pair
        if not moved:
            break
    return cls


def best_classes(before: np.ndarray, after: np.ndarray, times: np.ndarray, own: np.ndarray, M: np.ndarray) -> np.ndarray:
    """The class of greatest likelihood for each word, from the numbers of each class before and after it (words by
    classes), how often it stands, and its class so far (-1: none). ``M`` has the class pairs so far, which count the word
    where it has a class; it is taken out of them for that class. Ties go to the class so far, else to the first."""
    k = before.shape[1]
    pairs, left, mass = M[:k, :k].astype(float), M[:k].sum(1).astype(float), M[:, :k].sum(0).astype(float)
    log = np.log(pairs + UNSEEN)
    follow, n = after.sum(1).astype(float), times.astype(float)
    # each class is as heavy as with the word in it
    worth = before @ log + after @ log.T
    worth -= follow[:, None] * np.log(left[None] + follow[:, None] + UNSEEN) + n[:, None] * np.log(mass[None] + n[:, None] + UNSEEN)
    at = np.flatnonzero(own >= 0)
    if len(at):
        c = own[at]
        into, out = np.maximum(pairs[:, c].T - before[at], 0), np.maximum(pairs[c] - after[at], 0)
        stay = (before[at] * np.log(into + UNSEEN)).sum(1) + (after[at] * np.log(out + UNSEEN)).sum(1)
        stay -= follow[at] * np.log(left[c] + UNSEEN) + n[at] * np.log(mass[c] + UNSEEN)
        worth[at, c] = stay + 1e-9
    return worth.argmax(1)


def _cells(batches, class_of: np.ndarray, m: int, k: int):
    """Of texts as numbers of words, some at a time: a number for each common word and the class before it, and for each
    and the class after it. Words are in the order of their numbers, each with k + 1 classes before and k + 1 after."""
    width = 2 * (k + 1)
    for batch in batches:
        for data in batch.column(0):
            a = unpack(data.as_py())[0].astype(np.int64)
            for part in (a[i : i + PLACES + 1] for i in range(0, len(a) - 1, PLACES)):
                c = class_of[part]
                for words, at in ((part[1:], c[:-1]), (part[:-1], c[1:] + k + 1)):
                    known = words < m
                    yield words[known] * width + at[known]


def _counted(parts):
    """Distinct numbers in order and how often each stands in the arrays, for some PLACES of them at a time: what a task
    holds doesn't grow with the number of words, classes or texts."""
    held: list = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= PLACES:
            yield np.unique(np.concatenate(held), return_counts=True)
            held = []
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def _exchanged(numbers: DataFrame, class_of: np.ndarray, M: np.ndarray, k: int) -> np.ndarray:
    """One round over all common words at once: their classes after it. ``class_of`` ends with what is none (k)."""
    import pyarrow as pa

    shared = numbers.sparkSession.sparkContext.broadcast((class_of, M))
    m, width = len(class_of) - 1, 2 * (k + 1)
    step = -(-m // STRIPS)

    def count(batches):
        classes = shared.value[0].astype(np.int64)
        for cells, n in _counted(_cells(batches, classes, m, k)):
            cuts = np.searchsorted(cells, np.arange(STRIPS + 1) * step * width)
            for s, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo < hi:
                    steps = np.diff(cells[lo:hi], prepend=s * step * width)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(steps, n[lo:hi] - 1)], pa.binary())], names=["strip", "data"])

    def decide(batches):
        classes, pairs = shared.value
        for (s, *_), parts in by_key(batches, 0):
            n = min(step, m - s * step)
            total = np.zeros(n * width, np.int64)
            for data in parts:
                steps, more = unpack(data)
                total[np.cumsum(steps).astype(np.int64)] += more.astype(np.int64) + 1
            total = total.reshape(n, 2, k + 1)
            own = classes[s * step : s * step + n].astype(np.int64)
            best = best_classes(total[:, 0, :k], total[:, 1, :k], total[:, 0].sum(1), np.where(own < k, own, -1), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(best)], pa.binary())], names=["strip", "data"])

    out = class_of.copy()
    rows = numbers.mapInArrow(count, "strip int, data binary").repartition(STRIPS, "strip").sortWithinPartitions("strip").mapInArrow(decide, "strip int, data binary").collect()
    for r in rows:
        best = unpack(bytes(r["data"]))[0]
        out[r["strip"] * step : r["strip"] * step + len(best)] = best
    return out


def _tail(docs: DataFrame, classes: dict[bytes, int], M: np.ndarray, k: int, text_col: str) -> DataFrame:
    """(word, n, class, places) of every word that isn't common: places are the pairs of classes before and after, as one
    number (k for such a word), with how often; there are (k + 1) ** 2 at most. A word that stands once is of the rare
    class, k."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((classes, M))
    width = k + 1

    def look(batches):
        classes = shared.value[0]
        class_of, end = np.append(np.fromiter(classes.values(), np.int64, len(classes)), k), classes[END]
        found: Counter = Counter()

        def hand_on():
            words = pa.array([w for w, _ in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([x for _, x in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "place", "n"])

        for _, _, words, ids, sizes in _looked_up(batches, list(classes)):
            own = np.append(end, class_of[ids])  # before each text stands END, that of the text before or the first one
            text_of = np.repeat(np.arange(len(sizes)), sizes)  # as many ENDs are before a word
            rare = np.flatnonzero(ids == len(classes))
            for at in (rare[i : i + 50_000] for i in range(0, len(rare), 50_000)):
                places = own[at] * width + own[at + 2]
                found.update(zip(words.take(pa.array(at - text_of[at])).to_pylist(), places.tolist(), strict=True))
                if len(found) > COUNTED // 2:
                    yield hand_on()
                    found.clear()
        yield hand_on()

    def decide(batches):
        pairs = shared.value[1]
        for batch in batches:
            words, lists = batch.column(0), batch.column(1)
            of, flat, n = _flat(lists)
            before = np.bincount(of * width + flat // width, n, len(words) * width).reshape(-1, width)
            after = np.bincount(of * width + flat % width, n, len(words) * width).reshape(-1, width)
            times = before.sum(1)
            best = best_classes(before[:, :k], after[:, :k], times, np.full(len(words), -1), pairs)
            yield pa.RecordBatch.from_arrays([words, pa.array(times.astype(np.int64)), pa.array(np.where(times > 1, best, k), pa.int32()), lists], names=["word", "n", "class", "places"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(look, "word string, place int, n bigint")
    # tasks have added up their own; one shuffle by word serves both sums
    places = each.repartition("word").groupBy("word", "place").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("place", "n")).alias("places"))
    return written(places.mapInArrow(decide, "word string, n bigint, class int, places array<struct<place:int,n:bigint>>"), "tail")


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of lists of (place, n): the row of each, its place, its number."""
    of, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
    return of, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()


def _tail_pairs(tail: DataFrame, k: int) -> np.ndarray:
    """Class pairs that the tail's words are part of, with common words beside them."""
    width = k + 1

    def run(batches):
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            of, flat, n = _flat(batch.column(1))
            own, left, right = batch.column(0).to_numpy().astype(np.int64)[of], flat // width, flat % width
            for a, b, known in ((left, own, left < k), (own, right, right < k)):
                total += np.bincount((a * width + b)[known], n[known], width * width).astype(np.int64)
        yield _strips(total)

    return _summed(tail.select("class", "places").mapInArrow(run, "strip int, part binary"), width * width).reshape(width, width)


@dataclass(frozen=True)
class ClassModel:
    """``common`` has the count and class of each common word; ``tail`` is the table (word, n, class) of all others.
    ``step`` is log10 P(class | class before), ``room`` the logarithm of the divisor of emissions in each class; the rare
    class is the last. ``total`` and ``distinct`` are N and V."""

    common: dict[bytes, tuple[int, int]]
    tail: DataFrame
    step: np.ndarray
    room: np.ndarray
    total: int
    distinct: int
    delta: float


def fit(train: DataFrame, text_col: str = "text", units: int = 1000, n_classes: int | None = None, delta: float = 0.5, common: int = COMMON, rounds: int = 2) -> ClassModel:
    """Count, cluster and smooth. Transitions are interpolated with the classes' shares (Witten-Bell), emissions get
    ``delta`` for each word of the class, and in the rare class for one unseen word. ``common`` bounds what is broadcast;
    ``units`` is how many words the driver clusters first, ``rounds`` how often all common words are exchanged after that.
    ``n_classes``: the cube root of the number of distinct words, CLASSES at most. Two neighbours that both aren't common
    count as a pair of the rare class. Null texts count as empty; an empty table gives a model that has seen nothing."""
    counts = written(word_counts(train, text_col), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    end = counts.where(F.col("word") == END.decode()).select("n").first()
    least = _least_common(counts, common)
    top = sorted(counts.where((F.col("word") != END.decode()) & (F.col("n") >= least)).collect(), key=lambda r: (-r["n"], r["word"]))
    times = {END: int(end[0]) if end else 0} | {r["word"].encode(): int(r["n"]) for r in top}
    drop_written(counts)
    m = len(times)
    number_of = {w: i for i, w in enumerate(times)}
    numbers = numbered(train, number_of, text_col)

    free = min(units, m)
    wanted = n_classes or min(CLASSES, max(2, round(distinct ** (1 / 3))))
    core = exchange(pair_matrix(numbers, np.minimum(np.arange(m + 1), free), free + 1), free, wanted)[:free]
    k = int(core.max()) + 1
    class_of = np.full(m + 1, k, np.int16)
    class_of[:free] = core
    M = pair_matrix(numbers, class_of, k + 1)
    for _ in range(rounds):
        new = _exchanged(numbers, class_of, M, k)
        if (new == class_of).all():
            break
        class_of, M = new, pair_matrix(numbers, new, k + 1)
    drop_written(numbers)
    classes = {w: int(class_of[i]) for w, i in number_of.items()}
    tail = _tail(train, classes, M, k, text_col)
    both = M[k, k]
    M[k] = M[:, k] = 0
    M[k, k] = both
    M = M + _tail_pairs(tail, k)

    words, mass = np.bincount(class_of[:m], minlength=k + 1).astype(float), np.bincount(class_of[:m], list(times.values()), k + 1)
    for r in tail.groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
        words[r["class"]] += r["v"]
        mass[r["class"]] += r["n"]
    words[k] += 1  # unseen words
    right, left = M.sum(0), M.sum(1)[:, None]
    share = (right + 1) / (right.sum() + k + 1)
    kinds = (M > 0).sum(1)[:, None]
    step = np.where(left > 0, (M + kinds * share[None]) / np.maximum(left + kinds, 1e-300), share[None])
    room = np.log10(np.maximum(mass + delta * words, 1e-300))
    return ClassModel({w: (n, classes[w]) for w, n in times.items()}, tail.select("word", "n", "class"), np.log10(step), room, total, distinct, delta)


def score(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    ``score`` is log10 of the model's probability of the text and its end, ``perplexity`` 10 ** (-score / n_tokens),
    ``base_score`` the same sum for single words with one added to each count. A first pass sums what the broadcast
    tables know and hands on the other words with the classes beside them, and pairs of such words; these are joined with
    the table of all other words and summed. Null texts count as empty: one token, the end. Rows are told apart by their
    place, so repeated ids and repeated rows each give their own row; other columns are never read. A model of no texts
    gives each word a share of one unseen word.
    """
    spark = docs.sparkSession
    k = len(model.room) - 1
    # of each common word: class, log10(c + 1) and log10 of its emission; the last entry stands for all other words
    number_of = {w: i for i, w in enumerate(model.common)}
    times, class_of = (np.array([x[i] for x in model.common.values()]) for i in (0, 1))
    known_base = np.append(np.log10(times + 1.0), 0.0)
    known_score = np.append(np.log10(times + model.delta) - model.room[class_of], 0.0)
    known = np.append(np.ones(len(times), np.int64), 0)
    known[number_of[END]] = int(model.common[END][0] > 0)
    base_log = math.log10(model.total + model.distinct + 1)
    shared = spark.sparkContext.broadcast((number_of, np.append(class_of, -1), known, known_base, known_score, model.step))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, open array<struct<word:string,left:int,right:int>>, near array<struct<a:string,b:string>>"

    def run(batches):
        import pyarrow as pa

        number_of, class_of, known, known_base, known_score, step = shared.value
        end = number_of[END]

        def listed(mask: np.ndarray, starts: np.ndarray, **columns):
            offsets = np.append(0, np.cumsum(np.add.reduceat(mask.astype(np.int64), starts))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

        for batch, part, words, ids, sizes in _looked_up(batches, list(number_of), 1):
            text_of = np.repeat(np.arange(len(sizes)), sizes)  # as many ENDs are before a word
            starts = np.cumsum(sizes) - sizes
            classes = class_of[np.append(end, ids)]  # before each text stands END, that of the text before or the first one
            left, own = classes[:-1], classes[1:]
            moves = np.where((left >= 0) & (own >= 0), step[left, own], 0.0)
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            is_open = own < 0
            at = np.flatnonzero(is_open)
            is_near = is_open & np.append(is_open[1:], False)  # a text ends with END, which isn't
            word = lambda places: words.take(pa.array(places - text_of[places]))  # noqa: E731, B023
            pairs = np.flatnonzero(is_near)
            opens = listed(is_open, starts, word=word(at), left=pa.array(left[at].astype(np.int32)), right=pa.array(own[at + 1].astype(np.int32)))
            nears = listed(is_near, starts, a=word(pairs), b=word(pairs + 1))
            columns = [pa.array(sizes), pa.array(total(known[ids])), pa.array(total(known_base[ids]) - sizes * base_log), pa.array(total(known_score[ids] + moves))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns, opens, nears], names=["id", "n_tokens", "n_known", "base_score", "score", "open", "near"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the table is written once: rows get their number from files that stay as they are
    first_pass = written(plain.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm")
    numbers = lambda x: F.from_json(F.lit(json.dumps([float(v) for v in np.ravel(x)])), "array<double>")  # noqa: E731  a constant of the plan
    step, room, width = numbers(model.step), numbers(model.room), F.lit(k + 1)
    step_of = lambda a, b: F.get(step, (a * width + b).cast("int"))
    zero, nothing = F.lit(0.0), F.lit(0)
    n, c = F.coalesce("n", nothing), F.coalesce("class", F.lit(k))
    opened = first_pass.select("row", F.explode("open").alias("x")).select("row", "x.word", "x.left", "x.right").join(model.tail, "word", "left")
    beside = F.when(F.col("left") >= 0, step_of(F.col("left"), c)).otherwise(zero) + F.when(F.col("right") >= 0, step_of(c, F.col("right"))).otherwise(zero)
    opened = opened.select(
        "row",
        F.when(n > 0, 1).otherwise(nothing).cast("bigint").alias("more_known"),
        F.log10(n + 1).alias("more_base"),
        (F.log10(n + F.lit(model.delta)) - F.get(room, c) + beside).alias("more_score"),
    )
    of = lambda x: model.tail.select(F.col("word").alias(x), F.col("class").alias(f"c_{x}"))
    near = first_pass.select("row", F.explode("near").alias("x")).select("row", "x.a", "x.b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    near = near.select("row", nothing.cast("bigint").alias("more_known"), zero.alias("more_base"), step_of(F.coalesce("c_a", F.lit(k)), F.coalesce("c_b", F.lit(k))).alias("more_score"))
    looked_up = opened.unionByName(near).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more_known", "more_base", "more_score")])
    whole = first_pass.drop("open", "near").join(looked_up, "row", "left")
    found = whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", nothing)).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 7) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
