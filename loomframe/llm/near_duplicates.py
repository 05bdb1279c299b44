"""Near duplicates by an exact Jaccard join of word n-grams.

1. Every text becomes a sorted set of n-gram hashes; rows with equal sets are one class from here on.
2. N-grams are ordered from rare to frequent, by counts over all rows. Of each set the first few are its prefix: two sets
   that are similar enough share an n-gram of both prefixes (prefix filter). N-grams that only one set has come first in
   the order and meet nothing, so most sets have no entry at all, and only sets with one are fetched for comparison.
3. Entries meet by n-gram. Of each meeting the most ordinary set (least share of n-grams that no other has) is compared
   with all others, which links groups of copies in as many pairs as there are entries; so is, once more, the most
   ordinary of those that this left outside. What is left is compared in all pairs across components, so no link between
   components is missed and large groups of copies never become all their pairs.
4. A pair is compared once, and only if its sizes (length filter), the places of the n-gram in both orders (positional
   filter) and the numbers of n-grams in each of 64 parts of the hash space (suffix filter) allow enough in common. The
   latter two leave out the n-grams that only one set has.

How n-grams are counted: texts are gathered in chunks of some million n-grams. A chunk sends each of its n-grams once,
with its number, to the strip of the hash space that it belongs to, as sorted differences of one to two bytes; a strip
adds up and answers each chunk with the n-grams that stand in several sets. So a frequent n-gram is one number a chunk,
and nothing about the n-grams is broadcast or collected. The hash space for counting has at least 16 slots for each byte
of text, so it grows with the corpus; two n-grams that share a slot count as one, which may let a pair through to the
comparison, never keep it from there. Comparisons are of 64-bit hashes.
"""

from __future__ import annotations

import zlib
from functools import reduce
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap_of, by_key, drop_written, marked, pack, ranges, release, table, unpack, written, written_apart
from .components import components

SIGNATURE = 64
#: N-grams of a chunk, and bytes of text for each strip: what a task holds in memory while it counts.
CHUNK, STRIP_BYTES = 1 << 20, 1 << 23
#: The strips are counted in so many turns, each of which deletes what it has read.
TURNS = 2
#: Least and most bits (as powers of two) of the filters that say which texts and sets a step needs; in between 16 for each
#: text, MARKED for each set.
NEEDED_BITS, MARKED = (16, 27), 1024

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _K[3]
    return h ^ (h >> np.uint64(29))


def ngram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of fewer words, one of the whole sequence; of none, nothing."""
    if not len(words):
        return words
    size = min(n, len(words))
    m = len(words) - size + 1
    h = np.full(m, size, np.uint64)
    for k in range(size):
        h = _mix(h * _K[k % 3] + words[k : k + m] + _K[4])
    return np.unique(h)


def _fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: sums of two hashes of its members."""
    return int(_mix(grams).sum(dtype=np.uint64).view(np.int64)), int(_mix(grams ^ _K[1]).sum(dtype=np.uint64).view(np.int64))


def _node(f1: np.ndarray, f2: np.ndarray, salt: int) -> np.ndarray:
    """One number for a set from its fingerprint."""
    return _mix(f1 ^ _mix(f2 + np.uint64(salt))).view(np.int64)


def _sets(docs: DataFrame, n: int, id_col: str, text_col: str, bits: int, strip_bits: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Tables of three kinds: (doc, size, f1, f2) of each document, with the chunk that has its set if it is the first of its
    task; for each chunk of texts, with ``strip`` -1, which of the chunk's n-grams each set has; and for each chunk and
    strip, the chunk's n-grams with the number of its sets, in TURNS tables."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    target = docs.sparkSession.createDataFrame([], f"doc {kind}, size int, f1 bigint, f2 bigint, chunk bigint, strip int, data binary, kind string").schema
    schema = to_arrow_schema(target)
    shift = np.uint64(64 - bits)

    def chunk_rows(number: int, sets: list[np.ndarray], marks: list[tuple[int, int]]):
        slots, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        sizes = np.array([len(s) for s in sets])
        steps = np.diff(index, prepend=0)
        starts = np.cumsum(sizes) - sizes
        steps[starts] = index[starts]
        f = np.array(marks, np.int64).view(np.uint64)
        data = [pack(sizes, f[:, 0], f[:, 1], steps, [len(slots)])]
        own = (slots >> np.uint64(bits - strip_bits)).astype(np.int64)
        strips = np.unique(own)
        for s, lo, hi in zip(strips.tolist(), np.searchsorted(own, strips, "left").tolist(), np.searchsorted(own, strips, "right").tolist(), strict=True):
            data.append(pack([lo], np.diff(slots[lo:hi], prepend=np.uint64(s << (bits - strip_bits))), times[lo:hi] - 1))
        kinds = pa.array(["sets", *[f"strips{s * TURNS >> strip_bits}" for s in strips.tolist()]])
        strips = pa.array([-1, *strips.tolist()], pa.int32())
        nothing = [pa.nulls(len(data), t) for t in schema.types[:4]]
        return pa.RecordBatch.from_arrays([*nothing, pa.array([number] * len(data), pa.int64()), strips, pa.array(data, pa.binary()), kinds], schema=schema)

    def run(batches):
        words_of, seen = WordHashes(), set()
        number = TaskContext.get().partitionId() << 32
        sets: list[np.ndarray] = []
        marks: list[tuple[int, int]] = []
        total = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in ranges(pc.binary_length(texts).to_pylist(), 1_000_000):
                sizes, fs, chunks = [], [], []
                for text in texts[part].to_pylist():
                    own = ngram_set(words_of(text), n)
                    sizes.append(len(own))
                    fs.append(f := _fingerprint(own))
                    chunks.append(None)
                    if len(own) and f not in seen:
                        seen.add(f)
                        if total + len(own) > CHUNK and sets:
                            yield chunk_rows(number, sets, marks)
                            number, total, sets, marks = number + 1, 0, [], []
                        sets.append(own >> shift)
                        marks.append(f)
                        total += len(own)
                        chunks[-1] = number
                columns = [ids[part].cast(schema.types[0]), pa.array(sizes, pa.int32()), pa.array([a for a, _ in fs], pa.int64()), pa.array([b for _, b in fs], pa.int64()), pa.array(chunks, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(sizes), t) for t in schema.types[5:7]], pa.array(["docs"] * len(sizes))], schema=schema)
        if sets:
            yield chunk_rows(number, sets, marks)

    turns = [f"strips{i}" for i in range(TURNS)]
    made = written_apart(plain.mapInArrow(run, target), "sets", "kind", ["docs", "sets", *turns])
    of_chunk = ["chunk", "strip", "data"]
    return made["docs"].select("doc", "size", "f1", "f2", "chunk"), made["sets"].select(of_chunk), [made[t].select(of_chunk) for t in turns]


def _answers(turn: DataFrame, strips: int) -> DataFrame:
    """(chunk, strip, data): of each chunk and strip, the n-grams that several sets have, with their numbers. The strips'
    table, ``turn``, is deleted."""
    import pyarrow as pa

    def add(batches):
        for chunks, _, parts in by_key(batches, 1):
            lows, slots, times = [], [], []
            for data in parts:
                low, steps, more = unpack(data)
                lows.append(int(low[0]))
                slots.append(np.cumsum(steps))
                times.append(more + 1)
            _, index = np.unique(np.concatenate(slots), return_inverse=True)
            total = np.bincount(index, np.concatenate(times).astype(float)).astype(np.uint64)[index]
            keys, out, at = [], [], 0
            for chunk, low, own in zip(chunks, lows, slots, strict=True):
                here = np.flatnonzero(total[at : at + len(own)] > 1)
                if len(here):
                    keys.append(chunk)
                    out.append(pack(np.diff(here + low, prepend=0), np.diff(own[here], prepend=np.uint64(0)), total[at : at + len(own)][here]))
                at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([0] * len(keys), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "strip", "data"])

    answers = written(turn.repartition(strips, "strip").sortWithinPartitions("strip").mapInArrow(add, "chunk bigint, strip int, data binary"), "answers")
    drop_written(turn)
    release(turn.sparkSession)
    return answers


def _prefixes(sets: DataFrame, answers: DataFrame, rows: DataFrame, percent: int, bits: int, strips: int, salt: int) -> DataFrame:
    """(gram, node, size, shared, rank, slots) of the prefix entries whose n-gram several sets have. ``shared`` of the set's
    n-grams are such, ``rank`` of them come before this one in the order; ``slots``, with a set's first entry alone, is how
    many of them are in each of SIGNATURE parts of the hash space. Of a set that several chunks have, one chunk gives the
    entries."""
    import pyarrow as pa

    def choose(batches):
        for _, kinds, parts, skip_1, skip_2 in by_key(batches, 0):
            own = kinds.index(-1)
            elsewhere = {(x, y) for k, x, y in zip(kinds, skip_1, skip_2, strict=True) if k == -2}
            sizes, f1, f2, steps, (n_slots,) = unpack(parts[own])
            node = _node(f1, f2, salt)
            total, slot = np.zeros(int(n_slots), np.int64), np.zeros(int(n_slots), np.uint64)
            for k, data in enumerate(parts):
                if kinds[k] >= 0:
                    index, slots, times = unpack(data)
                    at = np.cumsum(index).astype(np.int64)
                    total[at], slot[at] = times, np.cumsum(slots)
            sizes = sizes.astype(np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            sums = np.cumsum(steps.astype(np.int64))
            index = sums - np.repeat(sums[starts] - steps[starts].astype(np.int64), sizes)
            grams, of, rank, shared, slots_of = [], [], [], [], []
            alike = total[index] > 0
            before = np.concatenate([[0], np.cumsum(alike)])
            n_shared = before[ends] - before[starts]
            n_first = sizes + (-percent * sizes) // 100 + 1 - (sizes - n_shared)
            of_1, of_2 = f1.view(np.int64).tolist(), f2.view(np.int64).tolist()
            for d in np.flatnonzero(n_first > 0).tolist():
                if (of_1[d], of_2[d]) in elsewhere:
                    continue
                mine = index[starts[d] : ends[d]][alike[starts[d] : ends[d]]]
                first = np.lexsort((mine, total[mine]))[: n_first[d]]  # by count, then by slot
                grams.append(slot[mine[first]].view(np.int64))
                of.append(np.full(len(first), d))
                rank.append(np.arange(len(first), dtype=np.int32))
                shared.append(np.full(len(first), n_shared[d], np.int32))
                parts_of = np.bincount((slot[mine] >> np.uint64(bits - 6)).astype(np.int64), minlength=SIGNATURE)
                slots_of += [parts_of, *[None] * (len(first) - 1)]
            if grams:
                d = np.concatenate(of)
                columns = [np.concatenate(grams), node[d], sizes[d].astype(np.int32), np.concatenate(shared), np.concatenate(rank)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(slots_of, pa.list_(pa.int32()))], names=["gram", "node", "size", "shared", "rank", "slots"])

    # sets that stand in several chunks: all but one of these leave them out
    stands = rows.where("chunk is not null").select("f1", "f2", "chunk")
    several = stands.groupBy("f1", "f2").agg(F.min("chunk").alias("own"), F.count("*").alias("n")).where("n > 1").select("f1", "f2", "own")
    elsewhere = stands.join(several, ["f1", "f2"]).where("chunk <> own").select("chunk", F.lit(-2).alias("strip"), F.lit(None).cast("binary").alias("data"), "f1", "f2")
    by_chunk = sets.unionByName(answers).unionByName(elsewhere, allowMissingColumns=True)
    return by_chunk.repartition(strips, "chunk").sortWithinPartitions("chunk").mapInArrow(choose, "gram bigint, node bigint, size int, shared int, rank int, slots array<int>")


def _nodes(rows: DataFrame, entries: DataFrame, salt: int) -> DataFrame:
    """(node, f1, f2, doc) of every set that has an entry in a meeting, with one document that it is of."""
    import pyarrow as pa

    def number(batches):
        for batch in batches:
            f1, f2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_node(f1, f2, salt)), *batch.columns], names=["node", "f1", "f2", "doc"])

    kind = rows.schema["doc"].dataType.simpleString()
    numbers = rows.where("size > 0").select("f1", "f2", "doc").mapInArrow(number, f"node bigint, f1 bigint, f2 bigint, doc {kind}")
    own = numbers.join(entries.select("node").distinct(), "node", "left_semi")
    return written(own.groupBy("node", "f1", "f2").agg(F.min("doc").alias("doc")), "nodes")


def _bits(nodes: DataFrame, each: int) -> int:
    return max(NEEDED_BITS[0], min(NEEDED_BITS[1], int(nodes.count() * each).bit_length()))


def _node_sets(docs: DataFrame, nodes: DataFrame, slots: DataFrame, n: int, id_col: str, text_col: str, salt: int) -> DataFrame:
    """(node, size, slots, grams) of every node: the texts that make them are read once more, and no others are cut up."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    wanted = nodes.select(F.xxhash64("doc").alias("h"))
    needed = spark.sparkContext.broadcast(bitmap_of(wanted, _bits(nodes, 16)))  # 2 ** NEEDED_BITS[1] bits at most

    def run(batches):
        words_of, marks, seen = WordHashes(), np.frombuffer(zlib.decompress(needed.value), np.uint8), set()
        for batch in batches:
            keep = pa.array(marked(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), marks))
            texts = batch.column(1).filter(keep)
            for part in ranges(pc.binary_length(texts).to_pylist(), 1_000_000):
                own = {}
                for text in texts[part].to_pylist():
                    grams = ngram_set(words_of(text), n)
                    f = _fingerprint(grams)
                    if len(grams) and f not in seen:
                        seen.add(f)
                        own[f] = grams
                if own:
                    f = np.array(list(own), np.int64).view(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_node(f[:, 0], f[:, 1], salt)), pa.array([len(s) for s in own.values()], pa.int32()), pa.array([s.tobytes() for s in own.values()], pa.binary())],
                        names=["node", "size", "grams"],
                    )

    hashed = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    made = hashed.mapInArrow(run, "node bigint, size int, grams binary").join(nodes.select("node"), "node", "left_semi")
    # copies in several tasks give one set several times
    return written(made.groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams")).join(slots, "node"), "node-sets")


def _worth(a: str, b: str, percent: int):
    """Length and positional filter for entries ``a`` and ``b`` that meet: can enough be in common."""
    size_a, size_b, shared_a, shared_b, rank_a, rank_b = (F.col(f"{x}.{c}") for c in ("size", "shared", "rank") for x in (a, b))
    least = F.ceil(F.lit(percent) * (size_a + size_b) / F.lit(100 + percent))
    most = F.least(rank_a, rank_b) + F.least(shared_a - rank_a, shared_b - rank_b)
    return (F.lit(100) * F.least(size_a, size_b) >= F.lit(percent) * F.greatest(size_a, size_b)) & (most >= least)


def _common_slots(a: str, b: str):
    """Suffix filter: what two sets have in common is at most the sum of the lesser numbers of each slot."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def _enough(common, size_a, size_b, percent: int):
    return F.lit(100 + percent) * common >= F.lit(percent) * (size_a + size_b)


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets are similar enough."""
    import pyarrow as pa

    side = lambda c: sets.select(F.col("node").alias(c), F.struct("size", "slots").alias(f"of_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    hopeful = written(met.where(_enough(_common_slots("of_a.slots", "of_b.slots"), F.col("of_a.size"), F.col("of_b.size"), percent)).select("a", "b"), "hopeful")

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    # the pairs left are few: only their sets are moved
    whole_a, whole_b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")).join(hopeful.select(c), c, "left_semi") for c in ("a", "b"))
    whole = hopeful.join(whole_a, "a").join(whole_b, "b")
    links = written(whole.select("a", "b", "ga", "gb").mapInArrow(verify, "a bigint, b bigint"), "links")
    drop_written(hopeful)
    return links


def _open(entries: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Entries with their components, of meetings that have several, each with its meeting's most ordinary entry."""
    own = entries.withColumn("component", F.col("node"))
    if found is not None:
        own = entries.join(found.select("node", F.col("component").alias("_c")), "node", "left").withColumn("component", F.coalesce("_c", "node"))
    hub = F.min(F.struct(((F.col("size") - F.col("shared")) / F.col("size")).alias("odd"), "node", "component", "size", "shared", "rank"))
    meetings = own.groupBy("gram").agg(hub.alias("hub"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
    return own.join(meetings.select("gram", "hub"), "gram").select("gram", "node", "component", "size", "shared", "rank", "hub")


def _led(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of the entries of open meetings with their meetings' most ordinary ones."""
    met = entries.select(F.struct("node", "component", "size", "shared", "rank").alias("e"), "hub")
    met = met.where((F.col("e.component") != F.col("hub.component")) & _worth("e", "hub", percent))
    return met.select(F.least("e.node", "hub.node").alias("a"), F.greatest("e.node", "hub.node").alias("b")).distinct()


def _shared_slots(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, slots) of these ``nodes`` and maybe others: in each part of the hash space, how many n-grams another one of them
    has as well."""
    import pyarrow as pa

    needed = nodes.sparkSession.sparkContext.broadcast(bitmap_of(nodes.select(F.xxhash64("node").alias("h")), _bits(nodes, MARKED)))

    def spread(batches):
        marks = np.frombuffer(zlib.decompress(needed.value), np.uint8)
        for batch in batches:
            keep = pa.array(marked(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), marks))
            for node, data in zip(*[c.filter(keep).to_pylist() for c in batch.columns[1:]], strict=True):
                grams = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node)), pa.array(grams)], names=["node", "gram"])

    # the sets stay where they are; the few others that the bitmap lets through only let more pairs pass the filter
    grams = sets.select(F.xxhash64("node").alias("h"), "node", "grams").mapInArrow(spread, "node bigint, gram bigint")
    several = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    part = F.shiftrightunsigned("gram", 58).cast("int").alias("part")
    counts = grams.join(several, "gram", "left_semi").groupBy("node", part).agg(F.count("*").cast("int").alias("n"))
    each = counts.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("of"))
    return each.select("node", F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0))).alias("slots"))


def _across(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of one meeting and different components that pass all filters.

    The suffix filter counts only n-grams that several of the sets in these meetings have, each set once however many
    copies it has, so members of a group of copies that differ from each other by their own changes don't pass it.
    """
    # the largest size that a partner can have; entries that no partner in their meeting fits go before any pair is made
    reach = F.floor(F.col("shared") * F.lit(100 + percent) / F.lit(percent)) - F.col("size")
    own = entries.drop("hub").withColumn("reach", reach)
    fits = own.groupBy("gram").agg(F.min("size").alias("_least"), F.max("reach").alias("_most"))
    own = written(own.join(fits, "gram").where("reach >= _least and size <= _most").drop("_least", "_most", "reach"), "fitting")
    slots = written(_shared_slots(own.select("node").distinct(), sets), "slots")
    own = own.join(slots, "node")
    s, t = own.alias("s"), own.alias("t")
    can = _worth("s", "t", percent) & _enough(_common_slots("s.slots", "t.slots"), F.col("s.size"), F.col("t.size"), percent)
    pairs = s.join(t, (F.col("s.gram") == F.col("t.gram")) & (F.col("s.component") != F.col("t.component")) & (F.col("s.node") < F.col("t.node")) & can)
    return pairs.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``.

    Words are runs without ASCII white space, A-Z in lower case; two rows are linked when the Jaccard similarity of their
    sets of distinct n-grams is at least ``percent`` / 100. ``component_id`` is the least id among the rows that links
    lead to, the row's own included. Texts of fewer than ``n`` words are one n-gram; null texts and texts without a word
    have no set and are linked with nothing. Repeated rows have equal sets and so one component; a null id counts as an
    id only where its component has no other. Other columns are never read. An empty table gives an empty one. Tables
    in between are deleted as soon as nothing reads them, but for two small ones that the result is read from.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits, strip_bits = max(24, min(62, size.bit_length() + 4)), max(4, min(20, (size // STRIP_BYTES).bit_length()))
    rows, own, turns = _sets(docs, n, id_col, text_col, bits, strip_bits)
    answered = [_answers(turn, 1 << strip_bits) for turn in turns]
    for salt in count(1):
        entries = written(_prefixes(own, reduce(DataFrame.unionByName, answered), rows, percent, bits, 1 << strip_bits, salt), "entries")
        release(docs.sparkSession)
        left = written(_open(entries.drop("slots")), "open")
        nodes = _nodes(rows, left, salt)
        slots = written(entries.where("slots is not null").select("node", "slots").join(nodes.select("node"), "node", "left_semi"), "slots")
        drop_written(entries)
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
        for old in (left, nodes, slots):  # two sets have one number: other numbers
            drop_written(old)
    for done in (own, *answered):
        drop_written(done)
    release(docs.sparkSession)
    sets = _node_sets(docs, nodes, slots, n, id_col, text_col, salt)
    drop_written(slots)
    release(docs.sparkSession)

    found = None
    links, tested = [], []
    for step in (1, 2, 3):
        if step > 1:  # meetings only close
            left, last = written(_open(left.drop("component", "hub"), found), "open"), left
            drop_written(last)
        if step == 1:
            pairs = _led(left, percent)
        elif step == 2:
            # those outside the component of the most ordinary one, as meetings of their own
            pairs = _led(_open(left.where("hub.component <> component").drop("hub", "component"), found), percent)
        else:
            pairs = _across(left, sets, percent)
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tested.append(written(pairs, "pairs"))
        links.append(_compare(tested[-1], sets, percent))
        if not links[-1].isEmpty():
            if found is not None:
                drop_written(found)
            found = components(reduce(DataFrame.unionByName, links))
        del pairs
        release(docs.sparkSession)
    for done in (left, sets, *tested, *links):
        drop_written(done)

    # the least id of each class, and of the classes of each component
    classes = rows.where("size > 0").groupBy("f1", "f2", "size").agg(F.min("doc").alias("least"))
    if found is None:
        of_class = written(classes.withColumnRenamed("least", "component_id"), "classes")
    else:
        linked = found.join(nodes.select("node", "f1", "f2"), "node").select("f1", "f2", "component")
        class_of = classes.join(linked, ["f1", "f2"], "left")
        ids = class_of.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
        of_class = written(class_of.join(ids, "component", "left").select("f1", "f2", "size", F.coalesce("first", "least").alias("component_id")), "classes")
        drop_written(found)
    drop_written(nodes)
    out = rows.join(of_class, ["f1", "f2", "size"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the least id, and of several such any one. Null ids
    come last, so a row without id stays only where its whole component has none. Rows without words are components of
    their own and all stay."""
    ids = docs.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    if ids[0] == ids[2]:
        keep = group(docs, id_col, text_col, n, percent).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep"))
        return docs.join(keep, docs[id_col] == keep["_keep"], "left_semi")
    # ids don't tell rows apart: the rows are written with a number
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_row").alias("_key"), F.col(text_col).alias("_text"))
    keep = group(keyed, "_key", "_text", n, percent).where("_key = component_id").select("_key._row")
    return numbered.join(keep, "_row", "left_semi").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"), n=4, percent=85)


#: The same in DuckDB, by the definition: all pairs of texts that share an n-gram, then the links' transitive closure.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []
    ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
    FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), near AS (
  SELECT x, y FROM links JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * shared >= 85 * (s.n + t.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, near.y FROM reach JOIN near ON reach.b = near.x
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
