"""Benchmark decontamination by spaced seeds.

A seed is a mask over neighbouring words: the words under its ones are hashed, those under its zeros may differ. Hashes
of benchmark items and of documents are joined, and around each place where they meet the words are compared one by one
along the diagonal, so passages with substituted words are found as well.

Documents are read once. A bitmap of the benchmark's hashes, of bounded size, decides which documents and hashes go on
to the join; it may let too many through, never too few.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap_of, marked, ranges, table, written

#: Seeds of weight 6 and at most 9 words. Every passage of 10 words with any 2 substituted keeps a hit, and every one of 15
#: with any 3; so does every longer one with a fifth of its words substituted, as some part of it of 10 to 19 words has no
#: more of them.
MASKS = ("110101011", "1101111", "11110011", "111111", "110011011")
#: Items of fewer words are looked for as a whole.
WHOLE = 10
#: The bitmap has at least and at most so many bits (2 ** n), and in between 1,024 for each hash, which sets two.
BITS = (20, 27)

_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(64)]


def masks_for(lengths: set[int], identity: float = 0.8) -> list[tuple[tuple[int, ...], int | None]]:
    """Offsets of each mask's ones and the length of the items that it is for (null: all others): the spaced seeds, and for
    items of fewer than WHOLE words all words but one part of them, in turn, so that as many substitutions as ``identity``
    allows leave one of the masks alone."""
    out: list[tuple[tuple[int, ...], int | None]] = [(tuple(i for i, c in enumerate(m) if c == "1"), None) for m in MASKS]
    for n in sorted(n for n in lengths if 0 < n < WHOLE):
        wrong = int(n * (1 - identity) + 1e-9)
        # in as many parts as can be spared: with 2 parts more than substitutions, two are always whole
        parts = [p.tolist() for p in np.array_split(np.arange(n), min(n, max(n // 2, wrong + 2)))]
        for left_out in combinations(range(len(parts)), wrong):
            out.append((tuple(o for k, p in enumerate(parts) if k not in left_out for o in p), n))
    return out


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of the mask at each place where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number * 2 + 1, np.uint64)
    for k, o in enumerate(mask):
        h += (words[o : o + n] ^ (words[o : o + n] >> np.uint64(29))) * _MULT[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["item_id", "text"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 10, identity: float = 0.8) -> DataFrame:
    """One row per document and benchmark item that overlap: ids, ``n_overlap``, ``n_matched``, ``first_word``.

    An overlap is a stretch of at least ``least_words`` words, or all words of a shorter item, document against item
    without gaps, of which at least ``identity`` are equal; of several, the one in which matches outweigh mismatches most.
    From 0.8 and 10 words on, and for shorter items, none is missed. Words are runs without ASCII white space, compared without regard to case (of any script). Items of fewer than 4 words, null
    or empty texts and items without id overlap with nothing. Repeated documents each overlap; rows that share an id are
    one document here, with the longest overlap of theirs. Other columns are never read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item_kind = benchmark.select(item_col).schema[0].dataType.simpleString()
    items = _items(benchmark, item_col, item_text_col)

    def hash_items(batches):
        words_of = WordHashes(all_cases=True)
        for batch in batches:
            keys, toks, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                if len(w) >= 4:
                    keys.append(key)
                    toks.append(w.tobytes())
                    sizes.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(toks, pa.binary()), pa.array(sizes, pa.int32())], names=["item_id", "item_words", "n"])

    known = written(items.mapInArrow(hash_items, f"item_id {item_kind}, item_words binary, n int").withColumn("item", F.monotonically_increasing_id()), "items")
    masks = masks_for({r[0] for r in known.where(F.col("n") < WHOLE).select("n").distinct().collect()}, identity)

    def seed_items(batches):
        for batch in batches:
            hs, its, ps = [], [], []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.frombuffer(data, np.uint64)
                for m, (mask, length) in enumerate(masks):
                    if length != (len(w) if len(w) < WHOLE else None):
                        continue
                    h = seed_hashes(w, mask, m)[: 1 if length else None]
                    hs.append(h.view(np.int64))
                    its.append(np.full(len(h), item, np.int64))
                    ps.append(np.arange(len(h), dtype=np.int32))
            join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(join(hs, np.int64)), pa.array(join(its, np.int64)), pa.array(join(ps, np.int32))], names=["h", "item", "item_pos"])

    seeds = written(known.select("item", "item_words").mapInArrow(seed_items, "h bigint, item bigint, item_pos int"), "seeds")
    bits = max(BITS[0], min(BITS[1], int(seeds.count() * 1024).bit_length()))
    # two bits for each hash, from its lower and its upper half
    halves = seeds.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("h"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(halves, bits))  # 2 ** BITS[1] bits at most

    def scan(batches):
        words_of, marks = WordHashes(all_cases=True), np.frombuffer(zlib.decompress(bitmap.value), np.uint8)
        hit_type = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, toks, hits = [], [], []
            for part in ranges(pc.binary_length(texts).to_pylist()):
                own = [words_of(t) for t in texts[part].to_pylist()]
                starts = np.cumsum([0, *map(len, own)])
                joined = np.concatenate(own) if own else np.zeros(0, np.uint64)
                found: dict[int, list] = {}
                for m, (mask, _) in enumerate(masks):
                    h = seed_hashes(joined, mask, m)
                    at_low = np.flatnonzero(marked(h, marks))
                    for p in at_low[marked(h[at_low] >> np.uint64(32), marks)]:
                        d = int(np.searchsorted(starts, p, "right")) - 1
                        if p + mask[-1] < starts[d + 1]:  # inside one document
                            found.setdefault(d, []).append({"h": int(h[p].view(np.int64)), "pos": int(p - starts[d])})
                for d, x in found.items():
                    at.append(part.start + d)
                    toks.append(own[d].tobytes())
                    hits.append(x)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(toks, pa.binary()), pa.array(hits, hit_type)], names=["id", "words", "hits"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hit = plain.mapInArrow(scan, f"id {kind}, words binary, hits array<struct<h:bigint,pos:int>>")
    candidates = written(hit.withColumn("row", F.monotonically_increasing_id()), "candidates")
    meetings = candidates.select("row", F.explode("hits").alias("x")).select("row", "x.h", "x.pos").join(seeds, "h")
    diagonals = meetings.groupBy("row", "item").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))

    def verify(batches):
        for batch in batches:
            n_over, n_match, first = [], [], []
            for words, item, diagonals in zip(*[batch.column(i).to_pylist() for i in (1, 3, 4)], strict=True):
                x = best_overlap(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64), diagonals, identity, min(least_words, len(item) // 8))
                n_over.append(x[0])
                n_match.append(x[1])
                first.append(x[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_over, pa.int64()), pa.array(n_match, pa.int64()), pa.array(first, pa.int64())], names=["id", "item_id", "n_overlap", "n_matched", "first_word"])

    both = diagonals.join(candidates.select("row", "id", "words"), "row").join(known, "item").select("id", "words", "item_id", "item_words", "diagonals")
    checked = both.mapInArrow(verify, f"id {kind}, item_id {item_kind}, n_overlap bigint, n_matched bigint, first_word bigint").where("n_overlap > 0")
    best = checked.groupBy("id", "item_id").agg(F.max(F.struct("n_overlap", "n_matched", (-F.col("first_word")).alias("back"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "m.n_overlap", "m.n_matched", (-F.col("m.back")).alias("first_word"))


def best_overlap(words: np.ndarray, item: np.ndarray, diagonals, identity: float, least_words: int = 0) -> tuple[int, int, int]:
    """(words, equal words, first word in the document) of the best stretch of at least ``least_words`` words: each match
    counts 1 - identity, each mismatch -identity, and the stretch of the largest sum is taken, if that isn't negative; of
    all diagonals the one with most equal words, then the longest, then the first."""
    best = (0, 0, 0)
    for d in sorted(diagonals):
        lo, hi = max(0, d), min(len(words), d + len(item))
        if hi <= lo or hi - lo < least_words:
            continue
        same = words[lo:hi] == item[lo - d : hi - d]
        total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity + 1e-9, -identity))])
        # at each end, the least sum that a stretch of enough words can begin with
        least = np.minimum.accumulate(total)[: len(total) - least_words]
        sums = total[least_words:] - least
        k = int(np.argmax(sums))
        if sums[k] < -1e-9:
            continue
        start, end = int(np.flatnonzero(total[: k + 1] == least[k])[-1]), k + least_words
        matched = int(same[start:end].sum())
        if (matched, end - start) > (best[1], best[0]):
            best = (end - start, matched, lo + start)
    return best


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs``, all columns, without the rows that overlap with a benchmark item; ids may be null or repeated, each row
    counts for itself."""
    ids = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    if ids[0] == ids[1]:
        hit = find(docs, benchmark, id_col, **options).select(F.col(id_col).alias("_hit")).distinct()
        return docs.join(hit, docs[id_col] == hit["_hit"], "left_anti")
    # ids don't tell rows apart: the rows are written with a number
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    hit = find(numbered, benchmark, "_row", **options).select("_row").distinct()
    return numbered.join(hit, "_row", "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
