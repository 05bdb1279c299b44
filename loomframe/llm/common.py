"""Helpers shared by the corpus operators: tables, folds, samples and cut lineage."""

from __future__ import annotations

import gc
import os
import struct
import tempfile
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else, as ``bytes.split()`` has it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; ``sf_dir`` may be on any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """``crc32`` of the key as text, modulo ``n``; a null key is in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only where all executors are one process (``local[..]``, as in tests) a local
    folder is made up if none is set; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(root, exist_ok=True)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here and lost executors cost nothing.

    Files rather than ``checkpoint()``, for these are columnar and compressed, and every later pass reads only its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_apart(df: DataFrame, name: str, by: str, values: list[str]) -> dict[str, DataFrame]:
    """The same as tables of their own, one for each of the ``values`` that the column ``by`` may have, from one pass over
    ``df``; each without ``by`` and dropped by itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    _remember(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for value in values:
        own = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        own.getFileSystem(conf).mkdirs(own)  # there is no folder of no rows
        out[value] = spark.read.schema(df.drop(by).schema).parquet(f"{path}/{by}={value}")
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files that no frame reads any more go now; Spark deletes them when the driver collects its garbage. Its
    listeners hold the query that ran last, so a query of one row runs before that."""
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remember(spark: SparkSession, path: str) -> None:
    """Written tables go when the application ends."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(conf).delete(jpath, True)


def labelled_sample(df: DataFrame, by: str, per_class: int, seed: int = 17) -> list:
    """About ``per_class`` rows of each value of ``by`` (never more), chosen by a hash of ``doc_id``; of rows with one id
    and value, one with the least of each other column.

    One count per class and one filter by the resulting rates, so nothing is sorted or gathered but the sample itself.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return []
    rates = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * per_class / c)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = df.where(F.col(by).isNotNull() & (draw < rates[F.col(by)])).groupBy("doc_id", by)
    others = [F.min(c).alias(c) for c in df.columns if c not in ("doc_id", by)]
    rows = (drawn.agg(*others) if others else drawn.count()).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in rows:
        seen[r[by]] += 1
        if seen[r[by]] <= per_class:
            kept.append(r)
    return kept


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, text_col: str = "text", id_col: str = "doc_id") -> list:
    """Rows (doc_id, text, label) of at most ``per_class`` labels of each value: the ids are drawn from the labels alone,
    and only those few are broadcast to the texts, so no text is shuffled but theirs. Of texts with one id the least
    counts; an id with several labels counts for each."""
    spark = docs.sparkSession
    drawn = labelled_sample(labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")), "label", per_class)
    if not drawn:
        return []
    kind = labels.schema[id_col].dataType.simpleString()
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in drawn], f"doc_id {kind}, label int")  # 2 * per_class rows
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["text"]))


def label_counts(labels: DataFrame, label_col: str) -> dict:
    return {r[0]: r[1] for r in labels.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}


def per_document(df: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``work(ids, texts) -> columns`` to two columns, some texts at a time; nothing else of ``df`` is read.

    ``work`` is made in each task by calling ``work()`` once, so that models are loaded once a task. It gets about two
    million bytes of text at a time, one text at least, so memory is bounded by that and the largest text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names
    arrow = to_arrow_schema(target)

    def run(batches):
        apply = work()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in ranges(pc.binary_length(texts).to_pylist()):
                out = apply(ids[part].to_pylist(), texts[part].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], names=names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, target)


def ranges(sizes: list, most: int = 2_000_000):
    """Slices of texts of these sizes (null: 0) with about ``most`` in each, at least one text."""
    start = size = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in as many bytes a number as its largest needs, byte by byte, compressed."""
    out = []
    for x in columns:
        x = np.ascontiguousarray(x, "<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [struct.pack("<IB", len(x), width), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = struct.unpack_from("<IB", data, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.view("<u8").reshape(n))
        at += 5 + n * width
    return out


def by_key(batches, key: int):
    """Rows of one key after another, as lists of columns, from batches that are sorted by the column ``key``."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and lo < hi and held[-1].column(key)[0] != batch.column(key)[lo]:
                yield [c.to_pylist() for c in pa.Table.from_batches(held).columns]
                held = []
            if lo < hi:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield [c.to_pylist() for c in pa.Table.from_batches(held).columns]


class WordHashes:
    """64-bit hashes of words, remembered up to a number. A-Z count as lower case, with ``all_cases`` every letter of
    Unicode (case folding, which is lower case but for a few letters like sharp s)."""

    def __init__(self, all_cases: bool = False):
        import xxhash

        self.digest, self.seen, self.all_cases = xxhash.xxh64_intdigest, {}, all_cases

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        seen, out = self.seen, []
        if len(seen) > 400_000:
            seen.clear()
        if self.all_cases:
            text = text.casefold()
        for w in text.encode("utf-8", "replace").lower().split():
            h = seen.get(w)
            if h is None:
                h = seen[w] = self.digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def bitmap_of(hashes: DataFrame, bits: int, strips: int = 16) -> bytes:
    """A compressed bitmap with the low ``bits`` bits of each number in the one column set; filled strip by strip on the executors."""
    import pyarrow as pa

    size = (1 << bits) // strips

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            low = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1)
            at = low.astype(np.int64)
            for s in np.unique(at // size):
                own.setdefault(int(s), np.zeros(size, bool))[at[at // size == s] - s * size] = True
        for s, marks in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1)], pa.binary())], names=["strip", "part"])

    strip = F.shiftrightunsigned(F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)), bits - 4)
    rows = hashes.repartition(strips, strip).mapInArrow(fill, "strip int, part binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(zlib.decompress(bytes(r["part"])), np.uint8)
        out[r["strip"] * size // 8 : r["strip"] * size // 8 + len(part)] |= part
    return zlib.compress(out.tobytes(), 1)


def marked(numbers: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the unsigned numbers have their bit in an unpacked ``bitmap_of``."""
    at = (numbers & np.uint64(len(marks) * 8 - 1)).astype(np.int64)
    return ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
