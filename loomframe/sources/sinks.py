"""Writers. Results stay lazy until they are written or collected."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import functions as F

from .dataset import Dataset


def _check(result: Dataset, path: str) -> None:
    """Refuse to overwrite what the result is read from. Both are compared as the file system qualifies them, so a relative
    path, or one without a scheme, is the same folder."""
    spark = result.source.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def whole(p: str) -> str:
        hadoop = jvm.org.apache.hadoop.fs.Path(p)
        uri = hadoop.getFileSystem(conf).makeQualified(hadoop).toUri()
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}".rstrip("/")

    target = whole(path)
    for f in set(result.source.inputFiles()):
        read = whole(unquote(f))
        if read == target or read.startswith(target + "/") or target.startswith(read + "/"):
            raise ValueError(f"{path} is read by what is to be written there")


def save_text(result: Dataset, path: str, sep: str = "\t") -> None:
    """Delimited lines in the order of the columns; null is written as nothing, an array joined with ``;``.

    Overwrites the path, unless the result is read from it.
    """
    _check(result, path)
    df = result.df
    cell = lambda f: F.array_join(F.col(f"`{f.name}`"), ";") if f.dataType.typeName() == "array" else F.col(f"`{f.name}`").cast("string")
    line = F.concat_ws(sep, *[F.coalesce(cell(f), F.lit("")) for f in df.schema.fields])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def save(result: Dataset, path: str, fmt: str = "parquet", sep: str = "\t", **options) -> None:
    """Write as ``text`` or any format of Spark's; overwrites the path, unless the result is read from it."""
    if fmt == "text":
        return save_text(result, path, sep)
    _check(result, path)
    result.df.write.mode("overwrite").options(**options).format(fmt).save(path)
    return None
